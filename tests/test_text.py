import pytest
from pyspark.sql import functions as F

from sableflow.functions import text as t


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*(F.col(n) for n in names)).alias("v")).first().v


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>This is a <strong>test</strong> paragraph with <a href='#'>links</a>.</p>", "This is a test paragraph with links."),
        ("<script>alert('test');</script><style>p {}</style><p>Content</p>", "Content"),
        ("a <!-- no\nno --> b", "a b"),
        ("Fish &amp; chips , please !", "Fish &amp; chips, please!"),
        ("keep <escaped> text<br/><br/>next", "keep <escaped> text next"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_html(spark, html, want):
    assert one(spark, t.clean_html, html) == want


@pytest.mark.parametrize(
    ("title", "text", "passed", "reason"),
    [
        (None, "Brazilian sugar exports are rising due to market price changes.", True, "passed"),
        (None, "Copper prices are rising in the commodity market.", False, "no keyword"),
        (None, "sugar", False, "short"),
        ("AÇÚCAR sobe", "Um texto sobre o mercado de hoje em Santos.", True, "passed"),
        (None, "Sugarcoated words are not the commodity itself.", False, "no keyword"),
        (None, "这家糖厂今天停止了压榨，等待新的消息到来再说吧", True, "passed"),
        ("sugar", None, False, "empty"),
        ("sugar", "   ", False, "empty"),
    ],
)
def test_triage(spark, title, text, passed, reason):
    got = one(spark, lambda a, b: t.triage(a, b), title, text)
    assert (got.passed, got.reason) == (passed, reason)


def test_triage_gates(spark):
    text = "A long enough text about raw   sugar."
    assert one(spark, lambda a: t.triage(F.lit(None).cast("string"), a, F.lit(False)), text).reason == "topic"
    assert one(spark, lambda a: t.triage(F.lit(None).cast("string"), a, most=10), text).reason == "long"
    assert one(spark, lambda a: t.contains_keywords(a, ()), text) is False


def test_zones_and_lines(spark):
    got = one(spark, lambda c: t.first_keywords(c, {"market": ("fee", "price"), "event": ("storm", "flood"), "none": ("x",)}), "The port price rose after the flood in India")
    assert [(z.zone, z.word) for z in got] == [("market", "price"), ("event", "flood")]
    text = "intro\n* sugar 14.2\n1. Raw sugar 15\r\n| sugar | 3 |\nPrice: sugar 9\n| zinc | 2 |\n- index - sugar"
    got = [(x.kind, x.line) for x in one(spark, t.structured_lines, text)]
    assert got == [("bullet", "* sugar 14.2"), ("bullet", "- index - sugar"), ("item", "1. Raw sugar 15"), ("row", "| sugar | 3 |"), ("field", "Price: sugar 9")]
    assert one(spark, t.structured_lines, None) is None and one(spark, t.structured_lines, "") == []
    assert one(spark, t.row_fields, "| zinc | 2.50 , |") == ["zinc", "2.50"]
    got = one(spark, lambda c: t.line_fields(c, {"price": ("price", "close"), "volume": ("qty",)}), "Close: 14.20, qty - 3")
    assert (got.price, got.volume) == ("14.20", "3")
    assert one(spark, lambda c: t.replace_words(c, {"lc": "letter of credit"}), "An LC, not  lca") == "An letter of credit, not lca"
    assert one(spark, lambda c: t.content_text(c, {"gains": "rise"}, ("the",)), "The Mill GAINS, see www.x.y") == "mill rise see"


def test_keys(spark):
    same = [one(spark, lambda a, b, c: t.content_key(a, b, c), "Title!", "Some  TEXT, here https://a.b/c", s) for s in ("X", " x ", "y")]
    assert same[0] == same[1] != same[2]
    assert one(spark, lambda a, b, c, d: t.article_id(a, b, c, d), "u", "t", "d", "a") != one(spark, lambda a, b, c, d: t.article_id(a, b, c, d), "u2", "t", "d", "a")
    assert one(spark, t.normalise_punctuation, "“Yes”  he said!!! ...") == '"Yes" he said! .'


def test_jaccard(spark):
    assert one(spark, t.jaccard, "a b c", "b c d") == 0.5
    assert one(spark, t.jaccard, "", "") is None
    assert one(spark, t.jaccard, None, "a") is None


def test_pack_sentences(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    parts = one(spark, lambda c: t.pack_sentences(c, 64, 32), text)
    assert " ".join(parts) == text and all(len(p) // 4 <= 110 for p in parts) and len(parts) > 4
    assert one(spark, lambda c: t.pack_sentences(c, 64, 32), "short") == ["short"]
    endless = " ".join(f"word{i}" for i in range(400))
    parts = one(spark, lambda c: t.pack_sentences(c, 64, 32), endless)
    assert " ".join(parts) == endless and all(len(p) <= 4 * 66 for p in parts[:-1])
    paragraphs = "\n\n".join(["lot " * 50] * 4).strip()
    assert len(one(spark, lambda c: t.pack_sentences(c, 64, 32), paragraphs)) == 4
    assert one(spark, lambda c: t.to_last_sentence(c, 12), "One. Two is long") == "One. Two is "
    assert one(spark, lambda c: t.to_last_sentence(c, 10), "One two. Three") == "One two."


@pytest.mark.parametrize(("s", "want"), [("334.72K", 334720.0), ("1.5M", 1.5e6), ("2 B", 2e9), ("1,234", 1234.0), ("", None), ("n/a", None), ("-3e2", -300.0), (None, None)])
def test_suffixed_number(spark, s, want):
    assert one(spark, t.suffixed_number, s) == want


@pytest.mark.parametrize(
    ("reply", "score", "label"),
    [
        ("Overall I put the sentiment score at about half; Sentiment score: -.35", -0.35, "negative"),
        ("a score of 3 for this lot", 1.0, "positive"),
        ("An extremely positive harvest", 0.9, "positive"),
        ("traders turned bearish after lunch", -0.6, "negative"),
        ("only slightly negative", -0.6, "negative"),
        ("a balanced book", 0.0, "neutral"),
        ("of 12 mills, .25 closed", 0.25, "positive"),
        ("", 0.0, "neutral"),
    ],
)
def test_reply_score(spark, reply, score, label):
    assert one(spark, t.reply_score, reply) == pytest.approx(score)
    got = one(spark, lambda c: t.score_label(t.reply_score(c)), reply)
    assert got.label == label and got.prob_negative + got.prob_neutral + got.prob_positive == pytest.approx(1)


def test_reply_label(spark):
    assert one(spark, t.reply_label, 'ok {"label": "Negative"} then') == "negative"
    assert one(spark, t.reply_label, "Answer: POSITIVE") == "positive"
    assert one(spark, t.reply_label, "{broken neutral") == "neutral"
    assert one(spark, t.reply_label, "none of it") is None


def test_last_things(spark):
    assert one(spark, t.last_number, "1 then -2.5") == -2.5
    assert one(spark, lambda c: t.last_stated(c, "diversity"), "diversity: 0.1 Diversity = 0.8000.") == 0.8
    assert one(spark, t.last_boxed, r"\boxed{1} and \boxed{a{b}c} end") == "a{b}c"
    assert one(spark, t.last_boxed, r"\boxed{open") == "" and one(spark, t.last_boxed, "none") == ""
    assert one(spark, t.last_boxed, r"\fbox{x}") == "x" and one(spark, t.last_boxed, r"\fbox{x} \boxed{}") == "" and one(spark, t.last_boxed, None) is None
    assert one(spark, t.plain_answer, " 007.0 %") == "7" and one(spark, t.plain_answer, r"\dfrac{1}2") == one(spark, t.plain_answer, r"\frac12") == "1/2"


def test_search_query():
    assert t.search_query([["sugar", "raw sugar"], ["Brazil"], []]) == '(sugar OR "raw sugar") AND Brazil'
    assert t.search_query([]) == ""

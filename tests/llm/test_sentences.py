import pytest

from sableflow.llm.sentences import GENERAL, Marks, fit_marks, sentence_spans, split_sentences


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["The mill closed.", "Nobody knows why!", "Really?!"],
        ["Mr. Smith of Acme Inc. paid 3.5 percent.", "The U.S. quota was approx. 4.2 tonnes."],
        ["Crushing ended at 6 p.m.", "The canal closed at 4 p.m. in Delta."],
        ["She bought lots from Acme Inc.", "The refinery paid."],
        ["Mrs. J. R. Doe joined on Jan. 26 at 9.30 a.m. from Ulm."],
        ["Prices ... if one can call them that ... held."],
        ['The agent asked, "Who pays?" and left.', '"We will load. We will not wait," said Mr. Doe.'],
        ["Version 6.10.15, i.e. the draft, lists 6 items (see fig. 1, p. 3) today."],
        ["Acme Corp. Ltd. agreed; nobody else did: it failed."],
        ["Er kam am 6. Juni.", "Der Preis stieg in der 3. Woche in Folge auf 38.", "Die Hütte zahlte z. B. 3,5 Mio. Tonnen."],
        ["Nr. 5.2 der Ordnung (vgl. S. 23) gilt in Ulm.", "Dr. Maier zahlte."],
        ["Die Acme AG u. die Beta & Co. GmbH teilen den Kai Nr. 10 in Ulm.", "„Wir laden. Wir warten nicht“, sagte Maier."],
        ["M. Dupont parle d’env. 3,6 p. 100.", "L'art. 3.14 du texte (cf. p. 27) s'applique.", "Quelle saison pour Lyon !", "Qui paiera ?"],
        ["Acme S.A. et Beta Cie. partagent le quai.", "« Nous chargeons. Nous n’attendrons pas », a dit M. Roux."],
        ["EE. UU. fijó el cupo en 1029 t. para Lima.", "La Dra. Paz cerró por 8.ª vez.", "¿Cuándo?"],
        ["O Sr. Costa pagou aprox. 3 reais (v. pág. 2) no período.", "Que safra!"],
        ["В 2023 г. Рокмир Агро отгрузила 3,5 млн. тонн и 5,3 тыс. мешков, т. е. больше плана.", "По п. 22.4 (см. стр. 11) склад закрыт.", "«Мы грузим. Ждать не будем», — сказал Лом."],
        ["डॉ. नासाना ने लगभग 59.23 प्रतिशत बताया।", "नियम 12.17 (पृ. 23 देखें) लागू है।", "कौन देगा?"],
        ["قال د. رادالو إن الخسارة 4.15 بالمئة.", "يسري البند 11.7 (ص. 13) على ليما.", "من يدفع؟"],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["铝收于21.85美元。", "他们……如果还能这么说……仍报43.01美元（见第16页）。", "谁来支付？", "真是艰难！"],
        ["嘉糖业表示：“价格是3.5元吗？不是。”这让川意外。", "“我们周五装船。我们不会等。”岚说。", "码头关了。"],
        ["価格は……そう呼べるなら……33.6ドルだった（14頁参照）。", "「金曜に積みます。待ちません。」とワヤル氏は述べた。", "誰が払うのか？"],
    ],
)
def test_spaceless_scripts(parts):
    assert cut("".join(parts)) == parts


def test_paragraphs_and_lines():
    assert cut("Market overview\n\nThe mill\nclosed. It\nreopened.") == ["Market overview", "The mill\nclosed.", "It\nreopened."]
    assert cut("One\r\n \r\nTwo.\n\n\nThree") == ["One", "Two.", "Three"]
    assert cut("  padded.  \n\n  ") == ["padded."]


def test_missing_spaces():
    assert cut("The mill closed.The port paid 3.5 percent.Dr. Low left.") == ["The mill closed.", "The port paid 3.5 percent.", "Dr. Low left."]
    assert cut('It closed at Acme Inc."We will load. We wait," said Mr. Doe.') == ["It closed at Acme Inc.", '"We will load. We wait," said Mr. Doe.']
    assert cut("تلقى 4 عرضا من ليما.رفع السعر في روما.") == ["تلقى 4 عرضا من ليما.", "رفع السعر في روما."]


def test_nothing_and_marks():
    assert cut("") == [] and cut(" \n ") == []
    assert cut("...") == ["..."]
    assert cut("!!! Yes") == ["!!!", "Yes"]


def test_table(spark):
    long_text = "A sentence of the long text. " * 3000
    rows = [(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 1), (3, "", 1), (4, long_text, 1), (5, "😀 done. Next", 1)]
    out = split_sentences(spark.createDataFrame(rows, "doc_id bigint, text string, end_pos int"), with_text=True).collect()
    assert sum(r.doc_id == 1 for r in out) == 4 and sum(r.doc_id == 4 for r in out) == 3000
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence for r in out)
    assert [r.end_pos for r in out if r.doc_id == 5] == [7, 12]
    assert split_sentences(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("size", [100, 500, 700, 5000, 50_000])
@pytest.mark.parametrize("marks", ["“”", '""', "()", "«»", "「」", "[]", "„“"])
def test_quotations_and_brackets_of_any_length(size, marks):
    inside = ("We load. " * (size // 9 + 1))[:size].strip(" .")
    assert cut(f"Doe said {marks[0]}{inside}.{marks[1]} and left. Nobody did.") == [f"Doe said {marks[0]}{inside}.{marks[1]} and left.", "Nobody did."]


def test_nested_and_unpaired_marks():
    assert cut("He said “it (the mill. Not the port.) closed. «No.» it is” and left. Bye.") == ["He said “it (the mill. Not the port.) closed. «No.» it is” and left.", "Bye."]
    assert cut("An open “quotation. Never closed. Bye.") == ["An open “quotation.", "Never closed.", "Bye."]
    assert cut("A stray ) here. Bye.") == ["A stray ) here.", "Bye."]


@pytest.mark.parametrize(
    "parts",
    [
        ["It was sold in the U.S.", "Prices rose later."],
        ["Он живёт в 2010 г.", "Мы знаем это."],
        ["La Av. Corrientes es larga.", "Fin."],
        ["他说：“你好！”然后走了。", "天黑了。"],
    ],
)
def test_plain_texts_without_learned_words(parts):
    assert cut("".join(parts) if "。" in parts[0] else " ".join(parts)) == parts


def test_openings_are_learned(spark):
    """Steel is a name here and prices a common word, which decides after U.S.; kp. is an abbreviation nobody listed."""
    texts = ["We met Steel today. Then prices fell. Now we like Steel and the prices. About kp. eleven loads of kp. twelve came."] * 3 + ["Prices fell."] * 3
    model = fit_marks(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert isinstance(model, Marks) and model.opening("Prices") > 0 > model.opening("Steel")
    text = "The U.S. Steel works closed. It was sold in the U.S. Prices rose. They paid kp. Maier."
    assert [text[a:b] for a, b in sentence_spans(text, model)] == ["The U.S. Steel works closed.", "It was sold in the U.S.", "Prices rose.", "They paid kp. Maier."]
    assert fit_marks(spark.createDataFrame([], "text string")).words == GENERAL.words


def test_words_of_spaceless_scripts_by_the_cheapest_path():
    model = Marks(words={"货轮": 4.0, "分析师": 4.0, "分析": 5.0})
    assert model.segmented("货轮分析师说了") == ["货轮", "分析师", "说", "了"]
    assert model.segmented("") == []


def test_time_grows_with_length_only():
    for text in ("a." * 100_000, "“" * 100_000 + "x. Y", '("[« x. ' * 20_000, "字" * 100_000 + "。字" * 20_000, "A.B. " * 40_000):
        assert sentence_spans(text)[-1][1] == len(text.rstrip())

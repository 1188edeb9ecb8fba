import random

import pytest

from sableflow.llm.packing import Packer, fill_rate, pack
from sableflow.llm.splitting import split_texts


def texts(seed=2):
    rng = random.Random(seed)
    words = ["mill", "sugar.", "harvest,", "Ernte!", "糖。", "चीनी।", "😀", "a", "\n\n", "\n"]
    return [" ".join(rng.choices(words, k=n)) for n in (0, 1, 5, 60, 300, 900)] + ["x" * 700, "no boundary" * 1, "é" * 101, None, "word " * 20 + "y" * 300]


@pytest.mark.parametrize(("limit", "overlap"), [(100, 20), (100, 0), (57, 11)])
def test_round_trip(spark, limit, overlap):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    got = {}
    for r in split_texts(spark.createDataFrame(rows, "id bigint, text string, n int"), limit, overlap).collect():
        got.setdefault(r.id, []).append(r)
    for i, t, _ in rows:
        if not t:
            assert i not in got
            continue
        pieces, at = sorted(got[i], key=lambda r: r.piece_no), 0
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
        for p in pieces:
            assert len(p.piece) <= limit and p.start_pos == at
            assert t[at - p.n_overlap : at] == p.piece[: p.n_overlap] and p.n_overlap <= overlap
            assert p.n_overlap > 0 or p.piece_no == 1 or overlap == 0
            core = p.piece[p.n_overlap :]
            assert core and t[at : at + len(core)] == core
            at += len(core)
        assert at == len(t)
        assert len(t) > limit or len(pieces) == 1


def test_natural_boundaries(spark):
    text = "First sentence here is long enough. " + "Second one follows with more words. " * 4
    out = split_texts(spark.createDataFrame([(1, text)], "id bigint, text string"), 100, 20).orderBy("piece_no").collect()
    assert all(r.piece.rstrip().endswith(".") for r in out)


def test_bad_overlap_and_empty(spark):
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([], "id bigint, text string"), 100, 60)
    assert split_texts(spark.createDataFrame([], "id bigint, text string")).count() == 0


def test_packer_never_overflows():
    rng, p, seen = random.Random(1), Packer(100, 4), []
    for i in range(500):
        n = rng.randint(1, 100)
        seen += p.add([(i, 0, n)], n)
    seen += [parts for _, parts in p.leftovers()]
    assert sorted(x[0] for w in seen for x in w) == list(range(500))
    assert all(sum(b - a for _, a, b in w) <= 100 for w in seen)
    assert len(p.rooms) <= 4


def test_every_token_once(spark):
    from pathlib import Path

    from sableflow.llm.packing import TOKENIZER, token_counter

    docs = [(i, "sugar " * n, "w") for i, n in enumerate([1, 5, 5, 30, 64, 65, 200, 1000, 3, 7])] + [(90, None, None), (91, "", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, window string").repartition(3)
    placed = pack(df, capacity=64, most_open=2).collect()
    count = token_counter(Path(TOKENIZER).read_bytes())
    by_doc, by_window = {}, {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
        by_window[r.window] = by_window.get(r.window, 0) + r.token_to - r.token_from
    for i, t, _ in docs:
        n = count([t])[0] if t else 0
        spans = sorted(by_doc.get(i, []))
        assert sum(b - a for a, b in spans) == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert n > 64 or len(spans) == (1 if n else 0)
    assert max(by_window.values()) <= 64


def test_fill(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    row = fill_rate(pack(docs)).first()
    assert row.fullest <= 2048 and row.fill_rate > 0.97


def test_pack_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pieces_of_cut_texts_are_whole(spark, tmp_path):
    from sableflow.llm.plans import p7_pieces

    news = [(1, "Sugar rose again today. " * 400), (2, "short"), (3, "x" * 4000), (4, "x" * 4001), (5, None)]
    spark.createDataFrame(news, "news_no bigint, text string").write.parquet(str(tmp_path / "news.parquet"))
    made: dict = {}
    for r in p7_pieces(spark, str(tmp_path)).orderBy("news_no", "piece_no").collect():
        made[r.news_no] = made.get(r.news_no, "") + r.piece[r.n_overlap :]
    assert made == {k: t for k, t in news if t and len(t) > 4000}

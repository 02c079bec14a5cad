"""Token counts against the libraries, hard negatives and ranked search against brute force and their SQL's rules."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dynspark.llm import hard_negatives, lexical_search, token_counts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.default_path(), "rb") as f:
        return token_counts.Counter("model", f.read())


# --- token counts -----------------------------------------------------------------------------------------------------


def test_counts_are_the_librarys(spark, pieces):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = token_counts.op11_token_counts(spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        n = len(pieces.encode(want[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(want[r["doc_id"]].encode()), n, n > 4096)


ODD = [
    "", " ", "  a", "a  ", "\n", "\n\n a\n", "<s> </s><unk><0x0A>", "a▁b ▁ c", "\0a\0", "ﬁ Å", "日本語のテキスト。" * 30, "🙂🙃" * 40, "aaaa" * 90, " " * 300, "\t" * 99,
    "x" * 70 + " " + "y" * 70, "été ́́ ŧŧ " * 9, "a\r\nb\x0b\x0c" * 20, "1234567890" * 20, "﻿​  q" * 12,
]


@pytest.mark.parametrize("unit", [2, 3, 7, 16, 50])
def test_cut_texts_have_as_many_tokens(counter, pieces, unit):
    assert counter.cuts
    whole = ODD + ["".join(np.random.default_rng(unit).choice(list("ab \n\té日▁<>s0x😀"), 400)) for _ in range(40)]
    got = counter.counts(pa.array(whole), unit)
    assert got.tolist() == [len(pieces.encode(t)) for t in whole]


def test_long_texts_are_cut_and_others_left_whole(counter):
    parts = list(counter.parts("word and word " * 9000, 1000))
    assert len(parts) > 100 and all(len(p) <= 1002 for p in parts)
    assert list(counter.parts("a" * 5000, 1000)) == ["a" * 5000]  # runs of one letter are pieces: no safe place


def test_calls_are_of_bounded_size(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "CALL_BYTES", 100)
    sizes, own = [], counter.lengths
    monkeypatch.setattr(counter, "lengths", lambda texts: sizes.append(sum(map(len, texts))) or own(texts))
    texts = ["some words here"] * 50 + [""] * 5 + ["more words"]
    assert counter.counts(pa.array(texts)).tolist() == [own([t])[0] for t in texts]
    assert max(sizes) < 130 and len(sizes) > 5


def test_counts_with_a_json_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string"), path)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {k: len(library.encode(t, add_special_tokens=False)) for k, t in enumerate(ODD)}


def test_counts_of_odd_tables(spark):
    rows = [(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "a b", 4), (2, "a b", 4)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), limit=1).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, True), (2, 3, 2, True)], key=str)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- hard negatives ---------------------------------------------------------------------------------------------------


def by_hand(rows, anchor, positives=5, negatives=3):
    """rows: id, vec, label, all usable."""
    q = [(i, [math.floor(x * 256) for x in v], b) for i, v, b in rows]
    out = []
    for k, (i, v, b) in enumerate(q):
        if not anchor(i):
            continue
        score = {n: sum(x * y for x, y in zip(v, w, strict=True)) for n, (_, w, _) in enumerate(q) if len(w) == len(v)}
        best = sorted((n for n in score if n != k and q[n][2] == b), key=lambda n: (-score[n], q[n][0], n))[:positives]
        for p in best:
            rest = sorted((n for n in score if q[n][2] != b and 50 * score[p] <= 100 * score[n] <= 95 * score[p]), key=lambda n: (-score[n], q[n][0]))[:negatives]
            out += [(i, q[p][0], r + 1, q[n][0], score[p], score[n]) for r, n in enumerate(rest)]
    return sorted(out)


def test_hard_negatives_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0.1, 0.2, 6)], int(i % 3)) for i in range(90)]
    rows += [(k, [0.5] * 6, 0) for k in (100, 101, 102, 103)] + [(k, [0.4] * 6, 1) for k in (104, 105, 106, 107, 107)] + [(108, [0.5] * 3, 0), (110, [0.5] * 3, 1), (120, [], 1), (130, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cells in (50, 1 << 22):
        got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), cells=cells)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [0.5, 0.5], 1, "x"), (1, [0.5, 0.4], 1, "x"), (2, [0.4, 0.4], 2, "x"), (0, [0.5, 0.5], 1, "y"), (2, [0.4, 0.4], 2, "y")]
    bad = [(None, [0.5, 0.5], 1, "x"), (50, None, 1, "x"), (100, [0.5, None], 1, "x"), (3, [nan, 0.5], 2, "x"), (4, [inf, 0.5], 2, "x"), (5, [0.4, 0.4], None, "x")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int, row string")
    got = hard_negatives.hard_negatives(df, F.col("id") % 50 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == by_hand([r[:3] for r in good], lambda i: i % 50 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 50 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("size", [1, 300, 70_000])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    for n, dim in ((1, 1), (7, 33), (300, 64)):
        q, a = rng.integers(-size, size + 1, (n, dim)), rng.integers(-size, size + 1, (5, dim))
        pack = hard_negatives.Packed(q, int(np.abs(a).max()))
        for x in a.tolist():
            assert pack.scores(x).tolist() == [sum(u * v for u, v in zip(x, w, strict=True)) for w in q.tolist()]
    assert hard_negatives.Packed(np.zeros((3, 2), np.int64), 0).scores([0, 0]).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        hard_negatives.Packed(np.full((1, 2), 1 << 40), 1 << 40)


# --- ranked search ----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(docs, items, top):
    split = lambda t: TERM.findall((t or "").translate(LOW))
    found = [(i, split(t)) for i, t in docs]
    nn, ll = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    out = []
    for item, text in items:
        asked, rows = split(text), []
        w = {t: math.floor(1000 * math.log((2 * nn + 2) / (2 * sum(t in x for _, x in found) + 1))) for t in set(asked)}
        for i, x in found:
            m = 75 + 25 * len(x) * nn // ll if ll else 0
            s = sum(w[t] * (10**9 * x.count(t) // (1000 * x.count(t) + 12 * m)) for t in asked if t in x)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


DOCS = [
    (5, "The quick Brown fox, the lazy dog."), (1, "brown BROWN fox-fox 12ab"), (9, "ÄÖ äö Ärger naïve"), (2, "the quick Brown fox the lazy dog"), (7, None), (8, " \n-- !"), (None, "fox"), (3, "fox"), (4, "fox"),
    (4, "fox"), (10, "a" * 40 + " fox " + "b" * 16), (11, "日本語 fox" * 30), (12, "averyveryverylongterm x"), (13, "averyveryverylongtermx"), (14, "fifteenletters1 dog"), (15, ""),
]
ITEMS = [(1, "Fox fox dog"), (2, "ÄÖ naïve"), (3, None), (4, "averyveryverylongterm " + "b" * 16), (4, "fifteenletters1 dog"), (None, "lazy brown"), (6, "nowhere"), (7, "日本語")]


def test_search_by_hand(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for top, more in ((3, {}), (20, {}), (2, {"most_postings": 4}), (5, {"most_items": 2})):
        got = lexical_search.search(docs.repartition(3), items, top=top, **more)
        assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(DOCS, ITEMS, top)


def test_search_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, "b", 4)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(1, "b a", "x")], "item_id long, text string, rank string")
    assert sorted(map(tuple, lexical_search.search(docs, items).collect()), key=str) == ranked_by_hand([(1, "a b"), (2, "b")], [(1, "b a")], 20)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lexical_search.search(docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"), most_postings=3)


@pytest.mark.parametrize("block", [1, 3, 8, 64])
def test_terms_in_small_blocks(block):
    texts = [t or "" for _, t in DOCS] + ["ab" * 50 + " cd"]
    known = sorted({t.encode() for x in texts for t in TERM.findall(x.translate(LOW))})
    n, doc, term, count = lexical_search.counted(pa.array(texts), lexical_search.Terms(known), block)
    split = [TERM.findall(t.translate(LOW)) for t in texts]
    assert n.tolist() == [len(x) for x in split]
    assert {(d, known[t].decode()): c for d, t, c in zip(doc.tolist(), term.tolist(), count.tolist(), strict=True)} == {(k, t): x.count(t) for k, x in enumerate(split) for t in x}

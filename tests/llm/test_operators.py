"""The corpus operators against brute force, exact round trips and held-out labels, and on the odd cases."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.llm import bpe, byte_cnn, chat, embedding_dedup, exact_dedup, html_extract, mixing, shingle_dedup, simhash, substring_dedup, token_output
from dynspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 4000
ODD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, LONG, "en", "a", 9), (4, "same words here", "en", "b", 1), (5, "same words here", "en", None, 1), (5, "same words here", "en", None, 1), (None, "x", "en", "b", None), (7, "   ", "en", "", 3), (8, LONG + "end", "en", "c", 3)]


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def union_find(items, pairs):
    up = {i: i for i in items}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


# --- 1, 2 -------------------------------------------------------------------------------------------------------------


def test_mixture_is_near_its_targets(spark, documents):
    rows = mixing.copies(documents).collect()
    by = {}
    for r in rows:
        assert 0 <= r["copies"] <= 3
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-3 * sum(s for s, _ in by)
    for (size, target), own in by.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 2 * max(r["size"] for r in own)


@pytest.mark.parametrize("sizes", [[0, 0, 0], [5], [10**6, 1, 2, 3, 4, 5, 6], [3**k for k in range(25)], [(k * k) % 97 * 1000 + k for k in range(300)]])
def test_targets_of_many_sources(spark, sizes):
    """Against filling the sources one after another, in order of the level at which they are full; the last source has no name."""
    names = sorted(f"s{k:03d}/\u00e9{k % 7}" for k in range(len(sizes) - 1)) + [None]
    by_source = spark.createDataFrame([(f"n{k}", x, s) for k, (x, s) in enumerate(zip(names, sizes, strict=True))], "key string, source string, source_size long")
    weights = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    left, open_, want = sum(sizes), sum(weights), {}
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k] / weights[k]):
        if left / open_ * weights[k] <= 3 * sizes[k]:
            break
        want[k], left, open_ = 3.0 * sizes[k], left - 3 * sizes[k], open_ - weights[k]
    got = {int(r["key"][1:]): r["target"] for r in mixing.targets(by_source.repartition(3)).collect()}
    assert got == {k: want.get(k, left / open_ * weights[k]) for k in range(len(sizes))}
    assert sum(got.values()) == pytest.approx(sum(sizes))


def test_mixture_rows_follow_copies_and_agree(spark):
    docs = docs_of(spark)
    want = {}
    for r in mixing.copies(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    for _ in range(2):
        got = {}
        for r in mixing.mix(docs).collect():
            assert len(r) == 5
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert got == {k: v for k, v in want.items() if v}
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mixture_with_clashing_columns(spark):
    docs = docs_of(spark).selectExpr("*", "1 AS size", "2 AS key", "3 AS copies", "4 AS row")
    assert mixing.mix(docs).columns == docs.columns


def test_exact_copies(spark, texts, documents):
    keep = {}
    for i, t in texts.items():
        keep[t] = max(i, keep.get(t, i))
    for r in exact_dedup.marks(documents).collect():
        t = texts[r["doc_id"]]
        assert r["keep_id"] == keep[t] and r["kept"] == (r["doc_id"] == keep[t]) and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert {r["doc_id"] for r in exact_dedup.drop(documents).collect()} == set(keep.values())


def test_exact_copies_odd_cases(spark):
    docs = docs_of(spark)
    got = exact_dedup.drop(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 2, 3, 5, 7, 8]
    assert exact_dedup.drop(docs.limit(0)).count() == 0 and exact_dedup.marks(docs.limit(0)).count() == 0


@pytest.mark.parametrize("drop", [exact_dedup.drop, simhash.drop, shingle_dedup.drop])
def test_dropping_tells_rows_apart_by_id_and_text(spark, drop):
    a, b = " ".join(f"one{k}" for k in range(60)), " ".join(f"two{k}" for k in range(60))
    got = drop(docs_of(spark, [(3, a, "en", "a", 1), (5, a, "en", "a", 1), (5, b, "en", "a", 1), (None, a, "en", "a", 1), (None, a, "en", "a", 1)]))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(5 if drop is exact_dedup.drop else 3, a), (5, b)])


@pytest.mark.parametrize("drop", [exact_dedup.drop, simhash.drop, shingle_dedup.drop])
def test_dropping_with_clashing_columns(spark, drop):
    docs = docs_of(spark).selectExpr("*", "1 AS id", "2 AS digest", "3 AS row", "4 AS __sha", "5 AS __digest", "6 AS component", "7 AS fp", "8 AS node")
    got = drop(docs)
    assert got.columns == docs.columns
    assert all(tuple(r)[5:] == (1, 2, 3, 4, 5, 6, 7, 8) for r in got.collect()) and drop(docs.limit(0)).columns == docs.columns


def test_heavy_and_rare_digests_are_settled_alike(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"text {k % 50}", "en", "a", 1) for k in range(600)]
    got = {r["doc_id"]: r for r in exact_dedup.marks(docs_of(spark, rows)).collect()}
    for k, t, *_ in rows:
        own = [x for x in rows if x[1] == t]
        assert (got[k]["keep_id"], got[k]["group_size"]) == (own[-1][0], len(own))


# --- 3, 7 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_encoding_is_the_librarys(spark, library, texts, documents):
    got = {r["doc_id"]: r for r in bpe.digests(documents).collect()}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_odd_texts(library):
    v = bpe.Vocabulary(bpe.default_path())
    rng = np.random.default_rng(1)
    parts = [*"abcdeéèñşİΣσςABCthe\t\n\x1c\x1f\x85'sdl12½!*$#中文字한글̣́", "<|endoftext|>", "<|startoftext|>", " ", "  ", "'re", "'LL", "<|endof"]
    made = ["", " ", "x" * 5000, "abcé" * 3000, "<|endoftext|>", "a<|endoftext|>b"] + ["".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(1500)]
    assert encoded_texts(v, made) == [library.encode(t, add_special_tokens=False).ids for t in made]


def encoded_texts(v, texts):
    ids, counts = v.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_every_character_between_letters(library):
    v = bpe.Vocabulary(bpe.default_path())
    made = [f"a{chr(k)}b" for k in range(0x32000) if not 0xD800 <= k < 0xE000]
    assert encoded_texts(v, made) == [x.ids for x in library.encode_batch(made, add_special_tokens=False)]


def test_long_words_and_long_texts(library, monkeypatch):
    v = bpe.Vocabulary(bpe.default_path())
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    made = [word(n) for n in (1, 2, 14, 15, 16, 17, 31, 32, 33, 64, 65, 1000, 20000)] + ["é" * 999, "中" * 3000, "x" * 5000] + [" ".join(word(int(n)) for n in rng.integers(1, 60, 900))]
    want = [library.encode(t, add_special_tokens=False).ids for t in made]
    assert encoded_texts(v, made) == want
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(bpe, "COMPANY", 1)
    assert encoded_texts(v, made) == want


def test_table_of_pieces_stays_small(library):
    v = bpe.Vocabulary(bpe.default_path())
    v.known = bpe.Pieces(v.dtype, 4)
    rng = np.random.default_rng(6)
    made = [" ".join("".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(1, 9, 300)) for _ in range(20)]
    want = [library.encode(t, add_special_tokens=False).ids for t in made]
    assert [encoded_texts(v, [t])[0] for t in made] == want == encoded_texts(v, made)
    assert len(v.known.ids) == 32


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_workers_arrays_stay_small_whatever_a_batch_holds(library):
    path = bpe.default_path()
    bpe.vocabulary(path)
    words = ["".join(w) for w in np.random.default_rng(8).choice(list("abcdefghéü"), (3000, 6))]
    some = [" ".join(np.random.default_rng(k).choice(words, 400)) for k in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(some * 10 + [" ".join(some * 10)])], ["doc_id", "text"])
    got = []
    assert peak_mb(lambda: got.extend((b.column(1).value_lengths().to_pylist(), b.column(2)[0].as_py()) for b in bpe.decoded(bpe.encoded(iter([rows]), path), path))) < 80
    counts = [n for part, _ in got for n in part]
    assert counts == [len(library.encode(t, add_special_tokens=False).ids) for t in some] * 10 + [sum(counts[:1000])]
    fps = np.random.default_rng(9).integers(0, 1 << 62, 4096)
    golay = simhash.code(1)[0]
    assert peak_mb(lambda: golay.home(fps)) < 20


def test_encode_and_decode_frames(spark, library):
    docs = docs_of(spark)
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    for r, given in zip(out.collect(), ODD, strict=True):
        ids = library.encode(given[1] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1025])
def test_feistel_network_is_a_permutation(n):
    assert sorted(token_output.permuted(np.arange(n), n).tolist()) == list(range(n))
    assert n < 100 or token_output.permuted(np.arange(n), n, 1).tolist() != token_output.permuted(np.arange(n), n, 2).tolist()


@pytest.mark.parametrize(("length", "shard", "moved"), [(64, 50, False), (64, 50, True), (16, 3, False)])
def test_token_shards(spark, library, tmp_path, length, shard, moved):
    docs = docs_of(spark).repartition(5, "doc_id") if moved else docs_of(spark)
    rows, layout = token_output.write(docs, str(tmp_path), length=length, shard=shard)
    rows = rows.collect()
    assert shard == 50 or token_output.group(-(-layout.sequences // shard)) > 1
    assert sorted(r["slot"] for r in rows) == list(range(layout.sequences))
    every, end = token_output.read(layout, 0, layout.sequences), 49407
    by = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        assert r["offset"] == r["slot"] % shard * 2 * length and r["shard"] == r["slot"] // shard
        by.setdefault(r["doc_id"], []).append(every[r["slot"]][: r["n_tokens"]])
    for i, t in ((1, ""), (3, LONG), (None, "x"), (8, LONG + "end")):
        assert np.concatenate(by[i]).tolist() == [*library.encode(t, add_special_tokens=False).ids, end]
    assert (token_output.read(layout, 45, 10) == every[45:55]).all()
    assert token_output.write(docs_of(spark).limit(0), str(tmp_path / "none"))[0].count() == 0


def test_token_shards_are_written_by_few_tasks():
    assert [token_output.group(n) for n in (0, 1, 63, 64)] == [1, 1, 1, 2]
    assert all(-(-n // token_output.group(n)) <= 20_000 for n in (10**6, 3 * 10**6, 10**7))


# --- 4 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies(spark, texts, documents):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    for r in simhash.near_duplicates(documents).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    assert {r["doc_id"] for r in simhash.drop(documents).collect()} == set(want.values())


@pytest.mark.parametrize("n", [1, 1 << 22, 1 << 30])
def test_anchors_cover(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    y = x.copy()
    for b in rng.integers(0, 64, (3, 200)).astype(np.uint64):
        y ^= np.uint64(1) << b
    blocks = simhash.code(n)
    home = simhash.placed(x.view(np.int64), blocks, 3)[0]
    _, rows, anchors = simhash.placed(y.view(np.int64), blocks, 3)
    visits = set(zip(rows.tolist(), anchors.tolist(), strict=True))
    assert all((i, h) in visits for i, h in enumerate(home.tolist()))


def test_dense_fingerprints_in_slices(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 4)
    fps = {int(base[k % 4]) ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 4)), replace=False)) for k in range(900)}
    ids = sorted(fps)
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (a ^ b).bit_count() <= 3])
    distinct = spark.createDataFrame([(x,) for x in ids], "fp long")
    for size in (4096, 7):
        links = simhash.links(distinct, slice_rows=size)
        got = {r["node"]: r["component"] for r in components(links.select("u", "v")).collect()}
        assert {i: got.get(i, i) for i in ids} == want
        assert all((r["u"] ^ r["v"]).bit_count() <= 3 for r in links.collect())


def test_near_copies_odd_cases(spark):
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark)).collect())
    assert [r[2] for r in got if r[0] in (1, 2, 7)] == [1, 1, 1] and all(r[1] == "0" * 16 for r in got if r[0] in (1, 2, 7))
    assert [r[2] for r in got if r[0] == 5] == [4, 4]
    assert simhash.near_duplicates(docs_of(spark).limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)]
    want = union_find({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and all(c == i for i, c in want.items() if i not in got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def alike_pairs(texts):
    sets, where = {i: plain_shingles(t) for i, t in texts.items()}, {}
    for i, own in sets.items():
        for s in own:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    return [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def edited_texts():
    rng = np.random.default_rng(6)
    word = lambda: f"w{int(rng.integers(3000))}"
    line, made = " ".join(word() for _ in range(40)), []
    for k in range(40):
        base = [word() for _ in range(int(rng.integers(3, 200)))]
        for n in range(6):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                own[int(rng.integers(len(own)))] = word()
            made.append(" ".join(own[: len(own) - int(rng.integers(0, 1 + len(own) // 10))]) + (f" {line}" if k % 2 else ""))
    return dict(enumerate(["", " \t", *made]))


def test_pipeline_drops_near_copies_of_similarity_four_fifths(spark):
    import corpus_pipeline as pipeline

    made = edited_texts()
    pairs = alike_pairs(made)
    far = [1 for a, b in pairs if (plain_fingerprint(made[a]) ^ plain_fingerprint(made[b])).bit_count() > 3]
    assert len(far) > 50
    docs = docs_of(spark, [(i, t, "en", "a", len(t)) for i, t in made.items()])
    got = pipeline.near_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(union_find(made, pairs).values()))
    assert pipeline.near_copies(spark, docs.limit(0), SMALL).count() == 0


def test_near_copies_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    made = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["doc_id"] for r in shingle_dedup.drop(docs).collect()} == set(union_find(made, alike_pairs(made)).values())


def test_pipeline_finds_near_copies_by_the_covering_code(spark, monkeypatch):
    """Without the lists of shingles, copies whose fingerprints differ in at most three bits go all the same, and only those that are alike."""
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 600)) for _ in range(12)]
    made = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + " end") for k, t in enumerate(texts)]
    bits = lambda t: shingle_dedup.simhash128(shingle_dedup.shingles(t))[0] & (1 << 64) - 1
    near = {100 + k for k, t in enumerate(texts) if (bits(t) ^ bits(t + " end")).bit_count() <= simhash.BITS}
    assert near
    lists = shingle_dedup.lists
    monkeypatch.setattr(shingle_dedup, "lists", lambda rows: lists(rows).limit(0))
    got = {r["doc_id"] for r in pipeline.near_copies(spark, spark.createDataFrame(made, "doc_id long, text string"), SMALL).collect()}
    assert got == {k for k, _ in made} - near
    monkeypatch.setattr(shingle_dedup, "close", lambda rows: rows.select(F.col("node").alias("u"), F.min("node").over(Window.partitionBy()).alias("v")))
    got = {r["doc_id"] for r in pipeline.near_copies(spark, spark.createDataFrame(made, "doc_id long, text string"), SMALL).collect()}
    assert got == set(range(12))


def test_near_copies_in_batches_and_with_frequent_shingles(spark, monkeypatch):
    made = edited_texts()
    docs = docs_of(spark, [(i, t, "en", "a", len(t)) for i, t in made.items()])
    want = sorted(set(union_find(made, alike_pairs(made)).values()))
    monkeypatch.setattr(shingle_dedup, "FREQUENT", 5)
    monkeypatch.setattr(shingle_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shingle_dedup.links, "__defaults__", (shingle_dedup.BITS, 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(r["doc_id"] for r in shingle_dedup.drop(docs).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fingerprints_of_alike_sets_are_near():
    rng = np.random.default_rng(12)
    for n in (4, 5, 9, 20, 100, 1000):
        for _ in range(60):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            gone = int(rng.integers(0, n // 9 + 1)) if n > 5 else int(n == 5)
            b = np.r_[a[gone:], rng.integers(-(1 << 62), 1 << 62, gone if n > 5 else 0)]
            assert shingle_dedup.alike(np.sort(a), np.sort(b))
            x, y = shingle_dedup.simhash128(np.sort(a)), shingle_dedup.simhash128(np.sort(b))
            assert sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True)) <= shingle_dedup.BITS


def test_near_copies_with_repeated_and_null_ids(spark):
    base = [f"word{k}" for k in range(100)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(f"other{k}" for k in range(80))
    rows = [(1, " ".join(base), "en", "a", 1), (2, near, "en", "a", 1), (2, other, "en", "a", 1), (None, near + " y", "en", "a", 1), (None, near + " z", "en", "a", 1), (None, "alone", "en", "a", 1), (9, "twice", "en", "a", 1), (9, "twice", "en", "a", 1)]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in shingle_dedup.drop(docs_of(spark, rows)).collect())
    assert got == [(-1, "alone"), (1, " ".join(base)), (2, other), (9, "twice")]


# --- 5, 6 -------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><div>Site name</div></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies and more cookies.</p></div>
<article><h1>The  great
 title</h1><p>First &amp; only <b>bold</b> text, with words enough to be a text.<p>Second one&nbsp;here, it also goes on for a while.</p></article>
<aside class="sidebar"><h3>More</h3><ul><li><a href="/c">Other</a></li></ul></aside><div class="comments"><p>I liked this text very much.</p></div>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer></body></html>"""


@pytest.fixture(scope="module")
def field():
    return html_extract.trained()


def test_main_text_of_pages(spark, field):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "<p"), (5, "x", "<div class='ad'>Buy</div>" * 3), (1, "u", PAGE)], "page_id long, url string, html string")
    got = [r for r in html_extract.extract(pages, field).collect()]
    want = "The great title\nFirst & only bold text, with words enough to be a text.\nSecond one here, it also goes on for a while."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert [r["text"] for r in got if r["page_id"] in (2, 3, 4, 5)] == [""] * 4
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(pages.limit(0), field).count() == 0


def test_head_without_its_end_tag_hides_nothing(field):
    want = html_extract.main_text(PAGE, field)
    assert want
    for given in (PAGE.replace("</head>", ""), PAGE.replace("</head><body>", ""), PAGE.replace("</head>", "<meta charset='utf-8'><template><p>no</p></template><link rel='x'>")):
        assert html_extract.main_text(given, field) == want
    assert [b.text for b in html_extract.blocks("<head><title>no</title><meta x>Only text <b>here</b>")] == ["Only text here"]


@pytest.mark.parametrize("page,want", [
    ("<p data-n=it's>Hello</p><p>I don't know</p>", ["Hello", "I don't know"]),
    ("<p>one</p><p title=\"never closed>two</p>", ["one"]),
    ("<p title='a>b' class=x/>one</p>", ["one"]),
    ("<p>if x<y</p><p>a < b, 1<2 and <<i>c</i>></p>", ["if x<y", "a < b, 1<2 and <c>"]),
    ("a<!--x--!>b<!-->c</>d<?pi?>e</ x>f", ["abcdef"]),
    ("<div>one<b>two<div>three</b>four</div>five</div>", ["onetwo", "threefour", "five"]),
    ("<b>one<i>two</b>three</i>four", ["onetwothreefour"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>", ["a", "b", "c", "d", "e"]),
    ("<script>if (a < b) '</p>'</script >x<style>y</style", ["x"]),
    ("<svg><title>no</title><text>label</text><path d='x'/></svg><p =y>z<img>w", ["label", "z w"]),
    ("<p", []), ("x<p", ["x"]), ("<p>open", ["open"]), ("&lt;b&gt; &amp;amp; &nbsp;x", ["<b> &amp; x"]),
])
def test_blocks_of_odd_markup(page, want):
    assert [b.text for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize("page", ["<b>x" * 8000, "<div>x" * 8000, "<p title='x>y\"" * 8000, "<a <" * 8000, "<b>" * 4000 + "<i>" * 4000 + "</b>x" * 4000, "<b>" * 8000 + "<p>x" * 8000, "<!--" * 8000, "<li>x" * 8000, "<td><li>x" * 8000, "<div class='" + "a " * 9 + "'>x" * 8000, "".join(f"<x{k} class=n{k}><div>y" for k in range(8000))])
def test_blocks_of_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - began < 2


def test_formulas_are_text(field):
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='x'>no</annotation></semantics></math>"
    got = html_extract.main_text(PAGE.replace("<b>bold</b>", formula), field)
    assert got == html_extract.main_text(PAGE.replace("<b>bold</b>", "E=m"), field) and "E=m text" in got


def test_field_on_other_pages(field):
    assert html_extract.accuracy(field, html_extract.labelled_pages(80, seed=77)) > 0.98


@pytest.mark.parametrize("kind,least", [("main", 0.95), ("main and article", 0.97), ("div", 0.7)])
def test_field_on_kinds_of_articles_that_it_has_not_seen(kind, least):
    others = tuple(k for k in html_extract.KINDS if k != kind)
    assert html_extract.accuracy(html_extract.trained(160, only=others), html_extract.labelled_pages(60, 77, (kind,))) > least


@pytest.mark.parametrize("kind", [k for k in html_extract.KINDS if k != "div"])
def test_field_on_layouts_that_it_has_not_seen(kind):
    others = tuple(k for k in html_extract.KINDS if k != kind)
    assert html_extract.accuracy(html_extract.trained(300, only=others), html_extract.labelled_pages(60, 77, (kind,))) >= 0.97


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; Example &middot; all rights reserved.</footer>"
T, P, Q = "A title of some words", "The first paragraph has words enough to be one, and it goes on for a while.", "The second one says more about it, and then it ends."
TOP, BODY = f"<h1>{T}</h1>", f"<p>{P}</p><p>{Q}</p>"
LAYOUTS = {
    "article with a div": (f"<article><div>{TOP}{BODY}</div></article>", [T, P, Q]),
    "article with a section": (f"<article>{TOP}<section>{BODY}</section></article>", [T, P, Q]),
    "three plain divs": (f"{'<div>' * 3}{TOP}{BODY}{'</div>' * 3}", [T, P, Q]),
    "ten plain divs": (f"{'<div>' * 10}{TOP}{BODY}{'</div>' * 10}", [T, P, Q]),
    "article with sixty divs": (f"<article>{'<div>' * 60}{TOP}{BODY}{'</div>' * 60}</article>", [T, P, Q]),
    "main with a section": (f"<main><section><h2>{T}</h2>{BODY}</section></main>", [T, P, Q]),
    "main with two sections": (f"<main>{TOP}<section><h2>Part one</h2><p>{P}</p></section><section><h2>Part two</h2><p>{Q}</p></section></main>", [T, "Part one", P, "Part two", Q]),
    "a plain div": (f"<div>{TOP}{BODY}</div>", [T, P, Q]),
    "nothing around it": (f"{TOP}{BODY}", [T, P, Q]),
    "a numbered list": (f"<article>{TOP}<p>{P}</p><ol><li>One thing</li><li>Two things</li></ol><p>{Q}</p></article>", [T, P, "One thing", "Two things", Q]),
    "terms": (f"<article>{TOP}<dl><dt>Term</dt><dd>What it means here.</dd></dl><p>{Q}</p></article>", [T, "Term", "What it means here.", Q]),
    "preformatted": (f"<article>{TOP}<p>{P}</p><pre>x = 1; y = 2</pre></article>", [T, P, "x = 1; y = 2"]),
    "a deep sidebar after it": (f"<article>{TOP}{BODY}</article><aside>{'<div>' * 60}<p>Some words in a sidebar here.</p>{'</div>' * 60}</aside>", [T, P, Q]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_ordinary_layouts(field, name):
    body, want = LAYOUTS[name]
    for top, low in ((NAV, FOOT), (f"{NAV}<div class='ad'>Buy this now, it is cheap.</div>", FOOT), (f"<header><h1>Site</h1>{NAV}</header>", f"<aside><h3>More</h3><p>Some words here.</p></aside>{FOOT}")):
        assert html_extract.main_text(f"<!DOCTYPE html><html><head><title>x</title></head><body>{top}{body}{low}</body></html>", field).split("\n") == want


def test_given_pages_give_their_articles(spark, field):
    import html
    import re

    for r in html_extract.extract(spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("raw", F.col("html")), field).collect():
        art = re.search(r"<article>(.*)</article>", r["raw"], re.S)[1]
        art = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)\b[^>]*>", "\0", art)))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(s).split()) for s in art.split("\0")) if x)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    f = html_extract.Field()
    f.weights, f.pairs = rng.normal(size=html_extract.FEATURES), rng.normal(size=(2, 2)) * 2
    feats = [[int(x) for x in rng.integers(0, html_extract.FEATURES, 3)] for _ in range(9)]
    value = lambda y: sum(u for u, k in zip(f.unary(feats), y, strict=True) if k) + sum(f.pairs[a, b] for a, b in zip(y, y[1:], strict=False))
    every = [[n >> k & 1 for k in range(9)] for n in range(512)]
    assert f.decode(feats) == max(every, key=value)
    z = np.array([value(y) for y in every])
    assert np.allclose(f.marginals(feats)[0], np.average(every, axis=0, weights=np.exp(z - z.max())))


def test_quality_on_held_out_documents(spark):
    base = SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    net = byte_cnn.train(docs, labels, rows=2000)
    rows = byte_cnn.scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), net).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.97 * len(held)


def test_quality_odd_cases(spark):
    docs = docs_of(spark)
    net = byte_cnn.fit(["clean words only", "bad!!! $$$ ***"] * 8, [1, 0] * 8)
    got = byte_cnn.scores(docs, net).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert byte_cnn.keep(docs, net).columns == docs.columns and byte_cnn.scores(docs.limit(0), net).count() == 0
    assert byte_cnn.fit([], []).score("x") == byte_cnn.fit([], []).score("x")


def test_repeats_are_the_shares_of_equal_bytes():
    data = np.random.default_rng(2).integers(97, 100, 500).astype(np.uint8)
    got = byte_cnn.repeats(data, 96, 240)
    for cell in range(9):
        for lag in (1, 7, 32):
            upto = 96 + 16 * (cell + 1)
            assert got[cell, lag - 1] == np.float32(sum(p >= lag and data[p] == data[p - lag] for p in range(upto - 64, upto)) / 64)


def test_sample_to_fit_on_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"{'word ' * (k % 7)}{k}") for k in range(400)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = byte_cnn.labelled(docs, labels, 20, 200).collect()
    assert 0 < len(got) <= 20 and sum(len(r["text"]) for r in got) <= 200 and len({r["doc_id"] for r in got}) == len(got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def test_a_giant_labelled_text_puts_no_other_out(spark):
    docs = [(k, f"{'clean words only ' if k % 2 else 'bad!!! $$$ *** '}{k}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, 1) for k in range(200, 260)], "doc_id long, quality int")
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    giants = spark.createDataFrame(docs + [(k, "word " * 1200) for k in range(200, 260)], "doc_id long, text string")
    want = sorted(r["doc_id"] for r in byte_cnn.labelled(plain, labels, size=5000).collect())
    assert len(want) > 100 and sorted(r["doc_id"] for r in byte_cnn.labelled(giants, labels, size=5000).collect()) == want
    assert len(byte_cnn.labelled(giants.filter("doc_id >= 200"), labels, size=5000).collect()) == 1
    got = {}
    for name, df in (("plain", plain), ("giants", giants)):
        net = byte_cnn.fit(*map(list, zip(*sorted((r["text"], r["quality"]) for r in byte_cnn.labelled(df, labels, size=5000).collect()), strict=True)))
        got[name] = sorted(r["doc_id"] for r in byte_cnn.keep(plain, net).collect())
    assert got["plain"] == got["giants"] and 80 < len(got["plain"]) < 120


def test_chunks_don_t_change_a_score(monkeypatch):
    net = byte_cnn.Network(3)
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("abc de!"), int(n))) for n in rng.integers(0, 900, 40)] + ["x" * 300 + "ab cd " * 40, "ab cd " * 20 + "q" * 77]
    whole = [net.score(t) for t in made]
    monkeypatch.setattr(byte_cnn, "CHUNK", 48)
    assert [net.score(t) for t in made] == pytest.approx(whole, abs=1e-5)  # sums of floats in another order


# --- 8, 9, 10 ---------------------------------------------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(400):
        v = centres[k % 12] + rng.normal(size=16) * (0.15 if k % 2 else 0.5)
        rows.append((k, [float(np.float32(x)) for x in v], k % 3))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0] * 16, None), (504, rows[0][1], 0), (505, rows[0][1], 0), (506, [1.0, None, *[1.0] * 14], 1)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=16).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = sorted(unit)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    links = sum(got[i]["n_links"] for i in got)
    assert 0.97 * 2 * len(pairs) <= links <= 2 * len(pairs)
    want = union_find(label, pairs)
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.99 * len(got)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (500, 501, 502, 503, 506)) and got[504]["component_id"] == 0


def test_near_vectors_in_one_large_set(spark):
    """A chain of near vectors and a cluster, larger than a block: no link between any two of a set is missed."""
    angle = np.arange(300) * 0.05
    rows = [(int(k), [float(np.cos(a)), float(np.sin(a)), 0.0], 7) for k, a in enumerate(angle[:50])]
    rng = np.random.default_rng(9)
    rows += [(1000 + k, [float(x) for x in np.array([0, 0, 1.0]) + rng.normal(size=3) * 0.02], 7) for k in range(250)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=32).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    pairs = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.93]
    want = union_find(unit, pairs)
    assert all(got[i]["component_id"] == want[i] and got[i]["n_links"] == sum(i in p for p in pairs) for i in unit)


def test_near_vectors_odd_cases(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(5, a, "x"), (5, a, "x"), (5, b, "x"), (None, a, "x"), (None, b, "y"), (2, [1.0, 0.0, 0.0], "x"), (3, a, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 AS node", "2 AS key", "3 AS bucket", "4 AS n")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, 5, False), (2, 0, 2, True), (3, 0, 3, True), (5, 0, 5, True), (5, 2, 5, True), (5, 2, 5, True)]
    assert embedding_dedup.near_vectors(df.limit(0)).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_near_vectors_of_nothing(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def strip_brute(docs):
    first = {}
    for i, w in docs:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    out = {}
    for i, w in docs:
        bad = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                bad[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(bad), " ".join(x for x, y in zip(w, bad, strict=True) if not y))
    return out


def test_passages(spark, texts, documents):
    import re

    want = strip_brute([(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.strip(documents).collect()}
    assert got == want and any(n for _, n, _ in want.values())


def test_passages_odd_cases(spark):
    got = {}
    for r in substring_dedup.strip(docs_of(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert got[1] == [(0, 0)] and got[5] == [(3, 0)] * 2 and got[3] == [(12000, 0)] and got[8] == [(12001, 12000)]
    assert substring_dedup.strip(docs_of(spark).limit(0)).count() == 0


def test_gap_code():
    for values in ([], [0], [254, 255, 255, 256, 70000], [1 << 61, 1 << 62], sorted(np.random.default_rng(1).integers(0, 10**6, 500).tolist())):
        a = np.array(values, np.uint64)
        assert substring_dedup.from_gaps(substring_dedup.gaps(a), len(a)).tolist() == values


@pytest.mark.parametrize("windows", [1e3, 1e8, 5e9, 1e13])
def test_sketch_keeps_its_selectivity(windows):
    sketch = substring_dedup.Sketch(windows, 8)
    passing = (1 - np.exp(-windows / 2.0**sketch.bits)) ** substring_dedup.DEPTH
    assert passing < 0.05 and windows / 2**sketch.shard_bits <= substring_dedup.SHARD


def test_passages_in_many_chunks(spark, texts, documents, monkeypatch):
    import re

    monkeypatch.setattr(substring_dedup, "SHARD", 1 << 12)
    want = strip_brute([(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.strip(documents, chunk=3000).collect()} == want


def test_passages_of_a_table_from_a_shuffle(spark, texts, documents):
    again = documents.repartition(5)
    rows = lambda df: sorted(map(tuple, substring_dedup.strip(df, chunk=20_000).collect()), key=str)
    assert rows(again) == rows(documents)


def test_an_input_that_changes_is_an_error(spark):
    import os

    import pyarrow as pa

    def turned(batches):  # other rows come first each time
        for b in batches:
            k = int.from_bytes(os.urandom(4)) % len(b)
            yield pa.RecordBatch.from_struct_array(pa.concat_arrays([b.slice(k).to_struct_array(), b.slice(0, k).to_struct_array()]))

    docs = spark.range(0, 3000, 1, 2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), x -> cast(x + id % 7 AS string))) AS text").mapInArrow(turned, "doc_id long, text string")
    with pytest.raises(Exception, match="write the table first"):
        substring_dedup.strip(docs, chunk=20_000).collect()


def test_words_that_look_alike_are_told_apart():
    data = np.frombuffer(b"a a\0 a\0\0 abcdefghijklmno abcdefghijklmnop abcdefghijklmnoq \x0f a\n", np.uint8)
    one, two = substring_dedup.word_hashes(data, *substring_dedup.words_of(data))
    assert len(one) == 8 and len(set(one.tolist())) == len(set(two.tolist())) == 7


@pytest.mark.parametrize("text", ["", "\\", "###", "####", "\\### x </turn>", "</turn></turn>\n### user: ", "\\h\\t\\c\\\\", ": :"])
def test_template_is_reversible(text):
    turns = [("user", text), ("assistant", text), ("odd: role\\###", text), ("assistant", "é" + text)]
    out, spans = chat.write(turns)
    assert chat.read(out) == turns
    assert "".join(chat.unescape(out[a:b]) for a, b in spans) == text + "é" + text
    assert out.count("###") == len(turns) and out.count("</turn>") == len(turns)


def test_layouts(spark):
    a = spark.createDataFrame([(1, "hi", "you", "hello")], "id long, instruction string, input string, output string")
    assert [tuple(t) for t in chat.canonical(a, "id").first()["turns"]] == [("user", "hi"), ("user", "you"), ("assistant", "hello")]
    b = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in chat.canonical(b, "id").first()["turns"]] == [("user", "q"), ("assistant", "")]
    rows = [(1, '{"prompt": "p", "completion": "c", "other": [1]}'), (2, '{"messages": [{"role": "user", "content": "x"}]}'), (3, '{"data": {"prompt": "n", "response": "m"}}'), (4, "no json"), (5, None), (6, '{"unknown": 1}')]
    got = chat.canonical_json(spark.createDataFrame(rows, "id long, raw string"), "id", "raw")
    names = {r["conv"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in got.collect()}
    assert names[1] == ("prompt and completion", [("user", "p"), ("assistant", "c")]) and names[2][1] == [("user", "x")]
    assert names[3][1] == [("user", "n"), ("assistant", "m")] and all(names[k] == (None, []) for k in (4, 5, 6))
    assert chat.read_back(chat.formatted(got)).count() == 6
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, 2)], "id long, z int"), "id")


def test_roles_of_rows_stay(spark):
    df = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.formatted(chat.canonical(df, "conv_id"))).first()
    assert r["turns_sha256"] == hashlib.sha256(b"human\na\ngpt\nb\nassistant\nc\n").hexdigest() and r["loss_sha256"] == hashlib.sha256(b"c").hexdigest()


def test_turn_rows_with_nulls(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "a"), (None, 0, "user", "b"), (2, 0, "assistant", "c"), (2, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r for r in chat.read_back(chat.formatted(chat.canonical(df, "conv_id"))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\na\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == 0
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256(b"cc").hexdigest() and got[None]["n_turns"] == 1
    assert chat.read_back(chat.formatted(chat.canonical(df.limit(0), "conv_id"))).count() == 0


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, documents):
    import corpus_pipeline as pipeline

    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == documents.columns, name
        before, after = {r["doc_id"] for r in docs.collect()}, [r["doc_id"] for r in out.collect()]
        assert set(after) <= before and after, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "exact dedup":
            assert docs.select("text").distinct().count() == docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count()
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, pipeline.run(spark, SMALL).collect()))


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls, empty and long texts, repeated ids and rows, clashing columns, no rows at all."""
    import corpus_pipeline as pipeline

    odd = docs_of(spark).selectExpr("*", "1 AS id", "2 AS digest", "3 AS size", "4 AS row", "5 AS __sha")
    for (name, stage), least in zip(pipeline.STAGES, (1, 6, 5, 1, 9), strict=True):  # 6 different texts, two of them without words
        got, none = stage(spark, odd, SMALL), stage(spark, odd.limit(0), SMALL)
        assert got.count() >= least and none.count() == 0, name
        if stage is not pipeline.STAGES[-1][1]:
            assert got.columns == none.columns == odd.columns, name

"""The training-data operators against brute force, the libraries and SQL; odd inputs have defined results."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from laborlens.llm import bpe, decontaminate, huffman, maxent, queries, simhash, suffix, topk, toxicity, url_filter, warc
from laborlens.llm.common import Scratch, table

SMALL = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(300)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE, LONG = sentence(60), "x" * 3000 + sentence(4000)
#: NULL ids and texts, empty and very long texts, repeated rows, ties; columns whose names clash.
ODD = [(1, PASSAGE + " a"), (2, PASSAGE + " b"), (3, None), (4, ""), (5, LONG), (5, LONG), (None, sentence(50)),
       (7, "one"), (8, "é ü 一二 😀 \t\n x"), (9, PASSAGE + " a"), (10, LONG + " z"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "f", 7) for i, t in ODD], "doc_id long, text string, fingerprint string, ids int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, fingerprint string, ids int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# toxicity

def test_toxicity_finds_held_out_insults(spark):
    texts = [(i, f"{sentence(30)} {'vile' if i % 4 == 0 else 'kind'} {sentence(9)} {'wicked!' if i % 8 == 0 else ''}")
             for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    grades = spark.createDataFrame([(i, (i % 4 == 0) + (i % 8 == 0)) for i in range(0, 400)] + [(None, 1), (3, None)],
                                   "doc_id long, grade int")
    model = toxicity.train(docs, grades)
    assert np.all(np.diff(model.thresholds) > 0)
    found = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert [found[i].severity_grade for i in range(400, 600)] == [(i % 4 == 0) + (i % 8 == 0) for i in range(400, 600)]
    assert all(found[i].rejected == (i % 4 == 0) for i in range(400, 600))
    assert found[408].expected_severity > found[404].expected_severity > found[401].expected_severity


def test_toxicity_odd_rows(spark, odd, nothing):
    model = toxicity.Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([1.0]))
    found = toxicity.severity(odd.withColumn("rejected", F.lit("old")), model)
    assert found.count() == len(ODD) and dict(found.dtypes)["rejected"] == "boolean"
    assert toxicity.severity(nothing, model).count() == 0
    empty = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, grade int"))
    assert not toxicity.severity(odd, empty).where("rejected").count()


# near copies

def slow_fingerprint(text):
    found = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(marks):
    near = {a: {b for b in marks if bin(marks[a] ^ marks[b]).count("1") <= 3} for a in marks}
    out = {}
    for a in sorted(marks):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        out[a] = min(seen)
    return out


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_fingerprint_links_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    marks = []
    for _ in range(12):
        base = RNG.getrandbits(64)
        marks.append(base)
        for _ in range(8):
            for b in RNG.sample(range(64), RNG.randint(1, 4)):
                base ^= 1 << b
            marks.append(base)
    df = spark.createDataFrame([(m - (m >> 63 << 64),) for m in marks], "fingerprint long")
    found = {m: m for m in marks}

    def root(x):
        return x if found[x] == x else root(found[x])

    for a, b in simhash.links(df).collect():
        found[root(a % 2**64)] = root(b % 2**64)
    want = classes({m: m for m in marks})
    assert len({(root(m), want[m]) for m in marks}) == len({root(m) for m in marks}) == len(set(want.values()))


def test_near_duplicates(spark, odd, nothing):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {d: slow_fingerprint(t) for d, t in texts.items()}
    want = classes(marks)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r.fingerprint for d, r in found.items()} == {d: f"{m:016x}" for d, m in marks.items()}
    assert {d: r.component_id for d, r in found.items()} == want
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.component_id == 3 for r in got if r.fingerprint == "0" * 16 and r.doc_id in (3, 4))
    assert {r.component_id for r in got if r.doc_id in (1, 9)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0


# language model

def test_language_model(spark, odd, nothing):
    docs = table(spark, SMALL, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    count = collections.Counter()
    for d, t in texts:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update([*(t or "").encode().lower().split(), None])
    total, kinds = sum(count.values()), len(count)
    found = {r.doc_id: r for r in maxent.score(docs).collect()}
    for d, t in texts:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens)
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in count for w in tokens), total)
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
    out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert maxent.score(odd).count() == len(ODD) and maxent.score(nothing).count() == 0


def test_language_model_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(1, 50, 300))[::-1]
    each, inside = maxent._offsets(n, int(n.sum()) + 100, 350)
    words = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    model = maxent.Model(words, n, np.arange(300), int(n.sum()) + 100, 350, each, inside,
                         rng.normal(size=(maxent.CLASS_ROWS, maxent.CLASSES + 1)).astype(np.float32),
                         rng.normal(size=(maxent.WORD_ROWS, inside.shape[1])).astype(np.float32))
    features = tuple(np.full(301, h, np.uint64) << np.uint64(50) for h in (3, 5, 9))
    rank = np.append(np.arange(300), maxent.HEAD)
    gain = maxent.Steps(model).run(rank, features, False)
    share = np.append((n + 1) / (model.total + model.distinct + 1), 0)
    share[-1] = 1 - share.sum()
    assert (share * np.exp(gain)).sum() == pytest.approx(1, abs=1e-4)


# repeated strings

def brute_repeats(docs):
    seen, out = set(), []
    for d, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                cover[i:i + 100] = b"\1" * 100
            seen.add(b[i:i + 100])
        kept = bytes(c for c, m in zip(b, cover) if not m)
        runs = sum(cover[i] and not (i and cover[i - 1]) for i in range(len(b)))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_repeats_equal_brute_force(spark, hot):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    want = brute_repeats(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert sorted(map(tuple, suffix.report(suffix.remove_repeats(docs, hot=hot)).collect())) == want


def test_repeats_odd_rows(spark, odd, nothing):
    texts = [(1, "a" * 500), (2, "a" * 99), (3, None), (4, ""), (5, "ab" * 400), (6, PASSAGE + "é" * 200), (7, PASSAGE)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, suffix.report(suffix.remove_repeats(docs)).collect())) == brute_repeats(texts)
    found = suffix.remove_repeats(odd).collect()
    assert len(found) == len(ODD)
    assert sorted(r.n_removed == r.n_bytes for r in found if r.doc_id == 5) == [False, True]
    assert suffix.remove_repeats(nothing).count() == 0
    assert {r.text for r in suffix.clean_texts(docs).where("doc_id = 7").collect()} == {""}


def test_suffix_array_and_prefixes():
    for n in range(60):
        x = "".join(RNG.choice("ab" if n % 3 else "abcdefg") for _ in range(RNG.randint(0, 200))).encode()
        order = suffix.suffix_array(np.frombuffer(x, np.uint8), 16)
        starts = [x[i:i + 16] for i in order]
        assert sorted(order) == list(range(len(x))) and starts == sorted(starts)


# top k

def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=24).round(1).tolist()) for i in range(400)]
    vectors += [(400, vectors[0][1]), (401, None), (402, [None] * 24), (403, [float("nan")] * 24), (None, vectors[1][1]),
                (450, [1e6] * 24), (451, [1e6] * 24), (452, [0.5])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, rank int")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors
             if i is not None and v and not any(x is None or x != x for x in v)}
    want = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole
                            if c != q and len(whole[c]) == len(whole[q]))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert rows(topk.exact_top_k(df)) == sorted(want, key=repr)
    assert topk.exact_top_k(df.limit(0)).count() == 0


# decontamination

def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    for _ in range(50):
        a, b = (np.array([RNG.randint(0, 4) for _ in range(RNG.randint(1, 15))]) for _ in range(2))
        assert decontaminate.smith_waterman(a, b)[0] == slow_alignment(a, b)


def test_contaminated(spark, odd, nothing):
    item = sentence(40)
    edited = item.split()
    edited[5], edited[20] = "other", "words"
    del edited[30]
    docs = [(1, sentence(200) + " " + item.upper().replace(" ", ", ") + " " + sentence(90)),
            (2, sentence(50) + " " + " ".join(edited)), (3, sentence(300)), (4, None), (5, ""), (6, item), (6, item), (None, item)]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, score int")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, sentence(30)), (14, "zz yy")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, items).collect()]
    assert sorted(found, key=repr) == sorted([(1, 10), (2, 10), (6, 10), (6, 10), (None, 10)], key=repr)
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


# byte pairs

def random_texts(n):
    kinds = ["ab", "abc ", "  \n\tab1.'sé", "theandign", "一二éá ", "😀a  .", "'tsrvem l", "Å İßǅ½ a"]
    out = []
    for _ in range(n):
        kind = RNG.choice(kinds)
        text = "".join(RNG.choice(kind) for _ in range(RNG.randint(0, 60)))
        out.append(text + ("<|endoftext|>" + text if RNG.random() < .1 else ""))
    return out


@pytest.mark.parametrize("part", [bpe.PART, 7])
def test_byte_pairs_equal_the_library(spark, part):
    library = Tokenizer.from_file(BYTE)
    texts = list(enumerate([*random_texts(150), None, "", "x" * 4000, "ab" * 900 + " c", sentence(300)]))
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, ids int")
    encoded = bpe.encode(docs, BYTE, part=part)
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    assert found == want
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect()}
    assert back == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}


def test_byte_pairs_odd_rows(odd, nothing):
    assert bpe.encode(odd, BYTE, part=50).count() == len(ODD) and bpe.encode(nothing, BYTE).count() == 0


# id files

def test_codes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        counts = rng.zipf(1.3, n).astype(np.int64)
        for limit in (int(n).bit_length(), 20):
            lengths = huffman.code_lengths(counts, max(2, limit))
            assert lengths.min() > 0 and (2.0 ** -lengths.astype(float)).sum() <= 1 + 1e-12
        ids = rng.integers(0, n, 5000).astype("<u4")
        sizes = np.array([0, 1, 0, 2999, 2000, 0])
        payload, end, _ = huffman.encode_rows(ids, sizes, lengths, huffman.canonical(lengths))
        assert (huffman.Decoder(lengths).decode(payload, np.append(0, end[:-1]) * 8, sizes) == ids).all()


@pytest.mark.parametrize("bucket", [huffman.BUCKET_IDS, 500])
def test_id_files(spark, monkeypatch, bucket):
    monkeypatch.setattr(huffman, "BUCKET_IDS", bucket)
    library = Tokenizer.from_file(WORD)
    texts = list(enumerate([*random_texts(150), None, "", "y" * 9000, sentence(1500)]))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want, before = [], 0
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted(map(tuple, huffman.id_file_report(docs, WORD).collect())) == want


def test_id_files_odd_rows(odd, nothing):
    found = huffman.id_file_report(odd, WORD).collect()
    assert len(found) == len(ODD) and {r.start for r in found if r.doc_id is None} >= {0}
    assert huffman.id_file_report(nothing, WORD).count() == 0


# URLs and archives

def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "HTTP://Ex.Org", 0), (3, "HTTP://Ex.Org", 0), (4, "://a.b/c?d", 0),
                                   (5, "http://x.a.b/c/d#e", 0), (None, "http://listed/one", 0)], "page_id long, url string, rule int")
    rules = spark.createDataFrame([("a.b", "/c", "block"), ("b", "/", "allow"), ("a.b", "/c/d", "allow"), (None, "/", "block")],
                                  "host string, path string, verdict string")
    listed = spark.createDataFrame([("ftp://LISTED/one?x",), (None,)], "url string")
    found = url_filter.url_filter(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")
    assert rows(found) == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "ex.org", "", None, "allow"), (3, "ex.org", "", None, "allow"),
        (4, "a.b", "/c", "a.b/c", "block"), (5, "x.a.b", "/c/d", "a.b/c/d", "allow"), (None, "listed", "/one", None, "block")], key=repr)
    assert url_filter.url_filter(pages, rules.limit(0), listed.limit(0)).where("verdict = 'allow'").count() == 7
    assert url_filter.url_filter(pages.limit(0), rules, listed).count() == 0
    plan = url_filter.url_filter(pages, rules, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_archives(spark):
    pages = [(3, "http://a\r\nb c", "same\r\n\r\nWARC/1.1 text"), (1, None, "same\r\n\r\nWARC/1.1 text"), (2, "u", None), (4, "u", ""),
             (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "u", "same\r\n\r\nWARC/1.1 text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = Scratch(spark, "test").path("w")
    warc.write_archives(df, path, record="html")
    found = warc.resolve_archives(warc.read_archives(spark, path))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found.collect()}
    assert got == {(1, 21, "response", None), (3, 21, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2),
                   (5, 10000, "response", None), (None, 21, "response", None)}
    assert {r.payload for r in found.where("record_type = 'response'").collect()} == {t or "" for _, _, t in pages}
    warc.write_archives(df, path + "2", record="html", min_bytes=22)
    assert not warc.read_archives(spark, path + "2").where("record_type = 'revisit'").count()
    warc.write_archives(df.limit(0), path + "3", record="html")
    assert warc.read_archives(spark, path + "3").count() == 0


@pytest.mark.parametrize("name", list(queries.oracles()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(queries.oracles()[name])
    found = queries.queries()[name](spark, SMALL)
    assert sorted(found.columns) == sorted(want.columns) and found.count() > 0
    assert rows(found.select(want.columns)) == sorted(want.fetchall(), key=repr)


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    first = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    scores = {r.doc_id: r.rejected for r in queries.op1_toxicity(spark, SMALL).collect()}
    assert {r.doc_id for r in first.collect()} == {d for d, rejected in scores.items() if not rejected}
    texts = {r.doc_id: r.text for r in first.collect()}
    want = classes({d: slow_fingerprint(t) for d, t in texts.items()})
    second = corpus_pipeline.drop_near_copies(spark, first, SMALL)
    assert {r.doc_id for r in second.collect()} == {d for d, c in want.items() if c == d}
    third = corpus_pipeline.cut_repeats(spark, second, SMALL)
    kept = {r.doc_id: r.text for r in third.collect()}
    for d, n, removed, _, digest in brute_repeats(sorted((d, texts[d]) for d in set(want.values()))):
        assert d in kept or removed
        if not removed:
            assert hashlib.sha256(kept[d].encode()).hexdigest() == digest
    last = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "ids", "n_tokens"} <= set(last.columns) and 0 < last.count() <= docs.count()
    assert third.columns == docs.columns and [n for n, _ in corpus_pipeline.STAGES][-1] == "bpe_encoding"

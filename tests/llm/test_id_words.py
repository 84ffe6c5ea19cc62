"""A worker's words: a full memory is left alone, and batches for Python are bounded in bytes."""

import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laborlens.llm import huffman

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_full_memory_takes_nothing_more(monkeypatch):
    monkeypatch.setattr(huffman, "MEMORY", 3000)
    words = ["".join(w) for w in itertools.product(("ba", "É", "nor"), ("Ti", "ö"), ("sh", "ent", "ç"), ("", ".", "1?"))]
    texts = [" ".join(words[:20]), None, " ".join(words[20:] + words[:5]), "", "\u00a0x \u4e2d\u6587 " + " ".join(words)]
    encoder, library = huffman.WordEncoder(WORD), Tokenizer.from_file(WORD)
    encoder.encode(pa.array(texts[:1]))
    learn, learnt = huffman.Memory.learn, []

    def counted(self, chunk, ids):
        learnt.append(chunk)
        learn(self, chunk, ids)

    monkeypatch.setattr(huffman.Memory, "learn", counted)
    for _ in range(3):
        ids, count = encoder.encode(pa.array(texts))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == list(itertools.chain(*want)) and count.tolist() == list(map(len, want))
        assert encoder.bare.size <= 3000 and encoder.odd.size <= 3000
    learnt.clear()
    encoder.encode(pa.array([t and t.lower() + " " + " ".join(w + "zan" for w in words if w.isalpha()) for t in texts]))
    assert len(learnt) <= 3          # one each time a memory is asked: it does not fit and goes again


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    name, _ = huffman.BATCH
    before = spark.conf.get(name)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    with huffman.small_batches(spark):
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 2 and max(found) < 5 << 20 and spark.conf.get(name) == before


def test_codes_cross_64_bits():
    lengths = np.array([1, 2, 40, 40, 3], np.uint8)
    codes = np.array([0, 0b10, 0xF000000001, 0xF123456789, 0b110])
    rng = np.random.default_rng(1)
    ids, count = rng.integers(0, 5, 400).astype("<u4"), np.array([0, 7, 0, 390, 3, 0])
    payload, end, _ = huffman.encode_rows(ids, count, lengths, codes)
    want, at = b"", 0
    for n, upto in zip(count, end):
        bits = "".join(f"{codes[i]:0{lengths[i]}b}" for i in ids[at:at + n])
        at += n
        want += int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")
        assert len(want) == upto
    assert payload == want

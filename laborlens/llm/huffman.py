"""Token ids as files: canonical length-limited Huffman codes, blocks with bit-offset checkpoints.

A file is a row of blocks. A block: magic, header, tables, payload.
  header   bucket u32, documents u32, checkpoints u32, payload bytes u32, first id's index in the bucket u64
  tables   doc ids i64, has an id u8, ids per document u32, byte where the document starts u32,
           then the bit offset u64 of every CHECKPOINT-th id of each document
Documents start at a byte; every checkpoint can be decoded by itself, and all of a block's are
decoded in step, one table lookup for each id. The code lengths lie in a file of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.bpe import byte_letters
from laborlens.llm.common import Scratch, pieces

MAX_BITS = 20
CHECKPOINT = 512
MAGIC, END = b"HFB1", "HFBE"
HEADER = "<IIIIQ"
BUCKET_IDS = 4_000_000    # ids of one bucket of neighbouring documents
BLOCK_BYTES = 1 << 20
MEMORY = 32 << 20         # bytes that a worker keeps of words, and as much of other chunks
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"     # between Spark and a worker; both hold one
ENTRY = 200               # bytes of an entry besides its text and ids: two headers and the place in the table


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits (package-merge); 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, is_leaf = np.zeros(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        is_leaf.append(rank < len(leaves))
        merged = merged[rank]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, number = 2 * len(leaves) - 2, np.zeros(len(leaves) + 1, np.int64)
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        number[0] += 1
        number[chosen] -= 1
        take = 2 * (take - chosen)
    lengths[order] = np.cumsum(number)[:-1]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = int(lengths.max(initial=1))
    step = 1 << (width - lengths[order].astype(np.int64))
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (np.cumsum(step) - step) >> (width - lengths[order].astype(np.int64))
    return codes


class Decoder:
    """A table by the next ``width`` bits: the symbol, whose length moves on to the next."""

    def __init__(self, lengths: np.ndarray):
        self.width = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spread = 1 << (self.width - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.width, np.int64)
        self.symbol[:int(spread.sum())] = np.repeat(order, spread)
        self.lengths = lengths.astype(np.int64)

    def decode(self, payload: bytes, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of segments that start at bits ``at``, count[i] each, one after the other."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8)
        window = np.zeros(len(data) - 4, np.int64)             # 40 bits from each byte on
        for i in range(5):
            window <<= 8
            window |= data[i:len(data) - 4 + i]
        shift, mask = 40 - self.width, (1 << self.width) - 1
        order = np.argsort(-count, kind="stable")
        pos, left = at[order].astype(np.int64), count[order]
        first = (np.cumsum(count) - count)[order]
        out = np.zeros(int(count.sum()), np.uint32)
        live = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")
        for t, n in enumerate(live.tolist()):
            p = pos[:n]
            look = window.take(p >> 3)
            look >>= shift - (p & 7)
            look &= mask
            symbol = self.symbol.take(look)
            out[first[:n] + t] = symbol
            p += self.lengths.take(symbol)
        return out


def encode_rows(ids: np.ndarray, count: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple:
    """Payload of rows of ids (count[i] each), the byte where each row ends, and the bit in the row of each id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    last = np.append(0, end)[np.cumsum(count)]
    row_bits = np.diff(np.append(0, last))
    row_bytes = -(-row_bits // 8)
    row_end = np.cumsum(row_bytes)
    inside = end - size - np.repeat(last - row_bits, count)
    bit = inside + np.repeat((row_end - row_bytes) * 8, count)
    total = int(row_end[-1]) if len(row_end) else 0
    word, over = bit >> 6, (bit & 63) + size - 64            # of 64 bits; the code's bits in the next word
    code, spill = codes[ids].astype(np.uint64), np.flatnonzero(over > 0)
    main = code << np.maximum(-over, 0).astype(np.uint64)
    main[spill] >>= over[spill].astype(np.uint64)
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    payload = np.zeros(total // 8 + 2, np.uint64)
    if len(ids):
        payload[word[begin]] = np.bitwise_or.reduceat(main, begin)
        payload[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return payload.astype(">u8").tobytes()[:total], row_end, inside


class Memory(dict[str, bytes]):
    """ids of chunks, with a bound in bytes; what was learnt last goes first, as frequent chunks come early."""

    size = 0

    def learn(self, chunk: str, ids: bytes) -> None:
        if chunk not in self:
            self.size += ENTRY + 2 * len(chunk) + len(ids)
            self[chunk] = ids

    def forget(self, limit: int) -> None:
        while self.size > limit and self:
            chunk, ids = self.popitem()
            self.size -= ENTRY + 2 * len(chunk) + len(ids)

    def look_up(self, chunks: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of different chunks; new ones are encoded together and kept while there is room."""
        found = list(map(self.get, chunks))
        new = [c for c, ids in zip(chunks, found) if ids is None]
        if new:
            learnt = encode(new)
            left = iter(learnt)
            found = [next(left) if ids is None else ids for ids in found]
            for chunk, ids in zip(new, learnt):
                if self.size >= MEMORY:
                    break
                self.learn(chunk, ids)
            self.forget(MEMORY)
        return found


class WordEncoder:
    """ids of a tokenizer file that lower-cases and drops white space, word by word from a memory.

    Cutting at ASCII white space is safe for such a file: neither its normal form nor a token crosses it.
    Words of letters below U+0250 are remembered without their case and the marks after them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare, self.odd = Memory(), Memory()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>")
                              for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))])
        self.quick = Tokenizer(self.tokenizer.model)            # words that need no normal form or cutting
        self.quick.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shape = r"\A(?P<word>[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+)(?P<tail>[.,;:!?|%&$#*-]*)\z"

    def _quick_ids(self, words: list[str]) -> list[bytes]:
        """ids of bare words, of which many are encoded at once."""
        found = []
        for lo in range(0, len(words), 512):
            part = words[lo:lo + 512]
            line = "\n".join([w if w.isascii() else byte_letters(w) for w in part])
            ids = np.array(self.quick.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()       # a bare word is one piece and ends once
            if len(cut) != len(part):
                raise ValueError("a bare word is not one piece in this tokenizer file")
            ids = ids.tobytes()
            found += [ids[i:j] for i, j in zip([0, *cut], cut)]
        return found

    def _odd_ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, one after the other, and how many each has."""
        shape = pc.extract_regex(chunks, self.shape)
        words = pc.utf8_lower(shape.field("word").filter(shape.is_valid())).dictionary_encode()
        tails = shape.field("tail").filter(shape.is_valid()).dictionary_encode()
        n_words, n_tails = len(words.dictionary), len(tails.dictionary)
        found = self.bare.look_up(_strings(words.dictionary), self._quick_ids)
        found += self.odd.look_up(_strings(tails.dictionary), self._odd_ids)
        found += self.odd.look_up(_strings(chunks.filter(shape.is_null())), self._odd_ids)
        empty = len(found)          # a chunk is a word and its tail, or an odd chunk and nothing
        pair = np.full((len(chunks), 2), empty)
        is_word = shape.is_valid().to_numpy(zero_copy_only=False)
        pair[is_word, 0] = words.indices.to_numpy()
        pair[is_word, 1] = tails.indices.to_numpy() + n_words
        pair[~is_word, 0] = np.arange(n_words + n_tails, empty)
        size = np.append(np.fromiter(map(len, found), np.int64, empty) // 4, 0)
        ids = _take_runs(np.frombuffer(b"".join(found), "<u4"), size, pair.ravel())
        return ids, size[pair].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (NULL: none), one text after the other, and how many each has."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        upto = np.cumsum(pc.list_value_length(cut).to_numpy())
        chunks = cut.flatten().dictionary_encode()
        del cut
        table, size = self._ids_of(chunks.dictionary)
        which = chunks.indices.to_numpy()
        last = np.append(0, np.cumsum(size[which]))[upto]
        return _take_runs(table, size, which), np.diff(last, prepend=0)


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()       # many times faster than to_pylist


def _take_runs(table: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Runs of a table (size[i] values each, one after the other), in the order that ``which`` names them."""
    count = size[which]
    end = np.cumsum(count)
    at = np.repeat((np.cumsum(size) - size)[which] - (end - count), count)
    at += np.arange(len(at))
    return table.take(at)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile pass Python batches bounded in bytes: 10,000 long rows would fill every worker."""
    name, most = BATCH
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tokenize(docs: DataFrame, tokenizer: str, end: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32 bits) with ``end`` appended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            ids, count = word_encoder(tokenizer).encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(count), end).astype("<u4")
            count = count + 1
            edge = np.append(0, np.cumsum(count))
            data = memoryview(ids).cast("B")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(
                [data[4 * a:4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame) -> DataFrame:
    """id, n over all rows; each task sends one row for each id it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in pieces(batches, "ids", 1 << 22):
            ids = np.frombuffer(b"".join(x.as_py() or b"" for x in batch.column("ids")), "<u4")
            found = np.bincount(ids, minlength=len(total))
            found[:len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write rows (doc_id, n_tokens, ids) in ascending doc_id order (NULL first) below ``path``.

    Repeated ids keep their rows, in the order of their ids' bytes. The number of symbols bounds the
    table of counts that the driver sees. An empty table writes no block.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens).collect()
    dense = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        dense[r["id"]] = r["n"]
    lengths = code_lengths(dense)
    codes = canonical(lengths)
    stored = spark.createDataFrame([(bytearray(zlib.compress(lengths.tobytes())),)], "value binary")
    stored.selectExpr("cast(value as string) as value").coalesce(1).write.option("lineSep", END).text(f"{path}/code")

    buckets = max(1, -(-int(dense.sum()) // BUCKET_IDS))
    share = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(tokens.approxQuantile("doc_id", share, 0.1 / buckets))) if share else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 1 << 20):
            count = batch.column("n_tokens").to_numpy()
            ids = np.frombuffer(b"".join(x.as_py() for x in batch.column("ids")), "<u4")
            payload, end, inside = encode_rows(ids, count, lengths, codes)
            start = np.append(0, end[:-1])
            marks = -(-count // CHECKPOINT)
            which = np.arange(marks.sum()) - np.repeat(np.cumsum(marks) - marks, marks)
            at = inside[np.repeat(np.cumsum(count) - count, marks) + which * CHECKPOINT].astype("<u8").tobytes()
            edge = np.append(0, np.cumsum(marks)) * 8
            bucket = np.searchsorted(np.array(bounds), np.array(
                [-np.inf if d is None else d for d in batch.column("doc_id").to_pylist()]), "left") if bounds \
                else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), batch.column("doc_id"), batch.column("n_tokens"),
                 pa.array([at[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary()),
                 pa.array([payload[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())],
                ["bucket", "doc_id", "n_tokens", "marks", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, bucket, first = 0, None, 0

        def out() -> pa.RecordBatch:
            n = np.array([h[2] for h in held], "<u4")
            body = b"".join(h[4] for h in held)
            starts = np.cumsum([0] + [len(h[4]) for h in held][:-1]).astype("<u4")
            marks = b"".join(h[3] for h in held)
            head = struct.pack(HEADER, bucket, len(held), len(marks) // 8, len(body), first)
            table = np.array([h[1] or 0 for h in held], "<i8").tobytes() + \
                np.array([h[1] is not None for h in held], np.uint8).tobytes() + n.tobytes() + starts.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([MAGIC + head + table + marks + body], pa.binary())], ["value"])

        for batch in pieces(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != bucket or size + len(row[4]) > BLOCK_BYTES):
                    yield out()
                    first += sum(h[2] for h in held)
                    held, size = [], 0
                if row[0] != bucket:
                    bucket, first = row[0], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    packed = tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        pack, "bucket int, doc_id long, n_tokens long, marks binary, payload binary")
    ordered = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "payload")
    ordered.mapInArrow(blocks, "value binary").selectExpr("cast(value as string) as value") \
        .write.option("lineSep", END).text(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """bucket, doc_id, start (in its bucket), n_tokens, ids of every document in the files."""
    code = spark.read.format("binaryFile").load(f"{path}/code").where("length > 0").select("content").first()
    lengths = np.frombuffer(zlib.decompress(code[0][:-len(END)]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for item in batch.column("content"):
                content, at = item.as_buffer(), 0
                view = memoryview(content)
                while at < len(view):
                    if view[at:at + 4] != MAGIC:
                        raise ValueError(f"no block starts at byte {at}")
                    bucket, n, marks, size, first = struct.unpack_from(HEADER, view, at + 4)
                    p = at + 4 + struct.calcsize(HEADER)
                    ids = np.frombuffer(view[p:p + 8 * n], "<i8")
                    has = np.frombuffer(view[p + 8 * n:p + 9 * n], np.uint8)
                    count = np.frombuffer(view[p + 9 * n:p + 13 * n], "<u4").astype(np.int64)
                    start = np.frombuffer(view[p + 13 * n:p + 17 * n], "<u4").astype(np.int64)
                    bits = np.frombuffer(view[p + 17 * n:p + 17 * n + 8 * marks], "<u8").astype(np.int64)
                    body = bytes(view[p + 17 * n + 8 * marks:p + 17 * n + 8 * marks + size])
                    each = -(-count // CHECKPOINT)
                    last = np.cumsum(each) - 1
                    segment = np.full(marks, CHECKPOINT)
                    segment[last[each > 0]] = (count - (each - 1) * CHECKPOINT)[each > 0]
                    found = decoder.decode(body, bits + np.repeat(start * 8, each), segment).astype("<u4").tobytes()
                    edge = np.append(0, np.cumsum(count))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, bucket, np.int32)), pa.array(ids, mask=has == 0), pa.array(first + edge[:-1]),
                         pa.array(count), pa.array([found[4 * a:4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())],
                                                   pa.binary())], ["bucket", "doc_id", "start", "n_tokens", "ids"])
                    at = p + 17 * n + 8 * marks + size + len(END)

    files = spark.read.format("binaryFile").load(f"{path}/blocks").where("length > 0").select("content")
    return files.mapInArrow(run, "bucket int, doc_id long, start long, n_tokens long, ids binary")


def with_starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Turn the start in a bucket into the number of ids of all documents before; sizes: bucket, n (one row each)."""
    before, total = {}, 0
    for r in sizes.orderBy("bucket").collect():       # one row for each 4 million ids
        before[r["bucket"]] = total
        total += r["n"]
    lift = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "bucket int, before long")
    return rows.join(lift, "bucket").withColumn("start", F.col("start") + F.col("before")).drop("bucket", "before")


def id_file_report(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of every document as the files have it.

    NULL or empty texts have the end id alone; NULL ids come first; repeated ids each have a row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    with small_batches(spark):
        tokens = scratch.save(tokenize(docs, tokenizer, end), "tokens")
        write_ids(tokens, scratch.path("files"))
        scratch.drop("tokens")
        ids = read_blocks(spark, scratch.path("files"))
        read = scratch.save(ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "read")
    return with_starts(read, read.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))) \
        .select("doc_id", "start", "n_tokens", "ids_crc32")

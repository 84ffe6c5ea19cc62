"""Removal of long repeats: every byte that an earlier string of WIDTH bytes covers.

1. Each text is cut at anchors: the K-gram with the smallest hash of every WIDTH bytes. Equal strings of
   WIDTH bytes have equal anchors, so only anchors (3 % of the positions) are shuffled, with a hash of
   all strings that belong to them. Equal hashes are repeats at once; a task sends each pair once.
2. Anchors that occur with different surroundings are contested: the bytes around them meet by anchor
   and are sorted as suffixes in two stages. Only suffixes smaller than their successors are sorted
   directly; scans of the buckets induce the rest; adjacent common prefixes of WIDTH or more are repeats.
3. The repeats of each text are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import Scratch, flat, pieces
from laborlens.llm.words import BASE, BYTE, mix

WIDTH, K = 100, 28
SLICE = 1 << 19                # bytes handled at once; the place in it has PLACE bits
PLACE = 22
HOT = 20_000                   # contested places of one anchor that are sorted in one piece
CHUNK = 1 << 21                # bytes whose suffixes are sorted at once
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPLIT = 0xFF                   # a byte that no UTF-8 text has: between the pieces of a suffix array


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(SLICE * 2, BASE), _powers(SLICE * 2, INVERSE)


def anchors(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of the strings of ``width`` bytes inside texts that end at ``ends``, by common anchor: anchor hash, hash of
    all its strings, first start, anchor's offset from it, number of strings."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    up, down = (_UP, _DOWN) if n <= len(_UP) else (_powers(n, BASE), _powers(n, INVERSE))
    place = max(PLACE, int(n).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=sums[1:])
    gram = mix((sums[k:] - sums[:-k]) * down[:n - k + 1])
    low = np.uint64((1 << place) - 1)
    ranked = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = width - k + 1
    least, reach = ranked, 1
    while reach * 2 <= span:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if reach < span:
        least = np.minimum(least[:len(ranked) - span + 1], least[span - reach:])
    anchor = (least & low).astype(np.int64)
    starts = np.arange(n - width + 1)
    cut = np.zeros(n + 1, np.int64)
    np.add.at(cut, ends[ends < n], 1)
    text = np.cumsum(cut)
    whole = text[starts] == text[starts + width - 1]   # strings that lie in one text
    starts, anchor = starts[whole], anchor[whole]
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(starts) != 1)))
    first, count = starts[new], np.diff(np.append(new, len(starts)))
    offset = anchor[new] - first
    stop = first + count - 1 + width
    inside = (sums[stop] - sums[first]) * down[first]
    context = mix(inside + np.uint64(0x9E3779B97F4A7C15) * (offset * 128 + count).astype(np.uint64))
    return gram[anchor[new]], context, first, offset, count


def _first_of(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _united(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each doc, sorted and without overlaps."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    group = np.cumsum(_first_of(doc)) - 1
    far = int(b.max()) + 1
    top = np.maximum.accumulate(b + group * far) - group * far
    new = _first_of(doc)
    new[1:] |= a[1:] > top[:-1]
    start = np.flatnonzero(new)
    return doc[start], a[start], np.append(top[start[1:] - 1], top[-1])


#: Rows between the steps: anchors (1), contested anchors (2), repeats (0: a to b).
KINDS = "kind byte, anchor long, context long, doc long, a int, b int"


def _rows(kind: int, anchor, context, doc, a, b) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
         pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
        ["kind", "anchor", "context", "doc", "a", "b"])


def _repeats(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    doc, a, b = _united(doc, a, b)
    return _rows(0, doc, np.zeros(len(doc), np.int64), doc, a, b)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SLICE):
        data, offsets = flat(batch.column("text"))
        anchor, context, first, offset, count = anchors(data, offsets[1:])
        row = np.searchsorted(offsets, first, "right") - 1
        doc, start = batch.column("doc").to_numpy()[row], first - offsets[row]
        order = np.lexsort((start, doc, context, anchor))
        anchor, context, doc, start, code = (x[order] for x in (anchor, context, doc, start, offset * 128 + count))
        new = _first_of(anchor, context)
        yield _rows(1, anchor[new], context[new], doc[new], start[new], code[new])
        old = ~new
        yield _repeats(doc[old], start[old], start[old] + (code[old] & 127) - 1 + WIDTH)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, anchor, context, doc, a), in a stream: only the last first-of-its-kind is held."""
    held: list[np.ndarray] | None = None
    linked = False
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == 0).any():
            yield batch.filter(pa.array(kind == 0))
        if not (kind == 1).any():
            continue
        rows = [batch.column(c).to_numpy()[kind == 1] for c in ("anchor", "context", "doc", "a", "b")]
        if held:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        anchor, context, doc, a, b = rows
        new = _first_of(anchor, context)
        old = ~new
        yield _repeats(doc[old], a[old].astype(np.int64), a[old].astype(np.int64) + (b[old] & 127) - 1 + WIDTH)
        reps = np.flatnonzero(new)
        same = anchor[reps][1:] == anchor[reps][:-1]
        contested = np.append(linked, same) | np.append(same, False)
        known, linked_next = contested[:-1], bool(np.append(linked, same)[-1])
        at = reps[:-1][known]
        yield _rows(2, anchor[at], context[at], doc[at], a[at], b[at])
        held, linked = [r[reps[-1]:reps[-1] + 1] for r in rows], linked_next
    if held and linked:
        yield _rows(2, *held)


def suffix_array(data: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Starts of the suffixes of bytes, in the order of their first ``depth`` bytes at least.

    Two stages: suffixes smaller than their successor are sorted directly, bucket by bucket of their
    first byte. A scan of the buckets from the smallest then puts each larger suffix, by its first
    byte, behind those already there when its successor is passed.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    change[-1] = -1                                        # the end is smaller than any byte
    settled = np.where(change != 0, np.arange(n), n)
    small = change[np.minimum.accumulate(settled[::-1])[::-1]] > 0

    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    word = np.zeros(n + depth + 8, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i:n + depth + 8 + i]
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(word[direct], kind="stable")]
    new = _first_of(word[direct])
    for at in range(8, depth + 1, 8):
        # what still ties is sorted by the next eight bytes, inside its group
        group = np.cumsum(new) - 1
        tied = ~new | ~np.append(new[1:], True)
        place = np.flatnonzero(tied)
        if not len(place):
            break
        key = word[np.minimum(direct[place] + at, n + depth)]
        order = np.lexsort((key, group[place]))
        direct[place] = direct[place[order]]
        key = key[order]
        new[place] |= _first_of(group[place], key)

    first = data[direct]
    direct_of = np.searchsorted(first, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(suffixes: np.ndarray) -> None:
        """Give the larger suffixes whose successors are passed, in this order, to their buckets."""
        before = suffixes[suffixes > 0] - 1
        before = before[~small[before]]
        letter = data[before]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        edges = np.flatnonzero(_first_of(letter))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(letter)).tolist()):
            larger[letter[a]].append(before[a:b])

    induce(np.array([n]))                                  # the last suffix follows from the end
    out = []
    for byte in range(256):
        done = 0
        while done < len(larger[byte]):                    # a run of one byte induces into its own bucket
            part = larger[byte][done]
            done += 1
            out.append(part)
            induce(part)
        part = direct[direct_of[byte]:direct_of[byte + 1]]
        if len(part):
            out.append(part)
            induce(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int = WIDTH) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the order, up to ``limit``; first: 0."""
    n = len(data)
    padded = np.concatenate([data, np.full(limit + 8, SPLIT, np.uint8)])
    word = np.zeros(n + limit, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i:n + limit + i]
    length = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, limit, 8):
        differ = word[order[live - 1] + at] ^ word[order[live] + at]
        equal = differ == 0
        length[live[equal]] = at + 8
        part = live[~equal]
        top = differ[~equal]
        zeros = np.zeros(len(part), np.int64)
        for i in range(1, 8):
            zeros += (top >> np.uint64(64 - 8 * i)) == 0
        length[part] = at + zeros
        live = live[equal]
    return np.minimum(length, limit)


def repeated_strings(text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``width`` bytes start earlier in ``text`` too, and places that are the first of their bytes."""
    order = suffix_array(text, width)
    new = common_prefixes(text, order, width) < width
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    lowest = np.minimum.reduceat(order, start) if len(start) else start
    again = order != lowest[group]
    return order[again], order[~again]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each contested place: rows (anchor, part, doc, a, piece)."""
    for batch in pieces(batches, "text", SLICE):
        data, offsets = flat(batch.column("text"))
        lists = batch.column("places")
        size = np.diff(lists.offsets.to_numpy())
        found = lists.flatten()
        anchor, part, a, b = (found.field(c).to_numpy() for c in ("anchor", "part", "a", "b"))
        row = np.repeat(np.arange(batch.num_rows), size)
        lo = offsets[row] + a
        hi = lo + (b & 127) - 1 + WIDTH
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(part), pa.array(batch.column("doc").to_numpy()[row]), pa.array(a),
             pa.array([raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())], pa.binary())],
            ["anchor", "part", "doc", "a", "piece"])


def _sort_pieces(firsts: bool):
    """Repeats among the pieces of each (anchor, part); rows come sorted by (anchor, part, doc, a).

    With ``firsts`` also a row (3) for each string that is the first of its kind in its part: its hash and place.
    """
    def handle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        if firsts:      # parts of one anchor may come together: the earlier place first
            table = table.sort_by([("anchor", "ascending"), ("doc", "ascending"), ("a", "ascending")])
        data, offsets = flat(table.column("piece"))
        doc, a = table.column("doc").to_numpy(), table.column("a").to_numpy()
        size = np.diff(offsets)
        # a byte that no text has after each piece
        start = offsets[:-1] + np.arange(len(size))
        text = np.full(len(data) + len(size), SPLIT, np.uint8)
        keep = np.ones(len(text), bool)
        keep[start + size] = False
        text[keep] = data
        again, first = repeated_strings(text)

        def place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row = np.searchsorted(start, at, "right") - 1
            good = at + WIDTH <= start[row] + size[row]
            at, row = at[good], row[good]
            return at, doc[row], a[row] + at - start[row]

        at, d, where = place(again)
        yield _repeats(d, where, where + WIDTH)
        if firsts:
            at, d, where = place(first)
            sums = np.zeros(len(text) + 1, np.uint64)
            up, down = _powers(len(text), BASE), _powers(len(text), INVERSE)
            np.cumsum(BYTE[text] * up, out=sums[1:])
            one = mix((sums[at + WIDTH] - sums[at]) * down[at])
            np.cumsum(mix(BYTE[text]) * up, out=sums[1:])
            two = mix((sums[at + WIDTH] - sums[at]) * down[at])
            yield _rows(3, one, two, d, where, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in pieces(batches, "piece", CHUNK // 8):
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = whole.column("anchor").to_numpy(), whole.column("part").to_numpy()
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from handle([whole.slice(0, cut)])
            held, size = [whole.slice(cut)], whole.slice(cut).nbytes
        if held and sum(b.num_rows for b in held):
            yield from handle(held)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (two hashes, doc, place) all but the first of each string are repeats."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in ("anchor", "context", "doc", "a")]
        if held:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        old = ~_first_of(rows[0], rows[1])
        start = rows[3][old].astype(np.int64)
        yield _repeats(rows[2][old], start, start + WIDTH)
        held = [r[-1:] for r in rows[:2]] + [np.array([-1]), np.array([-1], np.int32)]


def keyed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The rows with ``doc``, which orders the rows by id; equal to the id where ids are distinct and not NULL."""
    shape = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if shape["n"] == shape["ids"]:
        return docs.withColumn("doc", F.col("doc_id"))
    ordered = docs.repartitionByRange(max(1, shape["n"] // 100_000), F.asc_nulls_last("doc_id"), F.xxhash64("text")) \
        .sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return scratch.save(ordered.withColumn("doc", F.monotonically_increasing_id()), "keyed")


def repeats(scratch: Scratch, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, spans: array of (a, b) in order of a: the bytes of each text (doc, text) that are repeats; they may overlap."""
    place = ["kind", "anchor", "context", "doc", "a"]
    found = docs.mapInArrow(_find_anchors, KINDS)
    compared = scratch.save(found.repartition("anchor").sortWithinPartitions(*place).mapInArrow(_compare, KINDS), "compared")
    contested = compared.where("kind = 2")
    parts = contested.groupBy("anchor").count().where(F.col("count") > hot) \
        .select("anchor", F.ceil(F.col("count") / hot).alias("parts"))
    many = parts.limit(1).count() > 0
    # a place gets its part before its bytes are cut out, so that bytes are shuffled once
    part = F.pmod(F.xxhash64("doc", "a"), F.col("parts"))
    placed = contested.join(parts, "anchor", "left").withColumn("part", F.coalesce(part, F.lit(-1))) if many else \
        contested.withColumn("part", F.lit(-1).cast("long"))
    asked = placed.groupBy("doc").agg(F.collect_list(F.struct("anchor", "part", "a", "b")).alias("places"))
    dealt = docs.join(asked, "doc").select("doc", "text", "places").mapInArrow(
        _segments, "anchor long, part long, doc long, a int, piece binary")

    def sort(rows: DataFrame, firsts: bool) -> DataFrame:
        return rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc", "a").select(
            "anchor", "part", "doc", "a", "piece").mapInArrow(_sort_pieces(firsts), KINDS)

    done = sort(dealt.where("part < 0") if many else dealt, False)
    if many:        # an anchor in too many places is sorted in parts, whose first strings then meet
        hot_rows = scratch.save(sort(dealt.where("part >= 0"), True), "hot")
        again = hot_rows.where("kind = 3").repartition("anchor", "context").sortWithinPartitions(
            "anchor", "context", "doc", "a").mapInArrow(_later, KINDS)
        done = done.union(hot_rows.where("kind = 0")).union(again)
    spans = compared.where("kind = 0").union(done).select("doc", "a", "b")
    return spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text", hot: int = HOT,
                   also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and the columns ``also``: each row without its repeats.

    A byte goes if a string of WIDTH bytes covers it that also starts earlier: in a smaller id, or before
    in the same text. NULL and empty texts and those shorter than WIDTH stay as they are. Rows with equal
    ids follow the order of a hash of their texts, rows with a NULL id come after all others; each row has
    its result. Other columns do not matter; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = keyed(scratch, docs.select(F.col(id_).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *also))
    rows = scratch.bucketed(rows, "texts", "doc")           # two joins by doc follow
    spans = scratch.save(repeats(scratch, rows.select("doc", "text"), hot), "spans")
    scratch.drop("compared", "hot")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            kept, counts = [], []
            for text_, found in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw, out, at, runs = text_.as_py().encode(), [], 0, 0
                top = -1
                for s in found or ():
                    if s["a"] > top:
                        out.append(raw[max(at, 0):s["a"]])
                        runs += 1
                    top = at = max(top, s["b"])
                out.append(raw[at:])
                kept.append(b"".join(out))
                counts.append((len(raw), len(raw) - len(kept[-1]), runs))
            n, removed, runs = (pa.array(x, pa.int64()) for x in zip(*counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, removed, runs, pa.array(kept, pa.binary()), *map(batch.column, also)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *also])

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in also)
    return rows.join(spans, "doc", "left").select("doc_id", "text", "spans", *also).mapInArrow(
        cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{kinds}")


def whole_characters(kept: pa.Array) -> pa.Array:
    """Texts of what is kept; the rest of a character that was cut through goes too."""
    return pa.array([None if x is None else x.as_py().decode("utf-8", "ignore") for x in kept], pa.string())


def clean_texts(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without its repeats, n_bytes, n_removed and the columns ``also``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), whole_characters(batch.column("kept")), batch.column("n_bytes"),
                 batch.column("n_removed"), *map(batch.column, also)], ["doc_id", "text", "n_bytes", "n_removed", *also])

    kept = remove_repeats(docs, also=also)
    kinds = "".join(f", `{c}` {kept.schema[c].dataType.simpleString()}" for c in also)
    return kept.mapInArrow(run, f"doc_id long, text string, n_bytes long, n_removed long{kinds}")


def report(kept: DataFrame) -> DataFrame:
    """The rows of remove_repeats with a digest of what is kept."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

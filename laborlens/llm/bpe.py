"""Byte-pair encoding of whole texts by tree concatenation, and decoding.

A text is cut where its encoding cannot depend on what is on the other side: before a space that
follows a solid character. These chunks are encoded once per worker and looked up afterwards.
Text without such a place for long is cut at its words as the tokenizer sees them, and a word that
is still too long is halved anywhere: its parts are encoded in parallel tasks and joined in a
tree, each join re-encoding a growing window until the window's first token is the left side's and
its last token the right side's. A sequence is a BPE encoding exactly if every two neighbours are,
so agreement at both ends of an encoded window proves the whole.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import pieces

PART = 1 << 16            # characters that one task encodes at once; longer texts go to several
CACHE = 240_000           # chunks, and words, that a worker remembers
SHORT = 200               # longer chunks are not remembered
WINDOW = 4                # tokens on each side of a join at first

#: Two characters that forbid the quick way of cutting: white space before a space.
_UNSAFE = tuple(c + " " for c in map(chr, range(0x3001)) if c.isspace())
_SAFE = re.compile(r"(?<=\S)(?= )")
#: The letter that byte-level files write for a byte: itself where printable, else the next from U+0100.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(
    b for b in range(256) if b not in _PRINTED)}
_LETTERS = {b: c for b, c in LETTER.items() if b != 10}
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_letters(text: str) -> str:
    """The letters of a text's bytes; line feeds stay as they are."""
    return text if text.isascii() and " " not in text else text.encode().decode("latin-1").translate(_LETTERS)


def make_room(known: dict, more: int, limit: int) -> None:
    """Forget what was learnt last if ``more`` entries pass the limit: frequent entries come early and stay."""
    if len(known) + more > limit:
        while len(known) > limit // 2:
            known.popitem()


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """A byte-level tokenizer file of the tokenizers library, with the same results for whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)       # no cutting into words: one run of bytes
        self.quick = Tokenizer(self.tokenizer.model)       # runs that stand in lines
        self.quick.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shape = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?|%&$#*-]*)\Z")
        self.bare: dict[str, bytes] = {}
        self.split = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        byte_of = {c: b for b, c in LETTER.items()}
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        raw = [t.encode() if t in self.added else bytes(byte_of[c] for c in t) for t in self.token]
        self.length = np.array([len(b) for b in raw], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def _learn(self, known: dict[str, bytes], asked: set[str], before: str) -> dict[str, bytes]:
        """ids of the chunks; short ones stay in ``known``."""
        new = sorted(asked.difference(known))
        if len(known) + len(new) > CACHE:
            make_room(known, len(new), CACHE)
            new = sorted(asked.difference(known))
        if before:      # mostly a word of letters and marks after it: two runs, the word known without the marks
            self._learn_words({m[1] for m in map(self.shape.match, new) if m})
            marks: dict[str, bytes] = {"": b""}
            odd = []
            for c in new:
                if m := self.shape.match(c):
                    word, tail = m.groups()
                    if tail not in marks:
                        marks[tail] = packed(self.tokenizer.encode(tail, add_special_tokens=False).ids)
                    known[c] = self.bare[word] + marks[tail]
                else:
                    odd.append(c)
            new = odd
        for c, e in zip(new, self.tokenizer.encode_batch_fast([before + c for c in new], add_special_tokens=False)):
            known[c] = packed(e.ids)
        return known

    def _learn_words(self, words: set[str]) -> None:
        """ids of a space and a word of letters."""
        make_room(self.bare, len(words), CACHE)
        new = sorted(words.difference(self.bare))
        for lo in range(0, len(new), 512):
            part = new[lo:lo + 512]
            line = "\n".join([" " + w for w in part])
            ids = np.array(self.quick.encode_batch_fast([byte_letters(line)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cut = np.searchsorted(np.cumsum(self.length[ids]), ends) + 1
            ids = ids.tobytes()
            for word, i, j in zip(part, [0, *cut[:-1].tolist()], cut.tolist()):
                self.bare[word] = ids[4 * i:4 * j]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian 32-bit integers."""
        cut = []
        for text in texts:
            if text[:1] == " " or any(u in text for u in (_UNSAFE[:10] if text.isascii() else _UNSAFE)):
                cut.append((None, _SAFE.split(text)))
            else:
                first, *rest = text.split(" ")
                cut.append((first, rest))
        spaced = self._learn(self.spaced, set(itertools.chain.from_iterable(r for f, r in cut if f is not None)), " ")
        plain = self._learn(self.plain, {f for f, _ in cut if f is not None}
                            | set(itertools.chain.from_iterable(r for f, r in cut if f is None)), "")
        out = [b"".join(map(plain.__getitem__, r)) if f is None else plain[f] + b"".join(map(spaced.__getitem__, r))
               for f, r in cut]
        for known in (spaced, plain):
            for c in [c for c in itertools.islice(reversed(known), 5000) if len(c) > SHORT]:
                del known[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.offset[ids] - (end - length), length)
        return self.data[at].tobytes()

    def parts(self, text: str, part: int) -> list[tuple[bool, bool, str]]:
        """Cut a text into (is a run of bytes, continues the part before, text) of about ``part`` characters."""
        out: list[tuple[bool, bool, str]] = []
        held: list[str] = []
        for chunk in _SAFE.split(text):
            if held and len(held[-1]) + len(chunk) <= part:
                held[-1] += chunk
            elif len(chunk) <= part:
                held.append(chunk)
            else:
                out += [(False, False, h) for h in held]
                held = []
                for piece in self.marks.split(chunk) if self.marks else [chunk]:
                    if piece in self.added:
                        out.append((False, False, piece))
                    elif piece:
                        for word, _ in self.split.pre_tokenize_str(piece):
                            out += self._halved(word, part)
        return out + [(False, False, h) for h in held]

    def _halved(self, word: str, part: int) -> list[tuple[bool, bool, str]]:
        if len(word) <= part:
            return [(True, False, word)]
        pieces_ = 1 << (-(-len(word) // part) - 1).bit_length()
        cuts = [len(word) * i // pieces_ for i in range(pieces_ + 1)]
        return [(True, i > 0, word[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def encode_part(self, run: bool, text: str) -> list[int]:
        if run:
            return self.model.encode(text, add_special_tokens=False).ids
        return np.frombuffer(self.encode([text])[0], "<u4").tolist()

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring runs of bytes from the encodings of both."""
        if not left or not right:
            return left + right
        k = WINDOW
        while True:
            a, b = left[-k:], right[:k]
            new = self.model.encode("".join(self.token[i] for i in a + b), add_special_tokens=False).ids
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return left[:len(left) - len(a)] + new + right[len(b):]
            k *= 2

    def tree(self, runs: list[list[int]]) -> list[int]:
        """Join neighbouring runs pair by pair, then the pairs, up to one."""
        while len(runs) > 1:
            runs = [self.join(*runs[i:i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0] if runs else []


def encode(docs: DataFrame, tokenizer: str, text: str = "text", part: int = PART) -> DataFrame:
    """The rows with a binary column ``ids`` (little-endian 32-bit) in place of the text.

    NULL and empty texts have no ids; a column named ids is replaced; repeated rows stay repeated.
    Texts of more than ``part`` characters are cut, encoded by several tasks and joined again.
    """
    names = [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(*names, F.coalesce(text, F.lit("")).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            ids = encoder(tokenizer).encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([text]).columns, pa.array(ids, pa.binary())],
                                             [*names, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            for i, uid in enumerate(batch.column("__uid").to_pylist()):
                found = encoder(tokenizer).parts(batch.column(text)[i].as_py(), part)
                for lo in range(0, len(found), 1000):
                    run, glued, piece = zip(*found[lo:lo + 1000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * len(run)), pa.array(range(lo, lo + len(run)), pa.int64()), pa.array(run),
                         pa.array(glued), pa.array(piece)], ["uid", "n", "run", "glued", "piece"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "piece", part):
            ids = [packed(encoder(tokenizer).encode_part(r, p))
                   for r, p in zip(batch.column("run").to_pylist(), batch.column("piece").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["piece", "run"]).columns, pa.array(ids, pa.binary())],
                                             ["uid", "n", "glued", "ids"])

    def concatenate(found: pa.Table) -> pa.Table:
        found = found.sort_by("n")
        made = encoder(tokenizer)
        out, runs = [], []
        for glued, ids in zip(found.column("glued").to_pylist(), found.column("ids").to_pylist()):
            if not glued:
                out.append(packed(made.tree(runs)))
                runs = []
            runs.append(np.frombuffer(ids, "<u4").tolist())
        out.append(packed(made.tree(runs)))
        return pa.table({"__uid": found.column("uid").slice(0, 1), "ids": pa.array([b"".join(out)], pa.binary())})

    size = F.length(text)
    brief = rows.where(size <= part).mapInArrow(short, f"{kinds}{', ' if kinds else ''}ids binary")
    large = rows.withColumn("__uid", F.monotonically_increasing_id()).where(size > part)
    parts = large.select("__uid", text).mapInArrow(cut, "uid long, n long, run boolean, glued boolean, piece string") \
        .repartition("uid", "n").mapInArrow(encode_parts, "uid long, n long, glued boolean, ids binary")
    whole = parts.groupBy("uid").applyInArrow(concatenate, "__uid long, ids binary")
    return brief.unionByName(large.drop(text).join(whole, "__uid").drop("__uid"))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their ids (special tokens included) in place of the ids; NULL ids: ''."""
    names = [c for c in encoded.columns if c not in (text, ids)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ids):
            texts = [encoder(tokenizer).decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([ids]).columns, pa.array(texts, pa.string())],
                                             [*names, text])

    return encoded.select(*names, ids).mapInArrow(run, f"{kinds}{', ' if kinds else ''}{text} string")


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows (doc_id, ids), by decoding them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids"):
            found = [x.as_py() for x in batch.column("ids")]
            texts = [encoder(tokenizer).decode(np.frombuffer(x, "<u4")) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

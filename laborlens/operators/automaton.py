"""All entries of a lexicon in one pass over the texts: a multi-pattern automaton on Arrow's bytes.

The patterns' bytes are a trie whose missing steps are filled in from its failure links, so that a text costs one
table step a byte whatever the size of the lexicon. The bytes of many texts are walked side by side: they are cut into
lanes, each warmed up by as many bytes as the longest pattern has, and one step moves all lanes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LANE = 512
PIECE = 1 << 21              # bytes walked at once
TABLE_BYTES = 32 << 20       # of one automaton's steps; a larger lexicon is several automata in the same pass
BETWEEN = 0xFF               # a byte that no UTF-8 text has: after each text
WORD = np.zeros(256, bool)   # what a word boundary counts as a part of a word
for _part in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789_"):
    WORD[list(_part)] = True
AFTER = WORD.copy()          # what must not follow where 'c++' and 'c#' are tokens
AFTER[list(b"+#")] = True


class Automaton(NamedTuple):
    kinds: np.ndarray        # of each byte; 0: in no pattern
    steps: np.ndarray        # state x kind -> state
    own: np.ndarray          # pattern that ends at a state, or -1
    link: np.ndarray         # next shorter state at which a pattern ends, or 0
    sizes: np.ndarray        # of the patterns
    longest: int


def build(patterns: list[bytes]) -> Automaton:
    """The automaton of distinct patterns, none empty."""
    used = sorted(set(b"".join(patterns)))
    kinds = np.zeros(256, np.uint8)
    kinds[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    children: list[dict[int, int]] = [{}]
    own = [-1]
    levels: list[list[tuple[int, int, int]]] = []
    for number, pattern in enumerate(patterns):
        state = 0
        for depth, byte in enumerate(pattern):
            after = children[state].get(byte)
            if after is None:
                after = len(children)
                children[state][byte] = after
                children.append({})
                own.append(-1)
                if depth == len(levels):
                    levels.append([])
                levels[depth].append((state, int(kinds[byte]), after))
            state = after
        own[state] = number
    steps = np.zeros((len(children), width), np.int32)
    fail, link, ends = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32), np.array(own) >= 0
    for depth, level in enumerate(levels):
        parent, kind, child = np.array(level).T
        if depth:
            fail[child] = steps[fail[parent], kind]
        # steps of the failure state (a shallower one, complete by now) hold where the trie has none
        link[child] = np.where(ends[fail[child]], fail[child], link[fail[child]])
        steps[parent, kind] = child
        steps[child] = steps[fail[child]]
    return Automaton(kinds, steps, np.array(own, np.int32), link, np.array([len(p) for p in patterns]), len(levels))


def find(automaton: Automaton, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of every pattern in bytes: its end (exclusive) and the pattern."""
    warm, width = automaton.longest, automaton.steps.shape[1]
    lanes = -(-len(text) // LANE)
    padded = np.full(warm + lanes * LANE, BETWEEN, np.uint8)
    padded[warm:warm + len(text)] = text
    rows = np.lib.stride_tricks.as_strided(padded, (lanes, LANE + warm), (LANE, 1))
    kinds = np.ascontiguousarray(automaton.kinds[rows].T)
    steps, hit = automaton.steps.ravel(), (automaton.own >= 0) | (automaton.link > 0)
    state, ends, states = np.zeros(lanes, np.int32), [], []
    for t in range(LANE + warm):
        state = steps[state * width + kinds[t]]
        if t >= warm:
            at = np.flatnonzero(hit[state])
            if len(at):
                ends.append(at * LANE + (t - warm + 1))
                states.append(state[at])
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    state = np.concatenate(states) if states else np.zeros(0, np.int32)
    found_end, found = [], []
    while len(state):
        pattern = automaton.own[state]
        found_end.append(end[pattern >= 0])
        found.append(pattern[pattern >= 0])
        end, state = end[automaton.link[state] > 0], automaton.link[state][automaton.link[state] > 0]
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_end), np.concatenate(found)) if found else (none, none)


def _blocks(patterns: list[bytes]) -> Iterator[list[bytes]]:
    """Patterns in blocks whose steps stay below TABLE_BYTES."""
    width, block, size = 4 * (len(set(b"".join(patterns))) + 1), [], 0
    for pattern in sorted(patterns):
        if block and (size + len(pattern)) * width > TABLE_BYTES:
            yield block
            block, size = [], 0
        block.append(pattern)
        size += len(pattern)
    if block:
        yield block


def match(texts: DataFrame, patterns: list[str], key: str, column: str, boundary: str = "faithful") -> DataFrame:
    """(key, skill) for every pattern that occurs in a text between boundaries; no shuffle.

    'faithful': a word boundary before and after; 'token': no word character before, and none, nor + or #, after. NULL
    and empty texts have no match, nor do empty patterns; each row of ``texts`` has its own matches.
    """
    machines = [(build(block), pa.array([p.decode() for p in block]))
                for block in _blocks(list({p.encode() for p in patterns if p}))]

    def whole_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``data`` has a byte that is no text before its first and after its last."""
        before, first, last, after = data[start - 1], data[start], data[end - 1], data[end]
        if boundary == "token":
            return ~WORD[before] & ~AFTER[after]
        return (WORD[before] != WORD[first]) & (WORD[last] != WORD[after])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends, lo = np.cumsum(sizes, dtype=np.int64), 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + PIECE, "right")))
                yield found(batch.slice(lo, hi - lo))
                lo = hi

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
        raw = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        # one byte that no text has before the first and after each text
        starts = offsets[:-1] - offsets[0] + np.arange(len(held)) + 1
        stops = offsets[1:] - offsets[0] + np.arange(len(held)) + 1
        data = np.full(len(raw) + len(held) + 1, BETWEEN, np.uint8)
        keep = np.ones(len(data), bool)
        keep[0], keep[stops] = False, False
        data[keep] = raw
        rows, names = [], []
        for machine, title in machines:
            end, pattern = find(machine, data)
            good = whole_words(data, end - machine.sizes[pattern], end)
            row = np.searchsorted(starts, end[good] - 1, "right") - 1
            both = np.unique(row * len(title) + pattern[good])
            rows.append(both // len(title))
            names.append(title.take(pa.array(both % len(title))))
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        skill = pa.concat_arrays(names) if names else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), skill], [key, "skill"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, column).mapInArrow(run, f"`{key}` {kind}, skill string")

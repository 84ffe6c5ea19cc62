"""Spelling variants: words one edit apart, found by a frontier that walks a trie of all words as joins.

The edge table of the trie holds (depth, node, letter, child): a node is the hash of a prefix. A state is
(word, what is left of it, node, edits). Level by level the frontier of one depth is joined with the edges of
that depth; a state without an edit meets every edge of its node, one with its edit the edge of its next
letter. A state dies where the child has no edge for what is left; one with nothing left is a neighbour.

One edit leaves the first or the second half of a word whole, so the trie is walked twice, over words and over
reversed words, and a word enters at the node of its half: the crowded nodes near the root are never
searched. An edit is made where the two words first differ, so a neighbour is reached once in each trie. The
edges of a node are one for each letter at most; many words of one node are split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import Scratch, lower_ascii

RUN = r"[A-Za-zÀ-ÿ]{%d,}+"          # whole runs of so many letters at least
LEAST_LENGTH, LEAST_COUNT, RATIO, NOISE = 7, 2, 10, 31
#: Longer words meet by the hash of a half and their length, as an edge with all the rest: no level for each letter.
LONG = 32


def word_counts(docs: DataFrame, id_: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z in lower case, of at least ``least_length`` code points.

    Where ``noise`` divides the crc32 h of "<id>:<run>", the run loses its code point h % length. A NULL text has no
    words, a NULL id counts as an empty string.
    """
    runs = docs.select(F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN % least_length), F.lit(0))).alias("run"))
    # translating is dear, and few runs have a capital
    plain = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(lower_ascii(F.col("run")))
    h = runs.select("doc", plain.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = F.col("h") % F.length("run")
    less = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
    # too short: NULL, which is not counted; a filter here would compute all of this twice
    word = F.when(F.col("h") % noise != 0, F.col("run")).when(F.length("run") > least_length, less)
    return h.select(word.alias("word")).groupBy("word").agg(F.count("word").alias("n")).where(F.col("n") >= least_count)


def _node(turn: Column, prefix: Column) -> Column:
    return F.xxhash64(turn, prefix)


def _bits(code: Column) -> tuple[Column, Column]:
    """A letter as one bit of two longs: a to z, and the letters from code point 192."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (F.when(code.between(97, 122), F.call_function("shiftleft", one, code - 97)).otherwise(none),
            F.when(code.between(192, 255), F.call_function("shiftleft", one, code - 192)).otherwise(none))


def _turned(words: DataFrame) -> DataFrame:
    """id, s, size, enter: every word and its reverse, and the depth at which its walk begins."""
    both = words.select("id", "word", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    size = F.length("word")
    return both.select("id", "turn", F.when(F.col("turn") == 0, F.col("word")).otherwise(F.reverse("word")).alias("s"),
                       size.alias("size"),
                       F.when(F.col("turn") == 0, F.floor(size / 2)).otherwise(F.ceil(size / 2)).cast("int").alias("enter"))


def edge_table(turned: DataFrame) -> DataFrame:
    """depth, node, letter, child, low, high (the letters after child), ends (child is a word).

    Only edges that words of a length one less or more can reach: those from a word's half on.
    """
    first = F.when(F.col("turn") == 0, F.floor((F.col("size") - 1) / 2)).otherwise(F.ceil((F.col("size") - 1) / 2))
    at = turned.select("turn", "s", "size", F.explode(F.sequence(first.cast("int"), F.col("size") - 1)).alias("depth"))
    low, high = _bits(F.ascii(F.substr("s", F.col("depth") + 2, F.lit(1))))
    steps = at.select("depth", _node(F.col("turn"), F.substr("s", F.lit(1), F.col("depth"))).alias("node"),
                      F.ascii(F.substr("s", F.col("depth") + 1, F.lit(1))).alias("letter"),
                      _node(F.col("turn"), F.substr("s", F.lit(1), F.col("depth") + 1)).alias("child"),
                      low.alias("low"), high.alias("high"), (F.col("depth") + 1 == F.col("size")).alias("ends"))
    return steps.groupBy("depth", "node", "letter", "child").agg(
        F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), F.max("ends").alias("ends"))


def _starts(turned: DataFrame) -> DataFrame:
    """depth, id, node, rest: the states without an edit, which are on a word's own path."""
    at = turned.select("id", "turn", "s", F.explode(F.sequence("enter", "size")).alias("depth"))
    return at.select("depth", "id", _node(F.col("turn"), F.substr("s", F.lit(1), F.col("depth"))).alias("node"),
                     F.substr("s", F.col("depth") + 1).alias("rest"))


def _advance(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """id, node, rest: the states with one edit that one level leads to; nothing left: the node is a neighbour."""
    rest = F.col("rest")
    letters = [F.ascii(F.substr(rest, F.lit(i), F.lit(1))).alias(f"c{i}") for i in (1, 2, 3)]    # 0 beyond the end
    met = frontier.select("id", "node", "rest", "edits", *letters).join(
        edges.select("node", "letter", "child", "low", "high", "ends"), "node")
    one, two, three = F.col("c1"), F.col("c2"), F.col("c3")
    here, made = F.col("letter") == one, F.col("edits") == 1

    def goes_on(code: Column) -> Column:
        low, high = _bits(code)
        return F.when(code == 0, F.col("ends")).otherwise(
            F.col("low").bitwiseAND(low) + F.col("high").bitwiseAND(high) != 0)

    met = met.where(here | ~made).select(
        "id", F.col("child").alias("node"), "rest", "c1",
        # the edit is made, and the next letter leads on; or another letter stands in place of the next
        ((made | ~here) & (one != 0) & goes_on(two)).alias("replaced"),
        # the last letter goes; the next letter goes and the one after it leads on
        (~made & here & F.col("ends") & (two != 0) & (three == 0)).alias("last"),
        (~made & ~here & (two != 0) & (F.col("letter") == two) & goes_on(three)).alias("dropped"),
        # a letter more
        (~made & ~here & goes_on(one)).alias("added")).where("replaced or last or dropped or added")
    ways = F.array(F.when(F.col("replaced"), F.substr(rest, F.lit(2))), F.when(F.col("last"), F.lit("")),
                   F.when(F.col("dropped"), F.substr(rest, F.lit(3))), F.when(F.col("added"), rest))
    return met.select("id", "node", F.explode(ways).alias("rest")).where("rest is not null")


def _long_pairs(words: DataFrame) -> DataFrame:
    """id, other: pairs of words of at least LONG letters that are one edit apart: one edge holds all the rest."""
    turned = _turned(words.where(F.length("word") >= LONG))
    states = turned.select(
        "id", _node(F.col("turn"), F.substr("s", F.lit(1), F.col("enter"))).alias("node"), F.col("s").alias("mine"),
        F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    # where words of a length one less, equal or one more enter
    half = F.when(F.col("turn") == 0, F.lit(0)).otherwise(F.lit(1))
    enters = F.array_distinct(F.array(*[F.floor((F.col("size") + d + half) / 2).cast("int") for d in (-1, 0, 1)]))
    edges = turned.select(F.col("id").alias("other"), "turn", "size", F.col("s").alias("theirs"),
                          F.explode(enters).alias("depth"))
    edges = edges.select("other", "size", "theirs", _node(F.col("turn"), F.substr("theirs", F.lit(1), F.col("depth"))).alias("node"))
    return (states.join(edges, ["node", "size"]).where(F.levenshtein("mine", "theirs", 1) == 1)
            .select("id", "other"))


def neighbours(scratch: Scratch, words: DataFrame) -> DataFrame:
    """id, other: every ordered pair of words (id, word) that differ by one inserted, deleted or replaced code point."""
    short = words.where(F.length("word") <= LONG)
    turned = scratch.save(_turned(short), "turned")
    edges = scratch.save(edge_table(turned), "edges", "depth")
    starts = scratch.save(_starts(turned), "starts", "depth")
    span = turned.agg(F.min("enter").alias("low"), F.max("size").alias("high")).first()
    found = [_long_pairs(words)]
    front = scratch.spark.createDataFrame([], "id long, node long, rest string")
    for depth in range(span["low"] or 0, (span["high"] or -1) + 1):
        fresh = starts.where(F.col("depth") == depth).select("id", "node", "rest", F.lit(0).alias("edits"))
        moved = front.where("rest <> ''").withColumn("edits", F.lit(1))
        front = scratch.save(_advance(fresh.union(moved), edges.where(F.col("depth") == depth)), f"level-{depth}")
        found.append(front.where("rest = ''").select("id", F.col("node").alias("reached")))
    # a node that ends a word is that word, forwards or reversed
    ends = short.select(F.col("id").alias("other"), F.explode(F.array(
        _node(F.lit(0), F.col("word")), _node(F.lit(1), F.reverse("word")))).alias("reached"))
    pairs = found[0]
    if len(found) > 1:
        reached = found[1]
        for more in found[2:]:
            reached = reached.union(more)
        pairs = pairs.union(reached.join(ends, "reached").select("id", "other"))
    return pairs.distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words.

    The form is the neighbour of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times
    the word's own, the root what forms lead to in the end. An empty table gives an empty result.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select(F.xxhash64("word").alias("id"), "word", "n"), "words")
    pairs = neighbours(scratch, words.select("id", "word"))
    other = words.select(F.col("id").alias("other"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = pairs.join(other, "other").groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "other")).alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    near = scratch.save(words.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["form"].alias("form"),
        form["other"].alias("form_id"), (-form["less"]).alias("form_n")), "near")
    # counts grow by the ratio with every form, so few doublings reach every root
    top = near.agg(F.max("n")).first()[0] or 1
    steps, longest = 0, 1
    while ratio ** longest <= top:
        longest += 1
    while 1 << steps < longest:
        steps += 1
    up = scratch.save(near.where("form_id is not null").select("id", F.col("form_id").alias("up"), F.col("form").alias("root")), "up-0")
    for step in range(steps):
        then = up.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("root").alias("far"))
        up = scratch.save(up.join(then, "up", "left").select(
            "id", F.coalesce("further", "up").alias("up"), F.coalesce("far", "root").alias("root")), f"up-{step + 1}")
    return near.join(up.select("id", "root"), "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


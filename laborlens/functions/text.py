"""String cleaning, tokenising, truncation and list splitting as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"              # a word character in any script
ASCII_RUN = r"[A-Za-z0-9_]+"         # a word run in cleaned (ASCII) text
# the same, and the runs between words: every whole-word pattern contains a full run
ANY_RUN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_word(alternatives: str) -> str:
    """Pattern for alternatives that stand as whole words in text of any script."""
    return rf"(?<!{WORD})(?:{alternatives})(?!{WORD})"


def _clean(col: Column, kept: str) -> Column:
    # joining the kept runs gives what replacing all else by blanks would, several times faster
    plain = F.regexp_replace(F.coalesce(col, F.lit("")), r"<[^>]+>", " ")
    runs = F.regexp_extract_all(plain, F.lit(f"([{kept}]+)"), F.lit(1))
    return F.lower(F.array_join(runs, " "))


def clean_text(col: Column) -> Column:
    """Tags and other characters to blanks, keeping ``# + . / -``; lower case; '' for NULL."""
    return _clean(col, r"a-zA-Z0-9#+./\-")


def clean_words(col: Column) -> Column:
    """As ``clean_text`` but keeping only ``+ #`` beside letters and digits."""
    return _clean(col, "a-zA-Z0-9+#")


def words(col: Column) -> Column:
    """All words of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"({WORD}+)"), F.lit(1))


def terms(col: Column) -> Column:
    """Tokens of at least two word characters, in order, from cleaned text."""
    return F.regexp_extract_all(col, F.lit(r"([A-Za-z0-9_]{2,})"), F.lit(1))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by each pair of neighbours joined by a blank."""
    neighbours = F.zip_with(
        tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right))   # NULL where no right one
    return F.concat(tokens, F.array_compact(neighbours))


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_list(col: Column) -> Column:
    """'A, b,,' -> ['a', 'b']."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def truncate(col: Column, chars: int | None) -> Column:
    """The first characters; all of them where no number is given."""
    return col if chars is None else F.substring(col, 1, chars)


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def fold_ascii(col: Column) -> Column:
    """Lower-case A-Z only, as a case-blind LIKE over ASCII does."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def contains_any(col: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])

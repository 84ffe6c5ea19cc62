"""Field salvage from model replies: JSON when it parses, patterns when it does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRIPPED = r"^\s+|\s+$"


def json_slice(raw: Column) -> Column:
    """From the first '{' to the last '}', or the whole reply when there is no such part."""
    part = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(part != "", part).otherwise(raw)


def drop_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def parsed(raw: Column) -> Column:
    """The reply as VARIANT; NULL when it is not valid JSON."""
    return F.try_parse_json(drop_trailing_commas(json_slice(raw)))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, _STRIPPED, "")


def _items(col: Column) -> Column:
    return F.filter(F.transform(col, _strip), lambda x: x != "")


def _bullets(col: Column) -> Column:
    return F.array_join(F.transform(_items(col), lambda x: F.concat(F.lit("- "), x)), "\n")


def _key(field: str) -> str:
    return rf"""(?s)['"]?{field}['"]?\s*:\s*"""


def _quoted_items(text: Column, field: str) -> Column:
    inside = F.regexp_extract(text, _key(field) + r"\[(.*?)\]", 1)
    return F.regexp_extract_all(inside, F.lit(r"""(?s)['"](.*?)['"]"""), F.lit(1))


def text_field(raw: Column, variant: Column, field: str) -> Column:
    """One text field; a list value becomes '- item' lines; '' when absent."""
    path = f"$.{field}"
    from_list = F.try_variant_get(variant, path, "array<string>")
    from_json = (F.when(from_list.isNotNull(), _bullets(from_list))
                 .otherwise(_strip(F.coalesce(F.try_variant_get(variant, path, "string"), F.lit("")))))
    content = json_slice(raw)
    pattern = _key(field) + r"""['"](.*?)['"]"""
    unescaped = F.replace(F.regexp_extract(content, pattern, 1), F.lit("\\n"), F.lit("\n"))
    from_pattern = (F.when(content.rlike(pattern), _strip(unescaped))
                    .otherwise(_bullets(_quoted_items(content, field))))
    return F.when(variant.isNotNull(), from_json).otherwise(from_pattern)


def list_field(raw: Column, variant: Column, field: str) -> Column:
    """One list field as array<string>; empty when absent."""
    from_json = F.coalesce(F.try_variant_get(variant, f"$.{field}", "array<string>"),
                           F.array().cast("array<string>"))
    from_pattern = _items(_quoted_items(json_slice(raw), field))
    return F.when(variant.isNotNull(), from_json).otherwise(from_pattern)

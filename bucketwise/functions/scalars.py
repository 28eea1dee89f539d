"""Scalar column functions whose semantics Spark does not offer in one call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_string(text: str) -> str:
    """Quote ``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def json_path(keys: Iterable[str | int]) -> str:
    parts = []
    for key in keys:
        parts.append(f"[{key}]" if isinstance(key, int) else '["' + str(key) + '"]')
    return "$" + "".join(parts)


def json_string(c: Column | str, *keys: str | int) -> Column:
    """String at a JSON path; anything missing, broken or not a string gives ''."""
    found = F.try_variant_get(F.try_parse_json(_col(c)), json_path(keys), "variant")
    is_text = F.schema_of_variant(found) == F.lit("STRING")
    return F.when(is_text, found.cast("string")).otherwise(F.lit(""))


def json_number(c: Column | str, *keys: str | int) -> Column:
    """Number at a JSON path; missing, broken or not numeric gives 0."""
    found = F.try_variant_get(F.try_parse_json(_col(c)), json_path(keys), "variant")
    kind = F.schema_of_variant(found)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, found.cast("double")).otherwise(F.lit(0.0))


def composite_id(*parts: Column | str, sep: str = "#") -> Column:
    return F.concat_ws(sep, *[_col(p) for p in parts])


def split_id(c: Column | str, sep: str = "#") -> tuple[Column, Column]:
    """Group and key of a composite id; the key keeps later separators."""
    pair = F.split(_col(c), "\\Q" + sep + "\\E", 2)
    return F.get(pair, 0), F.get(pair, 1)


def replace_first(c: Column | str, old: str, new: str) -> Column:
    """Replace the first literal occurrence only."""
    s, at = _col(c), F.locate(old, _col(c))
    tail = F.substring(s, at + F.lit(len(old)), F.length(s))
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), tail)).otherwise(s)


def count_substrings(c: Column | str, needle: str) -> Column:
    """Number of non-overlapping literal occurrences."""
    s = _col(c)
    return ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def element_or_null(c: Column | str, index: Column | int) -> Column:
    """1-based array element, NULL outside the array."""
    return F.try_element_at(_col(c), F.lit(index) if isinstance(index, int) else index)


def half_open_range(start: Column | int, end: Column | int) -> Column:
    """Integers from ``start`` up to but excluding ``end``; empty when there are none."""
    a = F.lit(start) if isinstance(start, int) else start
    b = F.lit(end) if isinstance(end, int) else end
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))


def number_or_zero(c: Column | str) -> Column:
    """NULL and NaN count as zero."""
    v = _col(c).cast("double")
    return F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))

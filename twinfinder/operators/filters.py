"""Row predicates: the filter expression, the dimension filter, and name validity.

Predicates are true or false, never null, and made of comparisons that file scans can evaluate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

COMPARISONS = (">=", "<=", ">", "<", "=")
_TRIM = "".join(map(chr, range(33)))  # control characters and space
LONG = 63
INT = 31


def _number(text: str, bits: int) -> int | None:
    """A signed decimal of at most `bits` bits, or None."""
    if not re.fullmatch(r"[+-]?[0-9]+", text):
        return None
    value = int(text)
    return value if -(1 << bits) <= value < (1 << bits) else None


def compare(column: Column, expression: str, bits: int = LONG) -> Column:
    """`column` against "[>=|<=|>|<|=]n"; a bare n means equality, anything else matches nothing."""
    text = expression.strip(_TRIM)
    op = next((c for c in COMPARISONS if text.startswith(c)), "")
    value = _number(text[len(op):].strip(_TRIM), bits)
    if value is None:
        return F.lit(False)
    bound = F.lit(value).cast("bigint")
    tests = {">=": column >= bound, "<=": column <= bound, ">": column > bound, "<": column < bound}
    result = tests.get(op, column == bound)
    return column.isNotNull() & result


def parse_filter(expression: str | None) -> Column:
    """Predicate for "mime:part", "name:part" or "size:[op]n". No expression keeps all rows, an unknown one none."""
    if expression is None or not expression.strip():
        return F.lit(True)
    kind, colon, rest = expression.partition(":")
    rest = rest.strip(_TRIM)
    if colon and kind == "mime":
        return F.col("mime").isNotNull() & F.col("mime").contains(rest)
    if colon and kind == "name":
        return F.col("path").isNotNull() & F.col("path").contains(rest)
    if colon and kind == "size":
        return compare(F.col("size"), rest)
    return F.lit(False)


def dim_filter(width: str | None = None, height: str | None = None) -> Column:
    """Image dimensions against comparisons; records without dimensions match only when none is given."""
    result = F.lit(True)
    if width is not None:
        result = result & compare(F.col("image_size.width"), width, INT)
    if height is not None:
        result = result & compare(F.col("image_size.height"), height, INT)
    return result


def valid_name(name: Column | str) -> Column:
    """Letters, digits and underscore only."""
    c = F.col(name) if isinstance(name, str) else name
    return c.rlike(r"\A[\p{L}\p{Nd}_]+\z")

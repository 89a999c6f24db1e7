"""Formatting and path pieces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = "KMGTPE"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_size(size: Column | str) -> Column:
    """Bytes below 1024 as they are, larger values with one decimal in the largest fitting unit."""
    n = _c(size)
    # Exact exponent from the number of binary digits; a floating logarithm is off just below powers of 1024.
    step = F.floor((F.length(F.bin(n)) - 1) / 10).cast("int")
    scaled = n.cast("double") / F.pow(F.lit(1024.0), step)
    unit = F.substring(F.lit(UNITS), step, F.lit(1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(
        F.format_string("%.1f %sB", scaled, unit)
    )


def format_date(millis: Column | str) -> Column:
    """Epoch milliseconds as date and time in the session time zone."""
    return F.date_format(F.timestamp_millis(_c(millis)), "yyyy-MM-dd HH:mm:ss")


def file_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def parent(path: Column | str) -> Column:
    """Directory part of a path; empty for a file at the root."""
    p = _c(path)
    return F.left(p, F.length(p) - F.length(file_name(p)) - 1)


def join_path(base: Column | str, relative: Column | str) -> Column:
    """`relative` below `base`; an empty base adds nothing."""
    b, r = F.lit(base) if isinstance(base, str) else base, _c(relative)
    return F.when(b == "", r).otherwise(F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"), r))


def replace_suffix(path: Column | str, suffix: str | None) -> Column:
    """Exchange the file suffix, or append it to names that have none (dot files included)."""
    p = _c(path)
    if suffix is None:
        return p
    dotted = F.lit(suffix if suffix.startswith(".") else "." + suffix)
    name = file_name(p)
    has_suffix = F.contains(F.substring(name, F.lit(2), F.length(name)), F.lit("."))
    stem = F.left(p, F.length(p) - F.length(F.substring_index(p, ".", -1)) - 1)
    return F.concat(F.when(has_suffix, stem).otherwise(p), dotted)

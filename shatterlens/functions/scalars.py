"""Scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Texts that count as true, by strictness.
TRUE_TEXTS = {"strict": ("true", "1", "yes"), "wide": ("true", "1", "yes", "y", "ok"), "usual": ("true", "1", "yes", "y")}


def finite(c: Column) -> Column:
    """The number, or NULL for NULL, NaN and infinities."""
    d = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(c), F.lit(float(default)))


def truthy(c: Column, kind: str = "usual") -> Column:
    """Whether a text means true; NULL is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXTS[kind]), F.lit(False))


def compressed_log(seconds: Column) -> Column:
    """log10 of a time of at least 0.01; negative values are drawn in to 0.35 of them."""
    x = F.log10(F.greatest(seconds, F.lit(0.01)))
    return F.when(x < 0, 0.35 * x).otherwise(x)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def snap(c: Column, allowed: Sequence[float]) -> Column:
    """The nearest allowed value, the lower of two."""
    pairs = F.array(*[F.struct(F.abs(c - F.lit(float(a))).alias("d"), F.lit(float(a)).alias("a")) for a in allowed])
    return F.when(c.isNotNull(), F.array_min(pairs)["a"])


def hash_prefix(text: Column, n: int = 12) -> Column:
    """First hex digits of SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def slug(text: Column, allowed: str = "A-Za-z0-9_.-", joint: str = "_") -> Column:
    """Runs of other characters become ``joint``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[^{allowed}]+", joint), f"^[{joint}]+|[{joint}]+$", "")


def measure(text: Column) -> Column:
    """Number of a cell without its marks and units (*, %, s, h); words for nothing, and other text, are NULL."""
    bare = F.trim(F.regexp_replace(text, r"\*", ""))
    return F.when(~bare.isin("", "-", "incomplete", "timeout guard"), F.trim(F.regexp_replace(bare, "[%sh]", "")).try_cast("double"))


def percent_label(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def factor_label(factor: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}fx", factor)


def list_items(text: Column) -> Column:
    """Trimmed, non-empty items of a comma list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a tolerance; NULL equals NULL only."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def json_object(text: Column) -> Column:
    """The text from the first { to the last }, or NULL."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def fenced_code(text: Column, marker: str = "def degree_order") -> Column:
    """The first fenced block with ``marker``, else the text from the marker on, else the whole text; without blank ends."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), 1)
    block = F.get(F.filter(blocks, lambda b: F.contains(b, F.lit(marker))), 0)
    at = F.locate(marker, text)
    return bare(F.coalesce(block, F.when(at > 0, F.substr(text, at)), text))


def head_and_tail(text: Column, most: int, share: float = 0.62) -> Column:
    """At most ``most`` characters: the head's share and the tail around a mark of what is left out."""
    head = int(most * share)
    cut = F.concat(F.left(text, F.lit(head)), F.lit("\n...\n"), F.right(text, F.lit(most - head)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def top_sum(values: Column, n: int = 5) -> Column:
    """Sum of the ``n`` greatest items of an array."""
    return F.aggregate(F.slice(F.sort_array(values, asc=False), 1, n), F.lit(0).cast("double"), lambda a, x: a + x)


def mixed_key(label: Column) -> Column:
    """Sort key of labels that may be integers or text: integers first."""
    number = label.try_cast("bigint")
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), number.alias("i"), F.when(number.isNull(), label).alias("s"))


def date_label(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd")

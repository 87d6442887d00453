"""Names and orders of recordings, channels and regions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Digits compare as numbers, the rest as lower-case text: each digit run is padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def reversed_sequence(name: Column) -> Column:
    """The sequence number of a spool file: its digits read backwards; without digits null."""
    digits = F.reverse(F.regexp_replace(name, r"\D", ""))
    return F.when(digits != "", digits).cast("long")


def embedded_number(stem: Column) -> Column:
    found = F.regexp_extract(stem, r"(\d+)", 1)
    return F.when(found != "", found).cast("long")


def experiment_name(stem: Column) -> Column:
    """What stands between ``timelapse`` and ``_MM`` (may be empty), else the stem; an empty stem gives null."""
    found = F.regexp_count(stem, F.lit(r"timelapse(.*?)_MM")) > 0
    return F.when(found, F.regexp_extract(stem, r"timelapse(.*?)_MM", 1)).when(stem != "", stem)


def channel_token(ch: Column, name: Column, prop: Column) -> Column:
    return F.format_string("Ch%d_%s-%s", ch, name, prop)


def valid_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_-]+\z")


def role(alias: Column) -> Column:
    """``s`` and ``d`` spelled out; trimmed, lower-case."""
    a = F.lower(F.trim(alias))
    return F.when(a == "s", "source").when(a == "d", "donner").otherwise(a)


def component_labels(indices: Column) -> Column:
    """0-based component numbers as sorted, distinct labels from IC1 on; negative ones go."""
    kept = F.array_sort(F.array_distinct(F.filter(indices, lambda i: i >= 0)))
    return F.transform(kept, lambda i: F.concat(F.lit("IC"), (i + 1).cast("string")))


def component_indices(labels: Column) -> Column:
    """Labels (``IC3``, ``ic3`` or ``3``) as sorted, distinct 0-based numbers."""
    numbers = F.transform(labels, lambda s: F.regexp_replace(F.upper(F.trim(s)), "^IC", "").cast("long") - 1)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda i: i >= 0)))


def bytes_text(n: Column) -> Column:
    return F.when(n.isNull() | (n < 0), "?").when(n == 0, "-").when(n < 1 << 10, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / float(1 << 10))).when(n < 1 << 30, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(F.format_string("%.1f GB", n / float(1 << 30)))


def fingerprint(*columns: str) -> list[Column]:
    """Order-free content digest of a table: count and sum of 60-bit row hashes (so equal rows don't cancel); use in ``agg``. Nulls aren't empty texts."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest")]

"""Display formatting: sizes, page details, progress, time strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import SIZE_UNITS


def format_size(size: Column) -> Column:
    """Q19: bytes as 'B/KB/MB/GB', base 1024, at most one decimal.

    ``0 B`` for zero; a trailing '.0' is dropped; sizes of 1024 GB and more
    stay in GB.
    """
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    exp = F.least(
        F.floor(F.log(1024.0, F.greatest(size.cast("double"), F.lit(1.0)))),
        F.lit(len(SIZE_UNITS) - 1),
    ).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), exp), 1)
    text = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    return F.when(size == 0, F.lit("0 B")).otherwise(
        F.concat(text, F.lit(" "), F.element_at(units, exp + 1))
    )


def iso_utc(ts: Column) -> Column:
    """Timestamp as ISO-8601 UTC text with seconds (session zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def progress_percent(done: Column, total: Column, initial: int, final: int) -> Column:
    """Initial + (final-initial)*done/total, truncated; ends clamp."""
    frac = done.cast("double") / total.cast("double")
    mid = (F.lit(float(initial)) + frac * F.lit(float(final - initial))).cast("int")
    return (
        F.when((done == 0) | (total == 0), F.lit(initial))
        .when(done >= total, F.lit(final))
        .otherwise(mid)
    )

"""Byte-size columns: display forms and parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# 1024-based units.
KB = 1024
MB = 1024 * KB
GB = 1024 * MB



def human_size(size: Column) -> Column:
    """``1.3 KB`` style text; unknown and zero sizes give an empty string."""
    return (
        F.when(size.isNull() | (size == 0), "")
        .when(size < KB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MB, F.format_string("%.1f KB", size / KB))
        .when(size < GB, F.format_string("%.1f MB", size / MB))
        .otherwise(F.format_string("%.2f GB", size / GB))
    )


def compact_size(size: Column) -> Column:
    """Struct (value, unit) with trailing zeros removed; empty value in MB when unknown."""

    def part(value: Column, unit: str) -> Column:
        return F.struct(value.alias("value"), F.lit(unit).alias("unit"))

    def trimmed(scale: int, digits: int) -> Column:
        return F.regexp_replace(F.format_string(f"%.{digits}f", size / scale), r"[.]?0+$", "")

    def one_digit(scale: int) -> Column:
        return F.regexp_replace(F.format_string("%.1f", size / scale), r"[.]0$", "")

    return (
        F.when(size.isNull() | (size == 0), part(F.lit(""), "MB"))
        .when(size >= GB, part(trimmed(GB, 2), "GB"))
        .when(size >= MB, part(one_digit(MB), "MB"))
        .when(size >= KB, part(one_digit(KB), "KB"))
        .otherwise(part(size.cast("string"), "B"))
    )


def compact_size_text(size: Column) -> Column:
    """Value and unit glued together; NULL only for an unknown size."""
    parts = compact_size(size)
    return F.when(size.isNotNull(), F.concat(parts["value"], parts["unit"]))


def _scaled(value: Column, unit: Column) -> Column:
    factor = F.when(unit == "GB", GB).when(unit == "MB", MB).when(unit == "KB", KB).otherwise(1)
    return F.floor(value * factor + F.lit(0.5)).cast("bigint")


def parse_size(text: Column) -> Column:
    """Bytes of ``1.5MB`` style text; other text gives its leading integer or NULL."""
    sized = rf"(?i)^([\d.]+)[{SPACE}]*(GB|MB|KB|B)?$"
    number = F.regexp_extract(F.regexp_extract(text, sized, 1), r"^(\d+[.]?\d*|[.]\d+)", 1)
    unit = F.upper(F.regexp_extract(text, sized, 2))
    leading = F.regexp_extract(text, rf"^[{SPACE}]*([+-]?\d+)", 1).try_cast("bigint")
    return F.when(text.rlike(sized), _scaled(number.try_cast("double"), unit)).otherwise(
        F.nullif(leading, F.lit(0).cast("bigint"))
    )


def size_from_input(value: Column, unit: Column) -> Column:
    """Bytes of a numeric entry with a chosen unit; negative or non-numeric gives NULL."""
    number = value.try_cast("double")
    return F.when((number >= 0) & ~F.isnan(number), _scaled(number, unit))

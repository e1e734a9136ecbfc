"""Scalar cleaning, parsing and comparison functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import family, present, ref

# Whitespace as text splitting understands it (Unicode white space and the
# four ASCII separators), and the words accepted as booleans.
SPACE = "(?U)[\\s\\x{1c}-\\x{1f}]"
SPACE_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
FORMULA_STARTS = ("=", "+", "-", "@")

# What text may look like to be read as a number or an ISO date; Spark's own casts take more ("5d", "12:30").
NUMBER_TEXT = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$|^[+-]?(?i:inf|infinity)$"
ISO_DATE_TEXT = "^\\d{4}(-\\d{1,2}(-\\d{1,2}([T ]\\d.*)?)?)?$"
#: Other accepted dates, month first, each with an optional time; anything else is unreadable.
DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy")
TIME_FORMAT = "[ H:mm[:ss]]"

RELATIVE_TOLERANCE = 1e-9
ABSOLUTE_TOLERANCE = 1e-6


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def to_number(text: Column) -> Column:
    """Text to double; anything but plain decimal or scientific notation becomes null, and so does NaN."""
    stripped = strip(text)
    return F.when(stripped.rlike(NUMBER_TEXT), stripped.try_cast("double"))


def to_moment(text: Column) -> Column:
    """Text to timestamp: ISO dates and ``DATE_FORMATS``; a time without a date is unreadable, so null."""
    stripped = strip(text)
    iso = F.when(stripped.rlike(ISO_DATE_TEXT), stripped.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(stripped, F.lit(f + TIME_FORMAT)) for f in DATE_FORMATS])


def moment(df: DataFrame, column: str) -> Column:
    """A column as timestamp, text by ``to_moment``; missing or unreadable values are null."""
    return to_moment(ref(column)) if family(df.schema[column].dataType) == "text" else ref(column).try_cast("timestamp")


def normalize_number(text: Column) -> Column:
    return to_number(F.regexp_replace(text, ",", ""))


def normalize_currency(text: Column) -> Column:
    """``$1,000.00`` and accounting negatives such as ``(250)``."""
    return to_number(F.regexp_replace(F.regexp_replace(text, "[$,)]", ""), "\\(", "-"))


def map_value(df: DataFrame, column: str, transformation: str) -> Column:
    """One mapping transformation; text functions leave other types untouched."""
    c = present(df, column)
    is_text = family(df.schema[column].dataType) == "text"
    if transformation == "none":
        return c
    if transformation in ("trim", "upper", "lower"):
        if not is_text:
            return c
        return {"trim": strip, "upper": F.upper, "lower": F.lower}[transformation](c)
    if transformation == "normalize_number":
        return normalize_number(c.cast("string"))
    if transformation == "normalize_currency":
        return normalize_currency(c.cast("string"))
    if transformation == "normalize_date":
        return to_moment(c) if is_text else c.try_cast("timestamp")
    raise RefusedError(f"Unsupported mapping transformation '{transformation}'.")


def coerce(column: Column, kind: str, target_type: str) -> Column:
    """Coerce to a target type; values that do not fit become null (the caller counts them)."""
    if target_type == "number":
        return to_number(column) if kind == "text" else column.try_cast("double")
    if target_type == "date":
        return to_moment(column) if kind == "text" else column.try_cast("timestamp")
    if target_type == "boolean":
        word = F.lower(strip(column.cast("string")))
        return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    return column


def formula_safe(text: Column) -> Column:
    """Keep a spreadsheet from reading text as a formula: a leading quote is put in front."""
    return F.when(F.substring(F.ltrim(text, F.lit(SPACE_CHARACTERS)), 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)


def neutralize_formulas(df: DataFrame) -> DataFrame:
    """``formula_safe`` on every text column."""
    return df.select(
        *[
            formula_safe(ref(f.name)).alias(f.name) if family(f.dataType) == "text" else ref(f.name)
            for f in df.schema.fields
        ]
    )


def is_close(a: Column, b: Column) -> Column:
    allowed = F.greatest(F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABSOLUTE_TOLERANCE))
    return F.abs(a - b) <= allowed


def percentage_change(previous: Column, current: Column) -> Column:
    """Change in percent, null when the previous value is zero or either side is missing."""
    return F.try_divide(current.cast("double") - previous.cast("double"), previous.cast("double")) * 100.0


def percentage_reason(previous: Column, current: Column, unavailable: str) -> Column:
    return F.when(previous.isNull() | current.isNull(), F.lit(unavailable)).when(
        previous == 0, F.lit("Percentage change is undefined because the previous value is zero.")
    )


def sum_available(column: Column) -> Column:
    """Aggregate: the sum, or null when any member is missing or there is none."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def normalized_name(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def name_tokens(name: Column) -> Column:
    """Words of a name longer than two characters; camel case counts as words."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    words = F.split(F.lower(spaced), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def percent_rates(text: Column) -> Column:
    """Every percentage written in a text, as fractions."""
    found = F.regexp_extract_all(text, F.lit("(?<![\\d.])(\\d+(?:\\.\\d+)?)\\s*%"), 1)
    return F.transform(found, lambda t: t.cast("double") / 100)

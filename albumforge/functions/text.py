"""Text helpers: sort keys, file names, labels. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank and ASCII punctuation in the order the Unicode root
# collation gives them. They sort before digits, digits before letters.
PUNCTUATION_ORDER = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def natural_key(name: Column) -> Column:
    """Sort key for file names, one string: case ignored, digit runs compared as numbers.

    A digit run becomes its length (3 digits) and itself without leading zeros,
    so runs of any length below 1000 compare by value. The key is one string, so
    a digit meets whatever stands at its place in the other name.
    """
    ranked = "".join(chr(i + 1) for i in range(len(PUNCTUATION_ORDER)))
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        return F.when(
            run.rlike("^[0-9]"),
            F.concat(F.lpad(F.length(digits).cast("string"), 3, "0"), digits),
        ).otherwise(F.translate(run, PUNCTUATION_ORDER, ranked))

    return F.array_join(F.transform(runs, key), "")


def clean_base(name: Column) -> Column:
    """File base name for an export: extension dropped, other characters to '-'."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", "")
    dashed = F.regexp_replace(base, "[^a-zA-Z0-9_-]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed == "", F.lit("photo")).otherwise(trimmed)


def extension(name: Column, fallback: str = ".jpg") -> Column:
    found = F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([a-zA-Z0-9]+)$", 1)
    return F.when(found == "", F.lit(fallback)).otherwise(F.concat(F.lit("."), F.lower(found)))


def padded(number: Column, digits: int) -> Column:
    """Zero-padded, never cut (``lpad`` would cut)."""
    return F.format_string(f"%0{digits}d", number)


def place_label(neighbourhood: Column, suburb: Column, quarter: Column, town: Column,
                city: Column, village: Column, municipality: Column, country: Column) -> Column:
    """'area, city' when both are known and differ, else city, else country, else null."""
    def first(*cols: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])

    area = first(neighbourhood, suburb, quarter, town)
    place = first(city, town, village, municipality)
    return (
        F.when(area.isNotNull() & place.isNotNull() & (area != place), F.concat(area, F.lit(", "), place))
        .otherwise(F.coalesce(place, F.nullif(country, F.lit(""))))
    )


def trip_name(start: Column, end: Column, country: Column) -> Column:
    """'Country, Month Year'; months are compared by name only, the year is the end's."""
    country = F.nullif(country, F.lit(""))
    m1, m2 = F.date_format(start, "MMMM"), F.date_format(end, "MMMM")
    label = F.concat(F.when(m1 == m2, m1).otherwise(F.concat(m1, F.lit("–"), m2)),
                     F.lit(" "), F.date_format(end, "yyyy"))
    dated = F.when(country.isNull(), label).otherwise(F.concat(country, F.lit(", "), label))
    return F.when(start.isNull() | end.isNull(), F.coalesce(country, F.lit("Your Story"))).otherwise(dated)


def date_range_label(start: Column, end: Column) -> Column:
    """'Undated', 'May 3–13, 2025' or 'May 28 – June 5, 2025'."""
    first = F.date_format(start, "MMMM d")
    same = F.date_format(start, "yyyy-MM") == F.date_format(end, "yyyy-MM")
    tail = F.concat(F.lit(", "), F.date_format(end, "yyyy"))
    return (
        F.when(start.isNull() | end.isNull(), F.lit("Undated"))
        .when(same, F.concat(first, F.lit("–"), F.date_format(end, "d"), tail))
        .otherwise(F.concat(first, F.lit(" – "), F.date_format(end, "MMMM d"), tail))
    )


def chapter_title(day_index: Column, label: Column) -> Column:
    day = F.concat(F.lit("Day "), day_index.cast("string"))
    return F.when(F.nullif(label, F.lit("")).isNull(), day).otherwise(F.concat(day, F.lit(" — "), label))


def strip_day_prefix(title: Column, day_index: Column) -> Column:
    """The heading without its own 'Day N'; a title that is only that stays as it is."""
    prefix = F.concat(F.lit("Day "), day_index.cast("string"))
    rest = F.trim(F.regexp_replace(F.substr(title, F.length(prefix) + 1), r"^\s*[—–-]\s*", ""))
    return (
        F.when(F.coalesce(title, F.lit("")) == "", F.lit(""))
        .when(~F.startswith(title, prefix), title)
        .when(rest == "", title)
        .otherwise(rest)
    )


def gap_text(minutes: Column) -> Column:
    """'1.5h' above 90 minutes, else '20m'."""
    tenths = F.floor(minutes / 60 * 10 + 0.5)
    whole = F.floor(tenths / 10)
    hours = F.concat(
        whole.cast("string"),
        F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(F.lit("")),
        F.lit("h"),
    )
    return F.when(minutes > 90, hours).otherwise(
        F.concat(F.floor(minutes + 0.5).cast("string"), F.lit("m")))


def data_url_bytes(url: Column) -> Column:
    """Payload of a data URL; text without a comma is taken whole."""
    comma = F.instr(url, ",")
    return F.unbase64(F.substr(url, comma + 1))

"""Checks and clean-up of incoming event batches, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumforge.functions.pixels import bind

# Limits of the intake.
MAX_EVENTS_PER_BATCH = 50
MAX_PROPERTIES = 20
MAX_TEXT = 200
MAX_NAME = 60
MAX_SESSION = 80
MAX_VERSION = 40
RATE_WINDOW_SECONDS = 60
RATE_MAX_REQUESTS = 60
# Object keys that are whole numbers below this come first, in numeric order.
INDEX_LIMIT = 4294967295


# What an engine's lower-case user agent holds, the first match counts; and what a phone's does.
ENGINES = (("edge", "edg/"), ("chrome", "chrome|crios"), ("firefox", "firefox|fxios"), ("safari", "safari"))
PHONES = "mobile|iphone|ipad|android"


def browser_bucket(user_agent: Column) -> Column:
    """'<engine>-<mobile|desktop>'; the raw text is not kept."""
    text = F.lower(F.coalesce(user_agent, F.lit("")))
    known = [F.when(text.rlike(pattern), F.lit(engine)) for engine, pattern in ENGINES]
    return F.concat_ws("-", F.coalesce(*known, F.lit("other")), F.when(text.rlike(PHONES), "mobile").otherwise("desktop"))


def json_type(value: Column) -> Column:
    """Type name of a VARIANT, without what is inside it."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_field(value: Column, key: str) -> Column:
    """The field's text when it is a JSON string, else null."""
    field = F.try_variant_get(value, f"$.{key}", "variant")
    # A string's schema is its bare type name.
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def clean_properties(raw: Column) -> Column:
    """JSON object text with scalars only: the first 20 in document order, text cut to 200.

    Parsed as a map, not as a VARIANT object, because a VARIANT sorts its keys.
    A JSON array counts as an object with its indexes as keys.
    """
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    indexed = F.map_from_entries(F.transform(items, lambda v, i: F.struct(i.cast("string"), v)))
    props = F.when(F.startswith(F.ltrim(raw), F.lit("[")), indexed).otherwise(F.from_json(raw, "map<string,variant>"))
    kept = bind(props, _first_scalars)
    return F.coalesce(F.to_json(kept), F.lit("{}"))


def _first_scalars(props: Column) -> Column:
    ranked = F.transform(
        F.map_entries(props),
        lambda e, i: F.struct(
            F.when(e["key"].rlike("^(0|[1-9][0-9]{0,9})$") & (e["key"].try_cast("bigint") < INDEX_LIMIT),
                   e["key"].try_cast("bigint")).otherwise(F.lit(INDEX_LIMIT) + i).alias("rank"),
            i.alias("at"), json_type(e["value"]).alias("type")),
    )
    scalar = F.filter(ranked, lambda r: r["type"].isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"))
    first = F.slice(F.sort_array(scalar), 1, MAX_PROPERTIES)
    cut = lambda v: F.substring(F.try_variant_get(v, "$", "string"), 1, MAX_TEXT).cast("variant")
    return bind(F.map_entries(props), lambda entries: F.map_from_entries(F.transform(
        first, lambda r: bind(F.get(entries, r["at"]), lambda e: F.struct(
            e["key"], F.when(r["type"] == "STRING", cut(e["value"])).otherwise(e["value"]))))))

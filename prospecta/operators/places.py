"""Place records of a map service: flattened, and the companies whose look-up has to be tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(doc: Column, path: str) -> Column:
    """A value of the document; JSON null counts as absent."""
    found = F.try_variant_get(doc, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def _text(value: Column) -> Column:
    """A string as it is; anything else is null."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _texts(doc: Column, path: str) -> Column:
    """The strings of an array; empty if there is none."""
    found = F.filter(F.try_variant_get(doc, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(found, lambda x: x.cast("string")), F.array().cast("array<string>"))


def flatten_place(doc: Column) -> Column:
    """Struct of a place's fields; values of another type than expected, and all fields of a null place, are null."""
    number = lambda path, kind: F.try_variant_get(doc, path, kind)
    text = lambda path: _text(_value(doc, path))
    return F.struct(
        _text(F.coalesce(_value(doc, "$.internationalPhoneNumber"), _value(doc, "$.nationalPhoneNumber"))).alias("phone"),
        text("$.websiteUri").alias("website"),
        text("$.formattedAddress").alias("address"),
        number("$.location.latitude", "double").alias("lat"),
        number("$.location.longitude", "double").alias("lon"),
        number("$.rating", "double").alias("rating"),
        number("$.userRatingCount", "long").alias("user_rating_count"),
        text("$.businessStatus").alias("business_status"),
        text("$.primaryType").alias("primary_type"),
        _texts(doc, "$.types").alias("types"),
        _texts(doc, "$.regularOpeningHours.weekdayDescriptions").alias("opening_hours"),
        text("$.id").alias("google_place_id"),
        text("$.displayName.text").alias("display_name"),
    )


def retry_list(companies: DataFrame, quota: int, order: str = "updated_at") -> DataFrame:
    """Companies marked as pending in their JSON of ``signals`` and not enriched since, oldest first, up to what the quota leaves.

    A mark of JSON null is a mark; text that isn't JSON has none.
    """
    signals = F.try_parse_json("signals")
    pending = F.try_variant_get(signals, "$.google_places_pending", "variant").isNotNull()
    enriched = F.try_variant_get(signals, "$.google_places.enriched_at", "string").isNotNull()
    return companies.where(pending & ~enriched).orderBy(F.asc_nulls_last(order), "id").limit(quota)

"""Decoding of log records and the identity fields of payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.scalars import header


def string_field(variant: Column, name: str) -> Column:
    """A field of a JSON object if it is a JSON string, else null."""
    field = F.variant_get(variant, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(variant, f"$.{name}", "string"))


#: Payload formats.
CODECS = ("json", "binary", "json_binary")


def encode(payload: Column, codec: str = "json") -> Column:
    """Bytes of a payload: JSON is written anew without white space, null where it isn't valid; other bytes stay."""
    if codec not in CODECS:
        raise ValueError(codec)
    return F.to_json(F.try_parse_json(payload)).cast("binary") if codec == "json" else payload.cast("binary")


def extracted(log: DataFrame, extractor: Callable[[Column], Column]) -> DataFrame:
    """Adds id and type by a user's extractor: a function (or Pandas UDF) from the payload to a struct of both; a null struct is a
    payload that can't be read, and its row goes."""
    return log.withColumn("_x", extractor(F.col("payload"))).where("_x IS NOT NULL").withColumn("id", F.col("_x.id")).withColumn("type", F.col("_x.type")).drop("_x")


def identify(log: DataFrame) -> DataFrame:
    """Adds id and type, parsed once from the JSON payload."""
    return log.withColumn("_v", F.try_parse_json("payload")).withColumn("id", string_field(F.col("_v"), "id")).withColumn("type", string_field(F.col("_v"), "type")).drop("_v")


def reject_reason(key: Column, payload: Column, codec: str = "json") -> Column:
    """Why a record is discarded, null if it isn't: the checks in the order a consumer makes them."""
    bad = F.when(key.isNull(), "no_key").when(~F.is_valid_utf8(key.cast("string")), "bad_key").when(payload.isNull(), "no_payload")
    if codec == "binary":
        return bad
    if codec == "json_binary":  # identity fields have to be strings where they stand
        v = F.try_parse_json(payload)
        typed = [F.coalesce(F.schema_of_variant(F.variant_get(v, f"$.{f}", "variant")).isin("STRING", "VOID"), F.lit(True)) for f in ("id", "type")]
        return bad.when(v.isNull(), "bad_payload").when(~(typed[0] & typed[1]), "bad_identity")
    return bad.when(F.try_parse_json(payload).isNull(), "bad_payload")


def decode(raw: DataFrame, now_us: int | None = None, codec: str = "json") -> DataFrame:
    """Accepted records of (topic, part, off, raw_key, raw_payload, headers, ts_us) as log rows."""
    now = F.lit(now_us) if now_us is not None else F.unix_micros(F.current_timestamp())
    key, payload = F.col("raw_key").cast("string"), F.col("raw_payload").cast("string")
    kept = raw.where(reject_reason(key, payload, codec).isNull())
    return kept.select("topic", "part", "off", key.alias("key"), F.coalesce("ts_us", now).alias("ts_us"), header(F.col("headers"), "source-system").alias("source_system"), payload.alias("payload"))

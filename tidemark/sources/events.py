"""Typed events: rows to JSON messages of a named schema version, and back.

A schema is a Spark type with the values that its coded fields may have. Messages carry its name and version. Instants are
ISO text in UTC to the microsecond; a time without zone stays without one. Reading back is strict: a message of another
schema or an unknown version, one without a required field, with a field of the wrong kind or a code that is not
allowed is no row but a letter that says why. Fields that a message lacks take the schema's default where it has one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTANT, PLAIN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class Schema:
    name: str
    version: int
    ddl: str
    codes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    #: Versions that can still be read.
    readable: tuple[int, ...] = ()

    @property
    def fields(self) -> list[T.StructField]:
        return list(T.StructType.fromDDL(self.ddl).fields)


def _out(c: Column, kind: T.DataType) -> Column:
    """A value as JSON may hold it: times as text, at any depth."""
    if isinstance(kind, T.TimestampType):
        utc = F.to_utc_timestamp(c, F.current_timezone())
        return F.when(c.isNotNull(), F.concat(F.date_format(utc.cast("timestamp_ntz"), PLAIN), F.lit("+00:00")))
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, PLAIN)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _out(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_out(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _out(v, kind.valueType))
    return c


def _text(kind: T.DataType) -> T.DataType:
    """The kind that ``_out`` gives."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_text(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _text(kind.valueType))
    return kind


def _back(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _back(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_back(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _back(v, kind.valueType))
    return c


def serialised(rows: DataFrame, schema: Schema, key: str | None = None) -> DataFrame:
    """(key, value): a message for each row. A column that the schema names must be there; others are not sent."""
    body = F.struct(F.lit(schema.name).alias("schema"), F.lit(schema.version).alias("schema_version"), *[_out(F.col(f.name).cast(f.dataType), f.dataType).alias(f.name) for f in schema.fields])
    return rows.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def read_back(messages: DataFrame, schema: Schema, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(typed rows, letters (error, message)). Arrays keep their order and their nulls, a null field stays null."""
    v = F.col(value_col)
    wanted = T.StructType([T.StructField(f.name, _text(f.dataType)) for f in schema.fields])
    head = "schema string, schema_version int"
    rows = messages.select(v.alias("_v"), F.json_object_keys(v).alias("_keys"), F.from_json(v, head).alias("_head"), F.from_json(v, T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("_m"))
    typed, errors = {}, []
    for f in schema.fields:
        raw = F.col("_m")[f.name]
        value = _back(raw, f.dataType)
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            errors.append(F.when(raw.isNotNull() & value.isNull(), f"{f.name}: not a time"))
        absent = ~F.array_contains("_keys", f.name)
        if f.name in schema.defaults:
            value = F.when(absent, F.lit(schema.defaults[f.name]).cast(f.dataType) if not isinstance(schema.defaults[f.name], list | tuple) else F.array(*map(F.lit, schema.defaults[f.name])).cast(f.dataType)).otherwise(value)
        elif f.name not in schema.optional:
            errors.append(F.when(absent | raw.isNull(), f"{f.name}: missing"))
        if f.name in schema.codes:
            errors.append(F.when(value.isNotNull() & ~value.isin(*schema.codes[f.name]), F.concat(F.lit(f"{f.name}: unknown code "), value)))
        typed[f.name] = value
    versions = {schema.version, *schema.readable}
    error = (
        F.when(F.col("_keys").isNull(), "not a JSON object").when(F.coalesce(F.col("_head.schema"), F.lit("")) != schema.name, F.concat(F.lit("schema "), F.coalesce("_head.schema", F.lit("none"))))
        .when(~F.coalesce(F.col("_head.schema_version").isin(*versions), F.lit(False)), F.concat(F.lit("version "), F.coalesce(F.col("_head.schema_version").cast("string"), F.lit("none"))))
        .when(F.col("_m._corrupt").isNotNull(), "a field is of the wrong kind").otherwise(F.coalesce(*errors, F.lit(None).cast("string")))
    )
    rows = rows.withColumn("_e", error)
    return rows.filter("_e IS NULL").select(*[c.alias(n) for n, c in typed.items()]), rows.filter("_e IS NOT NULL").select(F.col("_e").alias("error"), F.col("_v").alias("message"))


# Names that the fields' codes may have.
SOURCE_TYPES = ("vk_post", "vk_comment", "max_post", "max_comment", "rss_article", "portal_appeal")
MEDIA_TYPES = ("text", "photo", "video", "link")
STATUSES = ("pass", "review", "drop")

_ENRICHED = (
    "doc_id string, source_type string, source_id string, parent_id string, text string, media_type string, created_at timestamp, collected_at timestamp, author_id string, is_official boolean, "
    "reach long, likes long, reposts long, comments_count long, region_hint string, geo_lat double, geo_lon double, raw_payload string, language string, language_confidence double, is_supported_language boolean, "
    "filter_status string, filter_reasons array<string>, quality_weight double, anomaly_flags array<string>, anomaly_confidence double, normalized_text string, token_count int, cleanup_flags array<string>, "
    "text_sha256 string, duplicate_group_id string, near_duplicate_flag boolean, duplicate_cluster_size long, canonical_doc_id string, region_id string, municipality_id string, geo_confidence double, geo_source string, "
    "geo_evidence array<string>, engagement long, metadata_version string, category string, category_label string, category_confidence double, secondary_category string"
)
_CODES = {"source_type": SOURCE_TYPES, "media_type": MEDIA_TYPES, "filter_status": STATUSES}
_DEFAULTS = {"filter_reasons": [], "anomaly_flags": [], "anomaly_confidence": 0.0, "cleanup_flags": [], "geo_evidence": [], "category": "other", "category_label": "Прочее", "category_confidence": 0.0}
_OPTIONAL = ("parent_id", "region_hint", "geo_lat", "geo_lon", "raw_payload", "region_id", "municipality_id", "secondary_category")

ENRICHED = Schema("enriched_document", 1, _ENRICHED, _CODES, _DEFAULTS, _OPTIONAL)
EMBEDDED = Schema("embedded_document", 1, _ENRICHED + ", embedding array<double>, model_name string, model_version string, embedded_at timestamp, text_used string, truncated boolean", _CODES, _DEFAULTS, _OPTIONAL)
TOPICS_UPDATED = Schema("clusters_updated", 1, "run_at timestamp, period_start timestamp, period_end timestamp, changed_cluster_ids array<string>")
DESCRIPTIONS_UPDATED = Schema("descriptions_updated", 1, "run_at timestamp, updated_cluster_ids array<string>")

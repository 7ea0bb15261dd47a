"""From raw payloads to one document contract.

Payloads are JSON text, read once as VARIANT. A path counts as present when it is there, even
with a null value, and the first present path wins: coalesce would fall through a null.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names a source goes by.
SOURCE_ALIASES = {"vk": "vk", "vkontakte": "vk", "max": "max", "mailru_max": "max", "rss": "rss", "feed": "rss", "portal": "portal", "portals": "portal"}

COLUMNS = (
    "doc_id", "source_type", "source_id", "parent_id", "text", "media_type", "created_at", "collected_at", "author_id", "is_official",
    "reach", "likes", "reposts", "comments_count", "region_hint", "geo_lat", "geo_lon", "raw_payload",
)

# The fields of each source, in order of preference.
FIELDS = {
    "vk": {
        "markers": ("post_id", "parents_stack", "reply_to_comment", "thread"), "container": ("owner_id", "group_id", "peer_id"), "item": ("id", "comment_id"), "post": ("post_id", "thread.post_id"),
        "created": ("created_at", "published_at", "date"), "text": (("text",),), "attachments": ("attachments",), "link": ("short_url", "url"), "author": ("from_id", "author_id", "user_id"),
        "reach": ("views.count", "reach"), "likes": ("likes.count", "likes"), "reposts": ("reposts.count", "reposts"), "comments_count": ("comments.count", "comments_count"),
        "region": ("geo.place.title", "region_hint"), "lat": ("geo.coordinates.latitude", "geo.latitude", "lat"), "lon": ("geo.coordinates.longitude", "geo.longitude", "lon"),
    },
    "max": {
        "markers": ("post_id", "parent_post_id", "reply_to_id"), "container": ("channel.id", "community.id", "chat.id", "source.id"), "item": ("id", "message_id"), "post": ("post_id", "parent_post_id"),
        "created": ("created_at", "published_at", "timestamp"), "text": (("message", "text", "body"),), "attachments": ("attachments", "media"), "link": ("url", "link"), "author": ("author.id", "author_id", "user.id"),
        "region": ("channel.region", "region_hint"), "lat": ("location.lat", "geo.lat", "lat"), "lon": ("location.lon", "geo.lon", "lon"),
    },
    "rss": {
        "item": ("guid", "id", "link", "source_id"), "created": ("published_at", "published", "created_at", "pub_date", "pubDate"),
        "text": (("title",), ("summary", "description"), ("content", "content_text")), "attachments": ("enclosures", "media"), "link": ("link",), "author": ("author.id", "author", "creator"),
        "region": ("region", "region_hint"), "lat": ("geo.lat", "latitude"), "lon": ("geo.lon", "longitude"),
    },
    "portal": {
        "item": ("appeal_id", "request_number", "id", "source_id"), "created": ("created_at", "submitted_at", "published_at"), "text": (("subject", "title"), ("message", "text", "body")),
        "attachments": ("attachments",), "link": ("url", "link"), "author": ("author.id", "user.id", "author_id"),
        "region": ("location.region", "region_hint"), "lat": ("location.lat", "geo.lat", "latitude"), "lon": ("location.lon", "geo.lon", "longitude"),
    },
}
METRICS = {"reach": ("metrics.reach", "reach"), "likes": ("metrics.likes", "likes"), "reposts": ("metrics.reposts", "reposts"), "comments_count": ("metrics.comments", "comments_count")}
COLLECTED = ("collected_at", "fetched_at", "ingested_at")
TYPES = {"vk": ("vk_post", "vk_comment"), "max": ("max_post", "max_comment"), "rss": ("rss_article",) * 2, "portal": ("portal_appeal",) * 2}


def setdefaults(payload: Column, defaults: dict[str, Column]) -> Column:
    """JSON text of the payload with absent keys added; a present null stays."""
    m = F.from_json(payload, "map<string,variant>")
    more = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.parse_json(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})).alias("v"))])
    more = F.transform_values(more, lambda k, v: F.variant_get(v, "$.v", "variant"))
    return F.to_json(F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(m, k)), m), {"ignoreNullFields": "false"})


#: What a raw message lends to its payload where the payload has no such key: key -> field of the message.
DEFAULTS = {
    "source_id": "source_id", "author_id": "author_id", "user_id": "author_id", "text": "text", "body": "text", "message": "text", "parent_id": "parent_id", "created_at": "created_at_utc", "published_at": "created_at_utc",
    "collected_at": "collected_at", "media_type": "media_type", "reach": "reach", "likes": "likes", "reposts": "reposts", "comments_count": "comments_count", "is_official": "is_official",
}


def with_defaults(raw: DataFrame) -> DataFrame:
    """Raw messages with ``raw_payload`` as the normaliser reads it: absent keys come from the message, a present null stays.
    So ``created_at`` of the message comes before a wall post's ``date``, and ``message`` before a body that is not there."""
    kinds = dict(raw.dtypes)

    def value(field: str) -> Column:
        if kinds[field].startswith("timestamp"):
            return F.date_format(F.col(field).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        return F.col(field)

    return raw.withColumn("raw_payload", setdefaults(F.coalesce("raw_payload", F.lit("{}")), {k: value(f) for k, f in DEFAULTS.items()}))


def contract(raw: DataFrame, registry: dict[str, dict]) -> DataFrame:
    """The contract's rows of raw messages of all sources. ``registry``: source type -> configuration, as ``settings.source_config`` resolves it;
    a source type without one is read by the kind that its name starts with."""
    rows = with_defaults(raw)
    names = sorted({t for pair in TYPES.values() for t in pair} | set(registry))
    parts = [normalize(rows.filter(F.col("source_type") == name), registry.get(name) or {"source": name.split("_")[0]}) for name in names]
    return reduce(DataFrame.unionByName, parts)


def present(v: Column, path: str) -> Column:
    return F.variant_get(v, f"$.{path}", "variant").isNotNull()


def pick(v: Column, *paths: str, default: Column | None = None) -> Column:
    """Text of the first present path; null if its value is null."""
    out = F
    for p in paths:
        out = out.when(present(v, p), F.variant_get(v, f"$.{p}", "string"))
    return out.otherwise(F.lit(None).cast("string") if default is None else default)


def as_id(value: Column) -> Column:
    """Trimmed text, whole floats without their point, blank as null."""
    return F.nullif(F.regexp_replace(F.trim(value), r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def as_instant(value: Column, offset: str) -> Column:
    """Epoch seconds, ISO with zone, or ISO without one read in the source's offset. Bad text is an error."""
    t = F.trim(value)
    zone = F.lit("+00:00" if offset.upper() == "UTC" else offset if offset[:1] in "+-" else f"+{offset}")
    naive = ~t.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.when(t.rlike(r"^\d+(?:\.\d+)?$"), F.timestamp_micros((t.cast("decimal(20,6)") * 1_000_000).cast("long"))).when(naive, F.to_timestamp(F.concat(F.regexp_replace(t, " ", "T"), zone))).otherwise(F.to_timestamp(t))


def as_count(value: Column) -> Column:
    t = F.trim(value)
    return F.when(t.isNull() | (t == ""), F.lit(0)).when(t.isin("true", "false"), (t == "true").cast("int")).otherwise(t.cast("double").cast("long")).cast("long")


def as_number(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit("")).cast("double")


def media_type(v: Column, attachments: tuple[str, ...], link: tuple[str, ...]) -> Column:
    raw = pick(v, *attachments)
    items = F.coalesce(F.from_json(raw, "array<map<string,string>>"), F.array(F.from_json(raw, "map<string,string>")))
    kinds = F.transform(F.filter(items, lambda a: a.isNotNull()), lambda a: F.lower(F.trim(
        F.when(F.map_contains_key(a, "type"), a["type"]).when(F.map_contains_key(a, "kind"), a["kind"]).otherwise(F.try_element_at(a, F.lit("media_type"))))))
    has = lambda *ws: F.coalesce(F.exists(kinds, lambda k: F.coalesce(k.rlike("|".join(ws)), F.lit(False))), F.lit(False))
    linked = F.coalesce(pick(v, *link), F.lit("")) != ""
    return F.when(has("video"), "video").when(has("photo", "image"), "photo").when(has("link"), "link").when(linked, "link").otherwise("text")


@F.pandas_udf(T.StringType())
def _print(payloads: pd.Series) -> pd.Series:
    def one(p: str | None) -> str | None:
        return p and hashlib.sha256(json.dumps(json.loads(p), sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()[:16]

    return payloads.map(one)


def fingerprint(payload: Column, where: Column | None = None) -> Column:
    """16 hex digits of the payload's SHA-256, its keys in order at every depth; only ``where`` it is needed."""
    return _print(payload if where is None else F.when(where, payload))


def join_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.nullif(p, F.lit("")) for p in parts])


def normalize(df: DataFrame, config: dict, payload_col: str = "raw_payload") -> DataFrame:
    """The 18 columns of the contract for rows of one source; ``config`` as in a source registry."""
    kind = str(next((config[k] for k in ("source", "source_name", "kind", "type") if k in config), "")).strip().lower()
    kind = SOURCE_ALIASES.get(kind, kind)
    if kind not in FIELDS:
        raise ValueError(f"unsupported source kind: {kind or 'none'}")
    f = METRICS | FIELDS[kind]
    conf = lambda *keys: next((F.lit(str(config[k])) for k in keys if config.get(k) is not None), F.lit(None).cast("string"))
    rows = df.select(F.col(payload_col).alias("_p"), F.parse_json(payload_col).alias("_v"))
    v = F.col("_v")
    own, inside = as_id(pick(v, *f["item"])), as_id(pick(v, *f["container"], default=conf("source_id"))) if kind in ("vk", "max") else F.lit("")
    rows = rows.withColumn("_print", fingerprint(F.col("_p"), own.isNull() | inside.isNull()))
    print_ = F.col("_print")
    item = F.coalesce(own, print_)
    offset = next((str(config[k]) for k in ("timezone", "tz", "utc_offset") if k in config), "+00:00")
    post, plain = TYPES[kind]
    if kind in ("vk", "max"):
        container = F.coalesce(inside, F.concat(F.lit(f"{kind}:"), print_))
        explicit = next((config[k] for k in ("entity_type", "record_type", "object_type") if config.get(k) is not None), None)
        marked = F.lit(str(explicit).strip().lower() == "comment") if explicit is not None else F.coalesce(*[F.nullif(pick(v, m), F.lit("")) for m in f["markers"]]).isNotNull()
        under = as_id(pick(v, *f["post"]))
        comment = marked & under.isNotNull()
        source_id = F.when(comment, join_id(container, under, item)).otherwise(join_id(container, item))
        parent = F.when(comment, join_id(container, under)).otherwise(as_id(pick(v, "parent_id")))
        source_type = F.when(comment, TYPES[kind][1]).otherwise(TYPES[kind][0])
        author_default = container
    else:
        source_id, source_type = item, F.lit(post)
        parent = F.lit(None).cast("string") if kind == "rss" else as_id(pick(v, "parent_id"))
        author_default = conf("feed_id", "source_id") if kind == "rss" else F.lit("anonymous")
    fallback_author = author_default if kind in ("vk", "max", "portal") else F.concat(F.lit("rss:"), F.coalesce(conf("feed_id", "source_id"), F.lit("unknown")))
    created_text = pick(v, *f["created"], default=conf(*f["created"]))
    created = F.when(created_text.isNull(), F.raise_error(F.lit("a payload must have a creation time"))).otherwise(as_instant(created_text, offset))
    collected = pick(v, *COLLECTED, default=conf(*COLLECTED))
    parts = [pick(v, *paths) for paths in f["text"]]
    text = F.coalesce(parts[0], F.lit("")) if len(parts) == 1 else F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])
    rows = rows.select(
        source_type.alias("source_type"), source_id.alias("source_id"), parent.alias("parent_id"), text.alias("text"), media_type(v, f["attachments"], f["link"]).alias("media_type"),
        created.alias("created_at"), F.coalesce(as_instant(collected, offset), created).alias("collected_at"),
        F.coalesce(as_id(pick(v, *f["author"], default=author_default)), fallback_author).alias("author_id"), F.lit(bool(config.get("is_official", False))).alias("is_official"),
        *[as_count(pick(v, *f[m])).alias(m) for m in METRICS],
        as_id(pick(v, *f["region"], default=conf("region_hint", "default_region"))).alias("region_hint"),
        as_number(pick(v, *f["lat"])).alias("geo_lat"), as_number(pick(v, *f["lon"])).alias("geo_lon"), F.col("_p").alias("raw_payload"),
    )
    return rows.select(F.concat_ws(":", "source_type", "source_id").alias("doc_id"), "*").select(*COLUMNS)

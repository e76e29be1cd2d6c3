"""Raw records to nodes, edges and mentions; merges that a replay leaves unchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import VERBS, at_uri_id, english_supported, entity_id, lookup, plausible_entity, strip_nul, strip_tags

NODE = "array<struct<id: string, type: string, platform: string, label: string, metadata: map<string, string>>>"
# The record layouts of the four platforms.
RECORD = "id string, platform string, type string, author string, text string, title string, langs array<string>, tags array<string>, parent_id string, repo string, actor string, created_utc string, created_at string, ingested_at string"


def decode(raw: DataFrame) -> DataFrame:
    """``raw`` (topic, partition, offset, value string) with the record's fields and ``error``: null, or why it is a dead letter."""
    parsed = raw.withColumn("r", F.from_json("value", RECORD + ", _corrupt_record string", {"mode": "PERMISSIVE"}))
    clean = parsed.withColumn("r", strip_nul(F.col("r"), parsed.schema["r"].dataType))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    error = F.when(broken, "not JSON").when(F.coalesce(F.col("r.id"), F.lit("")) == "", "no id")
    return clean.select("topic", "partition", "offset", "value", error.alias("error"), "r.*").drop("_corrupt_record")


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw`` to (records, dead letters), each record once."""
    decoded = decode(raw)
    records = decoded.where("error IS NULL").drop("error", "value")
    first = Window.partitionBy("platform", "id").orderBy("partition", "offset")
    once = records.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return once, decoded.where("error IS NOT NULL").select("topic", "partition", "offset", "error", "value")


def _meta(**values):
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def extract(records: DataFrame) -> DataFrame:
    """Each record with arrays ``nodes`` and ``edges``; unknown platforms give empty ones."""
    r = records.withColumn("body", F.when(F.col("platform") == "mastodon", strip_tags(F.col("text"))).when(F.col("platform") == "hn", F.col("title")).otherwise(F.col("text")))
    pid = lambda c: F.concat(F.col("platform"), F.lit(":"), c)
    user = lambda c: F.concat(F.col("platform"), F.lit(":user:"), c)
    social = F.col("platform").isin("bluesky", "mastodon", "hn")
    ts = F.coalesce(F.try_to_timestamp(F.col("created_at")), F.try_to_timestamp(F.col("ingested_at")))
    node = lambda i, t, label, meta: F.struct(i.alias("id"), F.lit(t).alias("type"), F.col("platform").alias("platform"), label.alias("label"), meta.alias("metadata"))
    edge = lambda a, b, kind: F.struct(a.alias("source_id"), b.alias("target_id"), kind.alias("edge_type"), F.col("platform").alias("platform"), ts.alias("ts"), F.lit(1.0).alias("weight"))
    some = lambda cond, x: F.when(cond, x)
    content, author, parent = pid(F.col("id")), user(F.col("author")), pid(F.col("parent_id"))
    has_parent = F.coalesce(F.col("parent_id"), F.lit("")) != ""
    tags = F.coalesce(F.when(F.col("platform") == "mastodon", F.col("tags")), F.expr("cast(array() as array<string>)"))
    community = lambda t: F.concat(F.lit("mastodon:tag:"), F.lower(t))
    # a stand-in for a named-entity model: runs of capitalised words, as organisations
    spans = F.when(social & (F.col("platform").eqNullSafe("hn") | english_supported(F.col("langs"))), F.filter(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b"), F.lit(1)), plausible_entity)).otherwise(F.expr("cast(array() as array<string>)"))
    ent = lambda s: entity_id(F.lit("ORG"), s)
    keep = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    label = F.when(F.coalesce("body", F.lit("")) == "", F.when(F.col("type") == "repost", "(repost)").otherwise("")).otherwise(F.substring("body", 1, 120))
    empty = F.create_map().cast("map<string,string>")
    nodes = F.when(social, F.concat(
        keep(node(content, "content", label, _meta(created_utc=F.col("created_utc"))), some(F.col("author").isNotNull(), node(author, "author", F.col("author"), empty)), some(has_parent, node(parent, "content", F.lit(""), _meta(placeholder=F.lit("true"))))),
        F.transform(tags, lambda t: node(community(t), "community", F.concat(F.lit("#"), t), empty)),
        F.transform(F.array_distinct(spans), lambda s: node(ent(s), "named_entity", F.trim(s), empty)),
    )).when(F.col("platform") == "github", keep(node(F.concat(F.lit("github:repo:"), F.col("repo")), "repo", F.col("repo"), empty), node(user(F.col("actor")), "author", F.col("actor"), empty)))
    edges = F.when(social, F.concat(
        keep(some(F.col("author").isNotNull(), edge(author, content, F.lit("authored"))), some(has_parent, edge(parent, content, F.lit("reshare")))),
        F.transform(tags, lambda t: edge(content, community(t), F.lit("posted_to"))),
        F.transform(spans, lambda s: edge(content, ent(s), F.lit("mentions"))),
    )).when(F.col("platform") == "github", F.array(edge(user(F.col("actor")), F.concat(F.lit("github:repo:"), F.col("repo")), lookup(VERBS, F.col("type"), "interacted"))))
    return r.withColumn("nodes", F.coalesce(nodes, F.array().cast(NODE))).withColumn("edges", F.coalesce(edges, F.expr("cast(array() as array<struct<source_id: string, target_id: string, edge_type: string, platform: string, ts: timestamp, weight: double>>)")))


def merge_nodes(arrivals: DataFrame) -> DataFrame:
    """Upsert by (id, platform) over ``arrival``: type and first_seen stay, empty labels and placeholder metadata never overwrite."""
    real = ~F.coalesce(F.map_contains_key("metadata", F.lit("placeholder")), F.lit(False))
    return arrivals.groupBy("id", "platform").agg(
        F.min_by("type", "arrival").alias("type"),
        F.coalesce(F.max_by("label", F.when(F.col("label") != "", F.col("arrival"))), F.lit("")).alias("label"),
        F.coalesce(F.max_by("metadata", F.when(real, F.col("arrival"))), F.min_by("metadata", "arrival")).alias("metadata"),
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
    )


def merge_edges(arrivals: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First arrival of each (source, target, platform, ts); known ones are left out."""
    key = ["source_id", "target_id", "platform", "ts"]
    first = arrivals.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("arrival"))).where("n = 1").drop("n")
    if existing is None:
        return first
    return first.join(existing.select(*key), [first[c].eqNullSafe(existing[c]) for c in key], "left_anti")


def flatten_commits(raw: DataFrame) -> DataFrame:
    """(id, author, text, uri) of creates in a firehose of commits (value, JSON); records without a three-part address are dropped."""
    c = raw.select(F.from_json("value", "did string, commit struct<operation: string, collection: string, rkey: string, record: struct<text: string>>").alias("c")).select("c.did", "c.commit.*")
    uri = F.concat_ws("/", F.concat(F.lit("at://"), "did"), "collection", "rkey")
    flat = c.where("operation = 'create'").select(F.regexp_replace(at_uri_id(uri), "^bluesky:", "").alias("id"), F.col("did").alias("author"), "record.text", uri.alias("uri"))
    return flat.where("id IS NOT NULL")


# Fixed value: the layout of a status on a public timeline.
STATUS = "id string, content string, language string, in_reply_to_id string, url string, created_at string, account struct<acct: string>, tags array<struct<name: string>>, reblogs_count long, favourites_count long, reblog struct<id: string, language: string>"


def flatten_statuses(raw: DataFrame) -> DataFrame:
    """Records of the statuses (value, JSON) that have a text or come from another; a boost's language may be that of what it boosts."""
    s = raw.select(F.from_json("value", STATUS).alias("s")).select("s.*")
    known = lambda c: F.nullif(c, F.lit(""))
    parent = F.coalesce(known(F.col("reblog.id")), known(F.col("in_reply_to_id")))
    flat = s.select(
        "id", F.when(F.col("reblog").isNotNull(), "boost").otherwise("status").alias("type"), F.lit("mastodon").alias("platform"), strip_tags(F.coalesce("content", F.lit(""))).alias("text"), F.col("account.acct").alias("author"),
        F.coalesce(F.transform("tags", lambda t: t["name"]), F.array().cast("array<string>")).alias("tags"), parent.alias("parent_id"), F.array(F.coalesce(known(F.col("language")), known(F.col("reblog.language")), F.lit(""))).alias("langs"),
        F.coalesce("reblogs_count", F.lit(0)).alias("reblogs"), F.coalesce("favourites_count", F.lit(0)).alias("favourites"), "url", F.col("created_at").alias("created_utc"),
    )
    return flat.where("id IS NOT NULL AND (text <> '' OR parent_id IS NOT NULL)")


def without_prefix(tables: dict[str, DataFrame], ends: dict[str, list[str]], prefix: str) -> dict[str, DataFrame]:
    """``tables`` without the rows that name an id beginning with ``prefix`` in any of their ``ends``; nulls name nothing."""
    named = lambda columns: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).startswith(prefix), F.lit(False)) for c in columns])
    return {name: df.where(~named(ends[name])) for name, df in tables.items()}

"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, DoubleType, MapType, StringType, StructType

from .tails import log_tails

REVIEW_BELOW = 0.55
# Edge names of code-host events, short codes of platforms, and addresses of nodes.
VERBS = {"WatchEvent": "watched", "ForkEvent": "forked", "PushEvent": "pushed", "CreateEvent": "created"}
CODES = {"hn": "hn", "github": "gh", "gh": "gh", "bluesky": "bsky", "bsky": "bsky", "mastodon": "mdn", "mdn": "mdn"}
REPO_URL, ITEM_URL, SEARCH_URL = "https://github.com/", "https://news.ycombinator.com/item?id=", "https://hn.algolia.com/?q="


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def short_code(platform: Column) -> Column:
    """A platform's code in lists; of an unknown one its first four characters."""
    return F.coalesce(lookup(CODES, F.lower(platform)), F.substring(platform, 1, 4))


def english_supported(langs: Column) -> Column:
    """No languages given, or one of them English; a tag counts up to its first hyphen."""
    return F.coalesce(F.size(langs) == 0, F.lit(True)) | F.coalesce(F.exists(langs, lambda x: F.lower(F.substring_index(x, "-", 1)) == "en"), F.lit(False)) | langs.isNull()


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def plausible_entity(text: Column) -> Column:
    """Once stripped: 1 to 60 characters, no line ends or URLs, some letter."""
    t = stripped(text)
    return F.coalesce(F.length(t).between(1, 60) & ~t.rlike(r"[\n\r]") & ~t.contains("://") & ~F.lower(t).startswith("www.") & t.rlike(r"\p{L}"), F.lit(False))


def entity_id(label: Column, text: Column) -> Column:
    return F.concat(F.lit("entity:"), F.lower(label), F.lit(":"), F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_")))


def strip_nul(value: Column, kind: DataType) -> Column:
    """A parsed value of that type without NUL characters, in texts, keys and lists however deep."""
    if isinstance(kind, StringType):
        return F.translate(value, "\x00", "")
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: strip_nul(x, kind.elementType))
    if isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(strip_nul(e["key"], kind.keyType).alias("key"), strip_nul(e["value"], kind.valueType).alias("value")))
        # of keys that become equal the last one stays
        kept = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
        return F.when(value.isNotNull(), F.map_from_entries(kept))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[strip_nul(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def needs_review(confidence: Column) -> Column:
    return confidence < REVIEW_BELOW


def verdict_probability(verdict: Column, confidence: Column) -> Column:
    """Probability of coordination that a verdict and its confidence stand for."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.when(verdict == "coordinated_amplification", c).when(verdict == "organic", 1 - c).otherwise(F.lit(0.5))


def node_url(node_id: Column, kind: Column, label: Column, url: Column | None = None) -> Column:
    """Where a node can be looked at: repositories, posts by their own ``url`` or as items, names by a search."""
    after = lambda prefix: F.substring(node_id, len(prefix) + 1, F.length(node_id))
    own = F.lit(None).cast("string") if url is None else url
    item = F.when(node_id.startswith("hn:"), F.concat(F.lit(ITEM_URL), after("hn:")))
    return (
        F.when((kind == "repo") & node_id.startswith("github:repo:"), F.concat(F.lit(REPO_URL), after("github:repo:")))
        .when(kind == "content", F.coalesce(F.nullif(own, F.lit("")), item))
        .when(kind == "named_entity", F.concat(F.lit(SEARCH_URL), F.replace(label, F.lit(" "), F.lit("+"))))
    )


def at_uri_id(uri: Column) -> Column:
    """``at://did/collection/rkey`` as ``bluesky:did_rkey``; null unless it has three parts."""
    parts = F.split(F.regexp_replace(uri, "^at://", ""), "/")
    return F.when(uri.startswith("at://") & (F.size(parts) == 3), F.concat(F.lit("bluesky:"), parts[0], F.lit("_"), parts[2]))


def id_at_uri(node_id: Column) -> Column:
    """The inverse of ``at_uri_id``, split at the first underscore; null for what is no such id."""
    raw = F.regexp_replace(node_id, "^bluesky:", "")
    did, key = F.substring_index(raw, "_", 1), F.regexp_extract(raw, r"(?s)^[^_]*_(.*)$", 1)
    return F.when(did.startswith("did:") & (key != ""), F.concat(F.lit("at://"), did, F.lit("/app.bsky.feed.post/"), key))


def parsed_verdict(reply: Column) -> Column:
    """The JSON object of a model's reply, without its thinking: the first fenced one, else from the first brace to the last; empty if none."""
    plain = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(plain, r"(?s)\{.*\}", 0))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as floating point has it: by 0 an infinity, and 0 by 0 no number."""
    endless = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when((b == 0) & a.isNotNull() & ~F.isnan(a), endless).otherwise(F.try_divide(a, b))


@pandas_udf(DoubleType())
def poisson_tail(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= k) of a Poisson distribution."""
    return pd.Series(np.exp(log_tails(k, mean))).where(k.notna().to_numpy() & mean.notna().to_numpy())

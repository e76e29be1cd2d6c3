"""Verdicts of a language model on anomalies: parsing, grounding in tool results, case files and open anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import needs_review, parsed_verdict

# The classes a verdict may name, the keys it must have, the cap without evidence, what is said then, and the tool about other nodes.
CLASSES = ["organic", "coordinated_amplification", "uncertain"]
KEYS = ["classification", "confidence", "signals", "reasoning_steps"]
UNPROVEN = 0.3
NOTHING_FOUND = "the tools found no graph evidence for this node"
ABOUT_OTHERS = "search_similar_trends"
TOPICS = ["entity:", "github:repo:"]


def is_topic(node_id: Column) -> Column:
    """Whether a node stands for a topic and not for one post."""
    return F.coalesce(F.lit(False) | node_id.startswith(TOPICS[0]) | node_id.startswith(TOPICS[1]), F.lit(False))


def _as_number(value: Column, kind: Column) -> Column:
    """A JSON value as a float: numbers, true and false, and texts that are numbers; else null."""
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    named = F.when(text.rlike(r"(?i)^[+-]?(inf|infinity|nan)$"), F.lower(text)).when(text.rlike(r"^[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?$"), F.replace(text, F.lit("_"), F.lit("")))
    return F.when(kind == "BOOLEAN", (value == "true").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") | (kind == "STRING"), named.try_cast("double"))


def _as_list(found: Column, value: Column, kind: Column) -> Column:
    """A JSON value as a list of texts: an array's elements, an object's keys, a text's characters; else null."""
    items = F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    return F.when(kind.startswith("ARRAY"), items).when(kind.startswith("OBJECT"), F.json_object_keys(F.to_json(found))).when(kind == "STRING", signs)


def verdicts(replies: DataFrame) -> DataFrame:
    """``replies`` (.., reply, events) with valid, classification, confidence, signals, reasoning_steps and evidence.

    ``events``: array of (tool, summary, empty), the results that tools gave before the reply.
    A reply counts if it names all four keys in one JSON object (the first fenced one, or from
    the first brace to the last), if its confidence is a number and signals and steps are lists,
    and if any tool was called; else the rest is null. Classes are taken as they are written,
    others are uncertain. Evidence is what tools said. Where no tool found anything about the
    node itself, the verdict is uncertain, not surer than 0.3, and says so first.
    """
    raw = F.try_parse_json(parsed_verdict(F.col("reply")))
    out = replies.withColumn("json_", F.when(F.schema_of_variant(raw).startswith("OBJECT"), raw))
    names = {k: f"{k}_" for k in KEYS}
    out = out.withColumns({v: F.try_variant_get("json_", f"$.{k}", "variant") for k, v in names.items()})
    kind = {k: F.schema_of_variant(v) for k, v in names.items()}
    text = {k: F.try_variant_get(v, "$", "string") for k, v in names.items()}
    there = F.json_object_keys(F.to_json("json_"))
    complete = F.coalesce(F.size(F.array_intersect(there, F.array(*map(F.lit, KEYS)))) == len(KEYS), F.lit(False))
    lists = {k: _as_list(F.col(names[k]), text[k], kind[k]) for k in ("signals", "reasoning_steps")}
    events = F.coalesce("events", F.expr("cast(array() as array<struct<tool: string, summary: string, empty: boolean>>)"))
    grounded = F.exists(events, lambda e: (e["tool"] != ABOUT_OTHERS) & ~F.coalesce(e["empty"], F.lit(False)))
    number = _as_number(text["confidence"], kind["confidence"])
    out = out.withColumns({"confidence_n": number, "signals_l": lists["signals"], "steps_l": lists["reasoning_steps"], "grounded_": grounded, "called_": F.size(events) > 0})
    named = F.when((kind["classification"] == "STRING") & text["classification"].isin(CLASSES), text["classification"]).otherwise("uncertain")
    valid = complete & F.col("confidence_n").isNotNull() & F.col("signals_l").isNotNull() & F.col("steps_l").isNotNull() & F.col("called_")
    bare = ~F.col("grounded_")
    columns = {
        "classification": F.when(bare, "uncertain").otherwise(named),
        "confidence": F.when(bare, F.when(F.isnan("confidence_n"), F.col("confidence_n")).otherwise(F.least("confidence_n", F.lit(UNPROVEN)))).otherwise(F.col("confidence_n")),
        "signals": F.when(bare, F.concat(F.array(F.lit(NOTHING_FOUND)), "signals_l")).otherwise(F.col("signals_l")),
        "reasoning_steps": F.col("steps_l"),
        "evidence": F.transform(events, lambda e: F.concat(e["tool"], F.lit(": "), F.coalesce(e["summary"], F.lit("")))),
    }
    out = out.withColumn("valid", valid).withColumns({c: F.when(valid, x) for c, x in columns.items()})
    return out.drop("json_", *names.values(), "confidence_n", "signals_l", "steps_l", "grounded_", "called_")


def case_files(judged: DataFrame) -> DataFrame:
    """The case files to append: one for each valid verdict; an anomaly without one stays open."""
    similar = F.to_json("similar_past_cases") if "similar_past_cases" in judged.columns else F.lit("[]")
    return judged.where("valid").select(
        "anomaly_id", F.col("node_id").alias("trend"), F.col("platform").alias("platform_origin"), "classification", "confidence", F.to_json("signals").alias("signals"), similar.alias("similar_past_cases"),
        F.size("reasoning_steps").alias("agent_reasoning_steps"), F.to_json("reasoning_steps").alias("reasoning_steps_detail"), needs_review(F.col("confidence")).alias("needs_review"),
    )


def still_open(anomalies: DataFrame, cases: DataFrame) -> DataFrame:
    return anomalies.join(cases.select("anomaly_id").distinct(), "anomaly_id", "left_anti")


def case_view(cases: DataFrame, nodes: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Each case with its node (by id and platform) and its anomaly, where there are such."""
    n = nodes.select(F.col("id").alias("node_id"), "platform", "label")
    return cases.join(n, ["node_id", "platform"], "left").join(anomalies.select("anomaly_id", "score"), "anomaly_id", "left")


def audit(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected ids (id) that are missing among ``nodes`` (id, placeholder) or known as placeholders only."""
    known = nodes.groupBy("id").agg(F.min("placeholder").alias("placeholder"))
    return expected.join(known, "id", "left").where("placeholder IS NULL OR placeholder").select("id", F.col("placeholder").isNull().alias("missing"))

"""Entities and relations of records: validity, knowledge graph and label sequences, on nested columns where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarlake.functions import fixed


def label_key(x) -> Column:
    """A label in lower case with single blanks and without outer signs."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r"^[ .,;:-]+|[ .,;:-]+$", "")


def signature(relation: Column, head: Column, tail: Column) -> Column:
    """Whether a relation may hold between entities of these types; a literal table of eleven rows."""
    allowed = [f"{r}|{h}|{t}" for r, heads, tails in fixed.SIGNATURES for h in heads for t in tails]
    return F.concat_ws("|", relation, head, tail).isin(*allowed)


def flags(df: DataFrame) -> DataFrame:
    """(record_id, flag) of what is wrong with a record's spans and relations, without an exchange."""
    e, r, text = F.col("entities"), F.col("relations"), F.col("full_text")
    ids = F.transform(e, lambda v: v["entity_id"])
    size = F.length(text)
    checks = {
        "span_outside_text": F.exists(e, lambda v: (v["start_pos"] < 0) | (v["end_pos"] > size) | (v["start_pos"] >= v["end_pos"])),
        "span_text_differs": F.exists(e, lambda v: F.substring(text, v["start_pos"] + 1, v["end_pos"] - v["start_pos"]) != v["text"]),
        "repeated_entity_id": F.size(F.array_distinct(ids)) < F.size(ids),
        "endpoint_missing": F.exists(r, lambda v: ~F.array_contains(ids, v["source_entity_id"]) | ~F.array_contains(ids, v["target_entity_id"])),
        "no_entities": F.size(e) == 0,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())
    return df.select("record_id", F.explode(found).alias("flag"))


def mentions(records: DataFrame) -> DataFrame:
    """(record_id, entity_id, label, type) of each entity."""
    return records.select("record_id", F.explode("entities").alias("e")).select("record_id", "e.entity_id", label_key(F.col("e.text")).alias("label"), F.col("e.entity_type").alias("type"))


def resolved_relations(records: DataFrame) -> DataFrame:
    """Each relation with its head's id, the labels and types of its ends, and ``problem``: null, endpoint_missing or signature.

    The ends are found in the record's own array, so nothing is exchanged.
    """
    end = lambda name: F.get(F.filter("entities", lambda v: v["entity_id"] == F.col(f"r.{name}")), F.lit(0))
    rows = records.select("record_id", "entities", F.explode("relations").alias("r")).withColumn("a", end("source_entity_id")).withColumn("b", end("target_entity_id"))
    problem = F.when(F.col("a").isNull() | F.col("b").isNull(), "endpoint_missing").when(~signature(F.col("r.relation_type"), F.col("a.entity_type"), F.col("b.entity_type")), "signature")
    return rows.select(
        "record_id", F.col("r.source_entity_id").alias("head"), F.col("r.relation_type").alias("relation"), label_key(F.col("a.text")).alias("source"), F.col("a.entity_type").alias("source_type"),
        label_key(F.col("b.text")).alias("target"), F.col("b.entity_type").alias("target_type"), problem.alias("problem"),
    )


EDGE = ["source", "source_type", "relation", "target", "target_type"]


def nodes(records: DataFrame) -> DataFrame:
    """(label, type, mention_count, record_count); the distinct count is over record-label pairs, aggregated twice."""
    once = mentions(records).groupBy("label", "type", "record_id").agg(F.count("*").alias("n"))
    return once.groupBy("label", "type").agg(F.sum("n").alias("mention_count"), F.count("*").alias("record_count"))


def edge_evidence(records: DataFrame) -> DataFrame:
    """(edge, record_id), one row for each record that supports an edge: a table, since a frequent edge's list has no bound."""
    return resolved_relations(records).filter("problem is null").select(*EDGE, "record_id").distinct()


def edges(records: DataFrame) -> DataFrame:
    return edge_evidence(records).groupBy(*EDGE).agg(F.count("*").alias("record_count"))


#: Relations of an action to an issue, with the kind that views name them by.
ISSUE_KINDS = {"ACTION_ADDRESSES_ISSUE": "addresses", "ACTION_INVESTIGATES_ISSUE": "investigates"}


def issue_kind() -> Column:
    return F.coalesce(*[F.when(F.col("relation") == r, k) for r, k in ISSUE_KINDS.items()])


def view(records: DataFrame, least: int, *relations: str) -> DataFrame:
    """Every edge of these relations that ``least`` records or more support."""
    return edges(records).filter(F.col("relation").isin(*relations) & (F.col("record_count") >= least))


def solutions(records: DataFrame, least: int) -> DataFrame:
    """(issue, action, item, kind, record_count): an action on an issue with each item of the same mention of the action; '' where it has none."""
    valid = resolved_relations(records).filter("problem is null")
    on = valid.filter(F.col("relation").isin("ACTION_ON_ITEM", "ACTION_USES_ITEM")).select("record_id", "head", F.col("target").alias("item")).distinct()
    issues = valid.filter(F.col("relation").isin(*ISSUE_KINDS)).select("record_id", "head", F.col("target").alias("issue"), F.col("source").alias("action"), issue_kind().alias("kind"))
    once = issues.join(on, ["record_id", "head"], "left").select("record_id", "issue", "action", F.coalesce("item", F.lit("")).alias("item"), "kind").distinct()
    return once.groupBy("issue", "action", "item", "kind").agg(F.count("*").alias("record_count")).filter(F.col("record_count") >= least)


def spans_of_bio(df: DataFrame, key: list[str], bio: str = "bio") -> DataFrame:
    """(key, type, begin, end) of a tag sequence: a span begins at B-, or at an I- that doesn't go on with the tag before.

    Within the array: the begins by index, and for each the next index that isn't its I-.
    """
    tags = F.transform(F.col(bio), lambda v: F.coalesce(v, F.lit("O")))
    kind = lambda v: F.substring(v, 3, 1000)
    rows = df.select(*key, tags.alias("_t"), F.posexplode(tags).alias("begin", "tag")).filter("tag <> 'O'")
    before = F.when(F.col("begin") > 0, F.get(F.col("_t"), F.col("begin") - 1)).otherwise("O")
    starts = rows.filter((F.substring("tag", 1, 2) == "B-") | (before == "O") | (kind(before) != kind(F.col("tag"))))
    after = F.transform(F.slice("_t", F.col("begin") + 2, F.size("_t")), lambda v: v == F.concat(F.lit("I-"), kind(F.col("tag"))))
    run = F.array_position(after, F.lit(False))
    end = F.col("begin") + F.when(run == 0, F.size(after) + 1).otherwise(run)
    return starts.select(*key, kind(F.col("tag")).alias("type"), F.col("begin").cast("long").alias("begin"), end.cast("long").alias("end"))


def bio_of_spans(tokens: str, entities: str) -> Column:
    """The tag sequence of token spans; of overlapping ones the first in the array counts."""
    place = F.sequence(F.lit(0), F.size(tokens) - 1)
    tag = lambda i: F.get(F.filter(F.col(entities), lambda v: (v["start_pos"] <= i) & (i < v["end_pos"])), F.lit(0))
    one = lambda i: F.when(tag(i).isNull(), "O").when(tag(i)["start_pos"] == i, F.concat(F.lit("B-"), tag(i)["entity_type"])).otherwise(F.concat(F.lit("I-"), tag(i)["entity_type"]))
    return F.when(F.size(tokens) > 0, F.transform(place, one)).otherwise(F.array().cast("array<string>"))


def flattened(entities: str) -> Column:
    """Spans without overlaps: in order of their begins, the longest first of those that begin together, each that begins behind the last one kept."""
    order = F.array_sort(F.col(entities), lambda a, b: F.when(a["start_pos"] != b["start_pos"], a["start_pos"] - b["start_pos"]).otherwise(b["end_pos"] - a["end_pos"]))
    start = F.slice(order, 1, 0)
    return F.aggregate(order, start, lambda kept, v: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end_pos"] <= v["start_pos"], F.lit(True)), F.concat(kept, F.array(v))).otherwise(kept))


def without_types(df: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """Rows of (entities, relations by place) without the spans of some types; relations keep their ends under the new places, or go with them."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("entities") - 1, F.lit(0))), lambda i: F.coalesce(~F.get("entities", i)["entity_type"].isin(*dropped), F.lit(False)))
    rows = df.withColumn("_keep", places)
    at = lambda i: (F.array_position("_keep", i) - 1).cast("int")
    stay = F.filter("relations", lambda r: F.array_contains("_keep", r["head_pos"]) & F.array_contains("_keep", r["tail_pos"]))
    moved = F.transform(stay, lambda r: F.struct(r["relation_type"].alias("relation_type"), at(r["head_pos"]).alias("head_pos"), at(r["tail_pos"]).alias("tail_pos")))
    return rows.withColumn("relations", moved).withColumn("entities", F.filter("entities", lambda v: ~v["entity_type"].isin(*dropped))).drop("_keep")


def enumerated_spans(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """(..., begin, end) of every span of up to ``most`` tokens, from the row itself."""
    rows = df.withColumn("begin", F.explode(F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1))))
    return rows.withColumn("end", F.explode(F.sequence(F.col("begin") + 1, F.least(F.col("begin") + most, F.size(tokens)))))


def character_span(tokens: str, begin: Column, end: Column) -> tuple[Column, Column]:
    """A token span's places in the tokens' text, with one blank between tokens."""
    upto = lambda n: F.length(F.array_join(F.slice(tokens, 1, n), " "))
    return F.when(begin == 0, 0).otherwise(upto(begin) + 1), upto(end)


def snapped(tokens: str, begin: Column, end: Column) -> tuple[Column, Column]:
    """The least token span that holds two places of the tokens' text: what a marking that cuts words is widened to."""
    ends = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.length(F.array_join(F.slice(tokens, 1, n), " ")))
    return F.size(F.filter(ends, lambda v: v <= begin)), F.size(F.filter(ends, lambda v: v < end)) + 1


def projected(text: Column, begin: Column, end: Column) -> tuple[Column, Column, Column]:
    """(begin, end, text) of a span in the canonical form of its text: lower case, single blanks, none outside."""
    space = r"[\s\p{Z}]+"
    place = lambda n: F.length(F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(1), n), f"^{space}", ""), space, " "))
    canonical = F.lower(F.trim(F.regexp_replace(text, space, " ")))
    return place(begin), place(end), F.substring(canonical, place(begin) + 1, place(end) - place(begin))

"""Queries of the subpackage: name to (session, folder) -> DataFrame. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hangarlake.llm import canonicalmap, chosenpath, crosssplit, exactcopies, groupsplits, seedleaks, sharedspans, sourcemix, truncation


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return exactcopies.formatting_copies(table(spark, folder, "maintenance_record"))


def p1_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return exactcopies.copy_counts(table(spark, folder, "maintenance_record"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated_fields(table(spark, folder, "maintenance_record"))


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "maintenance_record"))


_FIELDS = {"components": "component", "fault_surfaces": "fault"}


def _aliases(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, "abbreviation").select("abbrev", "expansion"), table(spark, folder, "misspelling").select("misspelling", "correction")]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonicalmap.map_values(table(spark, folder, "structure_case"), table(spark, folder, "canonical_term"), _aliases(spark, folder), _FIELDS)


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return canonicalmap.unmatched_values(table(spark, folder, "structure_case"), table(spark, folder, "canonical_term"), _aliases(spark, folder), _FIELDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return groupsplits.broken_units(table(spark, folder, "maintenance_record"))


def p4_assign(spark: SparkSession, folder: str) -> DataFrame:
    return groupsplits.grouped_splits(table(spark, folder, "maintenance_record"), table(spark, folder, "split_target"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return groupsplits.split_shares(table(spark, folder, "maintenance_record"), table(spark, folder, "split_target"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = chosenpath.near_duplicate_groups(table(spark, folder, "maintenance_record"), "record_id", "full_text", k=3, threshold=0.5)
    return groups.filter("group_id <> record_id")


def p5_problem_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by problem_text with the general parameters: five words, likeness 0.8."""
    return chosenpath.near_duplicate_groups(table(spark, folder, "maintenance_record"), "record_id", "problem_text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.cross_split_pairs(table(spark, folder, "maintenance_record"), k=3, threshold=0.5)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.overlap_report(table(spark, folder, "maintenance_record"), k=3, threshold=0.5)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    passages = seedleaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_item"))
    return passages.filter("longest_run >= 12").select("item_id", "doc_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return seedleaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return sourcemix.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return sourcemix.mix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sharedspans.shared_span_pairs(table(spark, folder, "documents"))


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    return sharedspans.shared_parts(table(spark, folder, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1:2].isdigit()}

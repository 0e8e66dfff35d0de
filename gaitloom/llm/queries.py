"""Queries and oracle SQL of the training-data problems, added by the entry module if this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import table
from . import ann, bpe, copies, language, near, packing, residue, targets, varied


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "motion_index"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "motion_index"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    available = targets.candidates(table(spark, d, "motion_index"), table(spark, d, "motion_entry"))
    return targets.unmet_targets(available, table(spark, d, "sample_target")).select("plan_id", "dataset", "action_category")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    available = targets.candidates(table(spark, d, "motion_index"), table(spark, d, "motion_entry"))
    return targets.calibrated_sample(available, table(spark, d, "sample_target"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    available = targets.candidates(table(spark, d, "motion_index"), table(spark, d, "motion_entry"))
    return targets.sample_report(available, table(spark, d, "sample_target"))


def p2_targets(spark: SparkSession, d: str) -> DataFrame:
    available = targets.candidates(table(spark, d, "motion_index"), table(spark, d, "motion_entry"))
    return targets.target_report(available, table(spark, d, "sample_target"))


def p2_margins(spark: SparkSession, d: str) -> DataFrame:
    available = targets.candidates(table(spark, d, "motion_index"), table(spark, d, "motion_entry"))
    return targets.margin_sample(available, table(spark, d, "sample_target"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicates(table(spark, d, "motion_index"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.groups(table(spark, d, "motion_index"))


def p3_weighted(spark: SparkSession, d: str) -> DataFrame:
    # pairs are banded by the very similarity they are held against, so shorter bands lose less (3 of a million pairs at 0.8)
    pairs = near.scored_duplicates(table(spark, d, "motion_index"), measure="weighted", n=5, bands=24, rows=4)
    return pairs.select("record_a", "record_b", F.round("similarity", 6).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ann.mutual_pairs(table(spark, d, "semantic_index"))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest_of_queries(table(spark, d, "semantic_index"), F.col("vec_id") % 100 == 0)


def p4_all(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest_of_all(table(spark, d, "semantic_index")).select("vec_id", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "motion_index")).select("record_id", "slot")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "motion_index"))


def p5_index(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "motion_index"))


def p6_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied.varied_subset(table(spark, d, "motion_index"), table(spark, d, "motion_entry"), table(spark, d, "subset_request"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_or_mixed(table(spark, d, "documents"))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    found = language.identify(table(spark, d, "documents"))
    return found.where("seg_no = 0 or mixed").select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"))


_FORCE = """
SELECT object_id, classification.taxonomy['action_category'] AS action_category
FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY classified_at DESC NULLS LAST, entry_no DESC) AS rn
      FROM motion_entry WHERE object_id IS NOT NULL) WHERE rn = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p2_sample, p2_report, p2_targets, p2_margins, p3_found, p3_groups, p3_weighted, p4_found, p4_nearest, p4_all, p5_found, p5_kinds, p5_index, p6_subset, p7_ids, p8_containers, p8_report, p9_found, p9_languages)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
WITH force AS ({_FORCE}),
cand AS (SELECT DISTINCT m.object_id, lower(trim(m.dataset)) AS dataset, f.action_category
         FROM motion_index m JOIN force f ON m.object_id = f.object_id WHERE m.dataset IS NOT NULL),
have AS (SELECT dataset, action_category, count(*) AS n FROM cand GROUP BY ALL)
SELECT t.plan_id, t.dataset, t.action_category
FROM sample_target t LEFT JOIN have h ON h.dataset = t.dataset AND h.action_category = t.action_category
WHERE coalesce(h.n, 0) < greatest(t.min_rows, round(t.target_share * t.sample_size))""",
        "p2_targets": f"""
WITH force AS ({_FORCE}),
cand AS (SELECT DISTINCT m.object_id, lower(trim(m.dataset)) AS dataset, f.action_category
         FROM motion_index m JOIN force f ON m.object_id = f.object_id WHERE m.dataset IS NOT NULL),
have AS (SELECT dataset, action_category, count(*) AS n FROM cand GROUP BY ALL),
told AS (SELECT t.*, CAST(greatest(min_rows, round(target_share * sample_size)) AS BIGINT) AS requested, coalesce(h.n, 0) AS available
         FROM sample_target t LEFT JOIN have h ON h.dataset = t.dataset AND h.action_category = t.action_category)
SELECT plan_id, sample_size, dataset, action_category, target_share, min_rows, requested, available, available >= requested AS met FROM told""",
        "p6_subset": varied.ORACLE,
    }

"""Retrieval quality: relevance, MRR, nDCG, recall, duplicate rate, grouped means, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.runtime import bounded

#: Evaluation cases are configuration; more of them in one run are an error.
MOST_CASES = 100_000


def relevance(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Result rows with ``relevant`` and ``forbidden`` (patterns against "dataset/motion_id description", any case).

    ``cases`` is a bounded request table: ``query_id, relevant_ids, patterns, forbidden_ids, forbidden_patterns, relevant_total``.
    """
    place = F.concat("dataset", F.lit("/"), "motion_id")
    said = F.concat(place, F.lit(" "), "description")
    hit = lambda ids, patterns, body: F.array_contains(ids, F.col("object_id")) | F.exists(patterns, lambda p: F.regexp_like(body, F.concat(F.lit("(?i)"), p)))
    return runs.join(bounded(cases, MOST_CASES), "query_id").withColumn("relevant", hit("relevant_ids", "patterns", said)).withColumn("forbidden", hit("forbidden_ids", "forbidden_patterns", place))


def query_metrics(judged: DataFrame) -> DataFrame:
    """One row per query; hits beyond the relevant total don't count."""
    total = F.greatest(F.coalesce("relevant_total", F.when(F.size("patterns") > 0, F.lit(10)).otherwise(F.size("relevant_ids"))), F.lit(1))
    series = X.series_key("dataset", F.lower("motion_id"))
    key = F.when(F.length(series) > 0, series).otherwise(F.concat("dataset", F.lit("/"), F.lower("motion_id")))
    per = judged.withColumn("total", total).withColumn("key", key).groupBy("query_id", "language", "query_type", "total").agg(
        F.array_sort(F.collect_list(F.when(F.col("relevant"), F.col("rank")))).alias("all_ranks"),
        F.count_if((F.col("rank") <= 10) & F.col("forbidden")).alias("forbidden_hits_at_10"),
        F.count_if(F.col("rank") <= 10).alias("shown"),
        F.count_distinct(F.when(F.col("rank") <= 10, F.col("key"))).alias("keys"),
    )  # a run holds at most 50 rows a query
    ranks = F.slice("all_ranks", F.lit(1), F.col("total"))
    first = F.when(F.size("ranks") > 0, F.col("ranks")[0])
    gain = F.aggregate(F.filter("ranks", lambda r: r <= 10), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(10))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + F.lit(1.0)))
    return per.withColumn("ranks", ranks).select(
        "query_id",
        "language",
        "query_type",
        F.coalesce(first <= 5, F.lit(False)).alias("hit_at_5"),
        F.coalesce(F.when(first <= 10, 1.0 / first), F.lit(0.0)).alias("mrr_at_10"),
        (gain / ideal).alias("ndcg_at_10"),
        F.least(F.size("ranks") / F.col("total"), F.lit(1.0)).alias("recall_at_50"),
        ((F.col("shown") - F.col("keys")) / F.greatest("shown", F.lit(1))).alias("duplicate_rate_at_10"),
        "forbidden_hits_at_10",
    )


def metric_means(rows: DataFrame) -> DataFrame:
    """Means over all queries, by language and by type (grouping sets)."""
    return rows.sparkSession.sql(
        """SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(query_type) = 0 THEN 'query_type' ELSE 'all' END AS grp,
                  coalesce(language, query_type, 'all') AS value, count(*) AS query_count,
                  round(avg(CAST(hit_at_5 AS DOUBLE)), 6) AS hit_at_5, round(avg(mrr_at_10), 6) AS mrr_at_10, round(avg(ndcg_at_10), 6) AS ndcg_at_10,
                  round(avg(recall_at_50), 6) AS recall_at_50, round(avg(duplicate_rate_at_10), 6) AS duplicate_rate_at_10, sum(forbidden_hits_at_10) AS forbidden_hits_at_10
           FROM {r} GROUP BY GROUPING SETS ((), (language), (query_type))""",
        r=rows,
    )


def nearest_rank(rows: DataFrame, by: str, value: str, fractions: tuple[float, ...] = (0.5, 0.95), accuracy: int = 10_000) -> DataFrame:
    """``(by, p50, p95, ...)``: ordered value at place round((n - 1) * fraction), halves to even.

    A sketch brackets every place between two values that hold some ``4 / accuracy`` of a group; rows below a bracket are
    only counted, and only the distinct values inside are put in order. So the result is exact, and no task sorts a large group; one of at
    most ``10 * accuracy`` rows is its own bracket.
    """
    near = lambda p, d: min(1.0, max(0.0, p + d * 2 / accuracy))
    marks = ", ".join(f"{near(p, -1)}D, {near(p, 1)}D" for p in fractions)
    edge = lambda k, side: f"CASE WHEN n <= {10 * accuracy} THEN {side}imum ELSE marks[{k}] END"
    parts = ", ".join(f"struct({k} AS k, CAST(bround((n - 1) * {p}D) AS BIGINT) + 1 AS place, {edge(2 * k, 'min')} AS low, {edge(2 * k + 1, 'max')} AS high)" for k, p in enumerate(fractions))
    found = ", ".join(f"max(CASE WHEN k = {k} THEN value END) AS p{round(p * 100)}" for k, p in enumerate(fractions))
    return rows.sparkSession.sql(
        f"""WITH held AS (SELECT {by} AS grp, {value} AS value FROM {{rows}} WHERE {value} IS NOT NULL),
                 told AS (SELECT grp, count(*) AS n, min(value) AS minimum, max(value) AS maximum, percentile_approx(value, array({marks}), {accuracy}) AS marks FROM held GROUP BY grp),
                 bracket AS (SELECT grp, inline(array({parts})) FROM told),
                 side AS (SELECT h.value, b.* FROM held h JOIN bracket b ON h.grp <=> b.grp WHERE h.value <= b.high),
                 below AS (SELECT grp, k, count(*) AS less FROM side WHERE value < low GROUP BY grp, k),
                 inside AS (SELECT grp, k, place, value, count(*) AS m FROM side WHERE value >= low GROUP BY grp, k, place, value),
                 placed AS (SELECT i.*, coalesce(less, 0) + sum(m) OVER (PARTITION BY i.grp, i.k ORDER BY value) AS upto
                            FROM inside i LEFT JOIN below b ON i.grp <=> b.grp AND i.k = b.k)
            SELECT grp AS {by}, {found} FROM placed WHERE place BETWEEN upto - m + 1 AND upto GROUP BY grp""",
        rows=rows,
    )

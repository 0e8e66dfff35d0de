"""A varied subset of a given size (problem 6), in SQL only.

Method. Assets are binned into the cells of a grid over dataset, series and action category. Rows are ranked
within their cell by a hash of their id, ordered globally by rank and then cell, and the first k are kept: a
round-robin over the cells, so a crowded series gives no more rows than any other until that one is exhausted.

The dataset is part of a cell, so a request takes whole cells, and one ranking serves all requests. The last rank
that a request needs follows from the cell sizes alone, so it is computed first; cells are then ranked to the deepest of
these, in two steps, within salted parts and among the survivors of these, and no task ever orders a crowded cell. Of
the last rank the cells before the cut are counted by the first digits of their hash; only those that share the digits of
the cut are put in order. The assets and their ranking are written once.

Defined results: rows with a null object_id are no assets; an asset listed under several datasets counts under the
first of them in alphabetical order; missing series, category or dataset are bins of their own; requests for no or
a negative number of rows give none; a request beyond the assets in its scope gets all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .assets import dataset_key, in_force

#: Parts into which a cell is split for the first ranking, and digits of a cell's hash that are counted.
SALTS, DIGITS = 64, 4
#: Requests are configuration; more than this is an error, not a truncation.
MOST_REQUESTS = 10_000

_BINNED = """
WITH asset AS (SELECT object_id, min(dataset) AS dataset FROM {index} WHERE object_id IS NOT NULL GROUP BY object_id)
SELECT a.object_id, a.dataset, coalesce(e.series_key, '') AS series_key, e.action_category,
       unhex(md5(concat_ws('|', coalesce(a.dataset, '?'), coalesce(e.series_key, ''), coalesce(e.action_category, '?')))) AS cell,
       unhex(md5(concat('6:', a.object_id))) AS h
FROM asset a LEFT JOIN {entry} e ON a.object_id = e.object_id
"""
_TOPS = """
WITH cells AS (SELECT dataset, cell, count(*) AS n FROM {binned} GROUP BY dataset, cell),
alike AS (SELECT dataset, n, count(*) AS cells FROM cells GROUP BY dataset, n),
sizes AS (SELECT /*+ BROADCAST(r) */ r.request_id, r.k, n, sum(cells) AS cells
          FROM alike c JOIN {request} r ON r.scope IS NULL OR r.scope = c.dataset GROUP BY r.request_id, r.k, n),
growing AS (
  SELECT request_id, k, n,
         coalesce(sum(n * cells) OVER (PARTITION BY request_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(cells) OVER (PARTITION BY request_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM sizes),
tops AS (SELECT request_id, k, coalesce(min_by(CAST(ceil((k - below) / open) AS BIGINT), n) FILTER (WHERE below + n * open >= k), max(n)) AS top
         FROM growing GROUP BY request_id, k)
-- rows of the ranks before the last: every cell gives as many as it has, up to that rank
SELECT t.request_id, any_value(t.k) AS k, any_value(t.top) AS top, any_value(t.k) - sum(s.cells * least(s.n, t.top - 1)) AS room
FROM tops t JOIN sizes s ON s.request_id = t.request_id GROUP BY t.request_id
"""
_RANKED = """
WITH local AS (SELECT *, row_number() OVER (PARTITION BY cell, pmod(xxhash64(h), {salts}) ORDER BY h, object_id) AS part_rank FROM {binned}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY h, object_id) AS cell_rank FROM local WHERE part_rank <= {deepest})
SELECT object_id, dataset, series_key, action_category, cell, cell_rank FROM ranked WHERE cell_rank <= {deepest}
"""
_SUBSET = """
WITH wanted AS (
  SELECT /*+ BROADCAST(r) */ r.request_id, r.top, r.room, b.*, substring(hex(cell), 1, {digits}) AS digits
  FROM {ranked} b JOIN {request} r ON (r.scope IS NULL OR r.scope = b.dataset) AND b.cell_rank <= r.top),
counted AS (SELECT request_id, digits, any_value(room) AS room, count(*) AS n FROM wanted WHERE cell_rank = top GROUP BY request_id, digits),
running AS (SELECT *, sum(n) OVER (PARTITION BY request_id ORDER BY digits) AS upto FROM counted),
cut AS (SELECT request_id, min(digits) AS at, min_by(room - upto + n, digits) AS rest FROM running WHERE upto > room GROUP BY request_id),
placed AS (SELECT /*+ BROADCAST(c) */ w.*, c.at, c.rest FROM wanted w LEFT JOIN cut c ON c.request_id = w.request_id),
border AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cell) AS turn FROM placed WHERE cell_rank = top AND digits = at)
SELECT request_id, object_id, dataset, series_key, action_category, CAST(cell_rank AS INT) AS cell_rank
FROM placed WHERE cell_rank < top OR at IS NULL OR digits < at
UNION ALL
SELECT request_id, object_id, dataset, series_key, action_category, CAST(cell_rank AS INT) FROM border WHERE turn <= rest
"""


def varied_subset(motion_index: DataFrame, motion_entry: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request_id, object_id, dataset, series_key, action_category, cell_rank)``."""
    spark = motion_index.sparkSession
    rows = requests.select("request_id", F.col("subset_size").cast("bigint").alias("k"), F.lower(F.trim("scope_dataset")).alias("scope")).where("request_id IS NOT NULL AND k > 0").limit(MOST_REQUESTS + 1).collect()
    if len(rows) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} requests")
    kind = "request_id int, k bigint, scope string"
    asked = spark.createDataFrame(rows, kind)
    index = motion_index.select("object_id", dataset_key().alias("dataset"))
    binned = materialize(spark.sql(_BINNED, index=index, entry=in_force(motion_entry)), "p6-assets")
    # one row a request
    tops = spark.sql(_TOPS, binned=binned, request=asked).collect()
    scope = {r.request_id: r.scope for r in rows}
    known = spark.createDataFrame([(t.request_id, scope[t.request_id], t.top, t.room) for t in tops], "request_id int, scope string, top bigint, room bigint")
    deepest = max((t.top for t in tops), default=0)
    ranked = materialize(spark.sql(_RANKED, binned=binned, salts=SALTS, deepest=deepest), "p6-ranked")
    return spark.sql(_SUBSET, ranked=ranked, request=known, digits=DIGITS)


#: The same result by the plain reading of the method, for DuckDB.
ORACLE = """
WITH force AS (
  SELECT object_id, coalesce(series_key, '') AS series_key, classification.taxonomy['action_category'] AS action_category
  FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY classified_at DESC NULLS LAST, entry_no DESC) AS rn
        FROM motion_entry WHERE object_id IS NOT NULL) WHERE rn = 1),
asset AS (SELECT object_id, min(nullif(lower(trim(dataset)), '')) AS dataset FROM motion_index WHERE object_id IS NOT NULL GROUP BY object_id),
binned AS (
  SELECT a.object_id, a.dataset, coalesce(e.series_key, '') AS series_key, e.action_category,
         md5(concat_ws('|', coalesce(a.dataset, '?'), coalesce(e.series_key, ''), coalesce(e.action_category, '?'))) AS cell,
         md5('6:' || a.object_id) AS h
  FROM asset a LEFT JOIN force e ON a.object_id = e.object_id),
ranked AS (
  SELECT r.request_id, r.subset_size AS k, b.*, row_number() OVER (PARTITION BY r.request_id, cell ORDER BY h, b.object_id) AS cell_rank
  FROM binned b JOIN subset_request r ON r.scope_dataset IS NULL OR lower(trim(r.scope_dataset)) = b.dataset)
SELECT request_id, object_id, dataset, series_key, action_category, CAST(cell_rank AS INTEGER) AS cell_rank
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cell_rank, cell) AS turn FROM ranked) WHERE turn <= k
"""

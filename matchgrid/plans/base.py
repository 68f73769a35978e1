"""The derived inputs that queries share, and the same as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CROPS_SQL = """
SELECT vec_id AS crop_id, vec_id % 8 AS video_id, (vec_id % 8) % 4 AS site_id, CAST(label AS BIGINT) AS object_id, vec_id % 6 AS camid,
       CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'gallery' END AS role,
       CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST((vec_id * 37) % 600 AS DOUBLE) / 10 END AS pos_x,
       CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST((vec_id * 53) % 600 AS DOUBLE) / 10 END AS pos_y,
       CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST((vec_id * 73) % 360 AS DOUBLE) - 180 END AS azimuth,
       CASE WHEN vec_id % 5 = 1 THEN 1 ELSE 0 END AS occ,
       CASE WHEN vec_id % 13 = 0 THEN NULL ELSE (vec_id * 29) % 64 END AS kp_bits,
       embedding
FROM {embeddings}
"""

VALIDATION_SITE = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight units of four sites; site 0 is for validation."""
    return spark.sql(CROPS_SQL.format(embeddings="{t}"), t=table(spark, sf_dir, "embeddings"))


def _bucket(x: str, edges: tuple[float, ...]) -> str:
    inner = " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in edges[1:-1])
    return f"CASE WHEN {x} IS NULL THEN {len(edges) - 1} ELSE {inner} END"


def _pairs_sql() -> str:
    from matchgrid.functions import binning as B

    turn = "abs(a.azimuth - b.azimuth)"
    turn = f"CASE WHEN {turn} > 180 THEN 360 - {turn} ELSE {turn} END"
    both, any_ = "bit_count(a.kp_bits & b.kp_bits)", "bit_count(a.kp_bits | b.kp_bits)"
    return f"""
crops AS ({CROPS_SQL.format(embeddings="embeddings")}),
sizes AS (SELECT video_id, object_id, count(*) AS size FROM crops GROUP BY ALL),
joined AS (
  SELECT a.video_id AS unit, a.site_id, a.crop_id AS a, b.crop_id AS b, a.object_id AS object_id_a, b.object_id AS object_id_b, a.object_id = b.object_id AS same,
         greatest(-1.0, least(1.0, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9))) AS s,
         sqrt((a.pos_x - b.pos_x) ** 2 + (a.pos_y - b.pos_y) ** 2) AS apart, {turn} AS turn, a.occ + b.occ AS occ_bin,
         CASE WHEN {any_} > 0 THEN {both} / {any_} END AS iou,
         CASE WHEN a.kp_bits IS NOT NULL AND b.kp_bits IS NOT NULL THEN least(bit_count(a.kp_bits), bit_count(b.kp_bits)) END AS kpmin,
         x.size AS size_a, y.size AS size_b
  FROM crops a JOIN crops b ON a.video_id = b.video_id AND a.crop_id < b.crop_id
  JOIN sizes x ON x.video_id = a.video_id AND x.object_id = a.object_id JOIN sizes y ON y.video_id = b.video_id AND y.object_id = b.object_id),
pairs AS (
  SELECT *, {_bucket("apart", B.POSITION_M[:-1] + (1e300,))} AS pos_bin, {_bucket("turn", B.AZIMUTH_DEG)} AS az_bin, {_bucket("iou", B.KEYPOINT_IOU)} AS kp_bin,
         {_bucket("kpmin", B.MIN_KEYPOINTS[:-1] + (1e300,))} AS kpmin_bin,
         greatest(0, least(1999, floor((s + 1) * 1000)))::INT AS fine, greatest(0, least(199, floor((s + 1) * 100)))::INT AS coarse,
         CAST(round(1e12 / CASE WHEN same THEN size_a * (size_a - 1) / 2 ELSE size_a * size_b END) AS BIGINT) AS w
  FROM joined)"""


PAIRS_SQL = _pairs_sql()

#: Edges of the fine histogram: tails of both sides by group. {by} is a list of columns with a trailing comma, or empty.
EDGES_SQL = """
sides AS (SELECT {by} fine, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM pairs WHERE {where} GROUP BY ALL),
grid AS (SELECT {by} edge FROM (SELECT DISTINCT {by} 1 AS one FROM sides), range(2001) t(edge)),
edges AS (SELECT {g_by} g.edge, coalesce(p, 0) AS p, coalesce(n, 0) AS n FROM grid g LEFT JOIN sides s ON s.fine = g.edge {join_by}),
tails AS (SELECT *, sum(p) OVER w AS pos, sum(n) OVER w AS neg, sum(p) OVER ({part}) AS pos_total, sum(n) OVER ({part}) AS neg_total
          FROM edges WINDOW w AS ({part} ORDER BY edge DESC ROWS UNBOUNDED PRECEDING)),
roc AS (SELECT {by} edge, p, n, pos::BIGINT AS pos, neg::BIGINT AS neg, pos_total::BIGINT AS pos_total, neg_total::BIGINT AS neg_total,
               CASE WHEN neg_total > 0 THEN neg::DOUBLE / neg_total::DOUBLE END AS far, CASE WHEN pos_total > 0 THEN pos::DOUBLE / pos_total::DOUBLE END AS tar FROM tails)"""


def edges_sql(where: str = "true", by: tuple[str, ...] = ()) -> str:
    cols = "".join(f"{c}, " for c in by)
    return EDGES_SQL.format(
        by=cols,
        where=where,
        g_by="".join(f"g.{c}, " for c in by),
        join_by="".join(f" AND s.{c} = g.{c}" for c in by),
        part=f"PARTITION BY {', '.join(by)}" if by else "",
    )


def thresholds_sql(targets: tuple[float, ...], source: str = "roc", by: tuple[str, ...] = ()) -> str:
    """A CTE body: (by..., target, threshold) from rows of edges with tails."""
    cols = "".join(f"{c}, " for c in by)
    goals = ", ".join(f"({t}::DOUBLE)" for t in targets)
    return f"""
SELECT {cols} target, CASE WHEN edge = 0 THEN -1.0::DOUBLE ELSE -1.0::DOUBLE + edge * (2.0::DOUBLE / 2000) - CASE WHEN in_bin > 0 THEN (want - neg) / in_bin ELSE 0 END * (2.0::DOUBLE / 2000) END AS threshold
FROM (SELECT *, target * neg_total AS want FROM (SELECT *, lag(n) OVER ({"PARTITION BY " + ", ".join(by) if by else ""} ORDER BY edge) AS in_bin FROM {source} WHERE neg_total > 0), (VALUES {goals}) g(target))
WHERE neg <= want QUALIFY row_number() OVER (PARTITION BY {cols} target ORDER BY edge) = 1"""

"""Domain tables derived from the given star schema, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.factors import loadings_long
from factorloom.operators.intervals import assign_points
from factorloom.operators.ordered import positions
from factorloom.plans.registry import table

#: Cells, factors, traits: embeddings are cells x factors, their label plays the trait.
EMB = """emb AS (
  SELECT vec_id, label, CAST(i AS INTEGER) AS pos, 'f' || i AS factor, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"""

RES = EMB + """, res AS (
  SELECT 't' || label AS trait, factor, pos, avg(v) AS coef, stddev_samp(v) / sqrt(count(*)) AS se,
         avg(v) / (stddev_samp(v) / sqrt(count(*))) AS z
  FROM emb GROUP BY label, factor, pos)"""


def upper_p(z: str) -> str:
    """SQL of the upper normal tail by Simpson's rule over 1000 panels."""
    return (
        "(0.5 - (SELECT sum((CASE WHEN i = 0 OR i = 1000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
        f" * exp(-pow({z} * i / 1000.0, 2) / 2.0)) FROM range(0, 1001) g(i)) * {z} / 3000.0 / sqrt(2.0 * pi()))"
    )


def bh(rel: str, family: str, p: str = "p") -> str:
    """SQL select of `rel` with its BH q per family."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""SELECT *, CASE WHEN {p} IS NULL THEN 1.0::DOUBLE ELSE least(1.0, min({p} * m / rn) OVER ({part} ORDER BY rn DESC)) END AS q
      FROM (SELECT *, count({p}) OVER ({part}) AS m,
                   row_number() OVER ({part} ORDER BY {p} ASC NULLS LAST) AS rn FROM {rel})"""


RESQ = RES + f", resp AS (SELECT *, {upper_p('z')} AS p FROM res), resq AS ({bh('resp', 'trait')})"

_PEAK_CHROM = "'chr' || (p_partkey % 22 + 1)"
PEAKS = f"""peaks AS (
  SELECT {_PEAK_CHROM} || ':' || ((p_partkey // 22) * 1000 + 100) || '-' || ((p_partkey // 22) * 1000 + 250 + p_size * 10) AS peak,
         {_PEAK_CHROM} AS chrom, (p_partkey // 22) * 1000 + 100 AS s, (p_partkey // 22) * 1000 + 250 + p_size * 10 AS e, p_partkey
  FROM part)"""
REGIONS = f"""regions AS (
  SELECT 'r' || p_partkey AS region, {_PEAK_CHROM} AS chrom,
         (p_partkey // 22) * 1000 + 100 + (p_partkey * 37) % 400 AS s,
         (p_partkey // 22) * 1000 + 100 + (p_partkey * 37) % 400 + 200 + (p_partkey * 13) % 300 AS e
  FROM part)"""
SNPS = """snps AS (
  SELECT o_orderkey AS row_ix, CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom, 'rs' || o_orderkey AS snp,
         1 + (o_orderkey * 7919) % 91000 AS bp FROM orders)"""
ASSIGNED = f"""{PEAKS}, {SNPS}, assigned AS (
  SELECT snps.row_ix, snps.chrom, snps.bp, peaks.peak
  FROM snps LEFT JOIN peaks ON 'chr' || snps.chrom = peaks.chrom AND peaks.s < snps.bp AND snps.bp <= peaks.e)"""
COUNTS = ASSIGNED + """, counts AS (
  SELECT peaks.peak, count(assigned.row_ix) AS n_snps FROM peaks LEFT JOIN assigned USING (peak) GROUP BY peaks.peak)"""
#: Peak loadings: the peak's part number picks a vector; all factors, both arms.
LOADINGS = """ld AS (
  SELECT peak, factor, direction, CASE WHEN direction = 'pos' THEN greatest(v, 0) ELSE greatest(-v, 0) END AS loading
  FROM peaks JOIN emb ON emb.vec_id = peaks.p_partkey % (SELECT count(*) FROM embeddings)
  CROSS JOIN (VALUES ('pos'), ('neg')) d(direction))"""

#: Scores of regions (parts) for motifs (suppliers), weights of factors (priorities).
SCORES = "scores AS (SELECT l_partkey AS region, l_suppkey AS motif, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"
WEIGHTS = """weights AS (
  SELECT o_orderpriority AS factor, l_partkey AS region, sum(l_extendedprice) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def factor_names(cells: DataFrame, x: str = "x") -> list[str]:
    """f0, f1, ... for the width of the array column."""
    return [f"f{i}" for i in range(len(cells.select(x).first()[0]))]


def cells(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Cells with label and factor array, and the factor names."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("cell_id"), "label", F.col("embedding").cast("array<double>").alias("x")
    )
    return rows, factor_names(rows)


def results(spark: SparkSession, d: str) -> DataFrame:
    """Trait results: mean, its error and their ratio per (label, factor)."""
    rows, names = cells(spark, d)
    long = loadings_long(rows, "x", names, ["label"])
    stats = long.groupBy("label", "factor").agg(
        F.avg("value").alias("Coefficient"),
        (F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))).alias("Coefficient_std_error"),
    )
    return stats.select(
        F.concat(F.lit("t"), F.col("label").cast("string")).alias("trait"),
        "factor",
        F.lit("combined").alias("direction"),
        "Coefficient",
        "Coefficient_std_error",
        F.try_divide("Coefficient", "Coefficient_std_error").alias("Coefficient_z-score"),
    )


def _chrom(key: str):
    return F.concat(F.lit("chr"), (F.col(key) % 22 + 1).cast("string"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Disjoint named intervals from parts."""
    block = F.expr("p_partkey div 22") * 1000
    rows = table(spark, d, "part").select(
        "p_partkey",
        _chrom("p_partkey").alias("chrom"),
        (block + 100).alias("start"),
        (block + 250 + F.col("p_size") * 10).alias("end"),
    )
    name = F.concat(
        "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")
    )
    return rows.withColumn("peak", name)


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Another interval set over the same coordinates."""
    start = F.expr("p_partkey div 22") * 1000 + 100 + (F.col("p_partkey") * 37) % 400
    return table(spark, d, "part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("region"),
        _chrom("p_partkey").alias("chrom"),
        start.alias("start"),
        (start + 200 + (F.col("p_partkey") * 13) % 300).alias("end"),
    )


def snps(spark: SparkSession, d: str) -> DataFrame:
    """Points from orders, with bare chromosome labels."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_ix"),
        (F.col("o_custkey") % 22 + 1).cast("string").alias("chrom"),
        F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("snp"),
        (1 + (F.col("o_orderkey") * 7919) % 91000).alias("bp"),
    )


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return assign_points(snps(spark, d), peaks(spark, d))


def peak_loadings(spark: SparkSession, d: str) -> DataFrame:
    """(peak, factor, direction, loading) of all factors and both arms."""
    rows, names = cells(spark, d)
    n = rows.count()
    vectors = rows.select("cell_id", "x")
    # The file of parts is small beside its rows with names; by its size the planner would broadcast them.
    named = peaks(spark, d).withColumn("cell_id", F.col("p_partkey") % n).hint("merge")
    placed = named.join(vectors, "cell_id")
    long = loadings_long(placed, "x", names, ["peak"])
    arms = F.array(
        F.struct(F.lit("pos").alias("direction"), F.greatest("value", F.lit(0.0)).alias("loading")),
        F.struct(F.lit("neg").alias("direction"), F.greatest(-F.col("value"), F.lit(0.0)).alias("loading")),
    )
    return long.select("peak", "factor", F.inline(arms))


def fitted(spark: SparkSession, d: str) -> DataFrame:
    """One fit per (factor, direction): the results of trait t0, the same for both arms."""
    rows = results(spark, d).where("trait = 't0'").drop("direction")
    return rows.withColumn("direction", F.explode(F.array(F.lit("pos"), F.lit("neg"))))


def motif_scores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("region"), F.col("l_suppkey").alias("motif")).agg(
        F.sum("l_quantity").alias("score")
    )


def motif_weights(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_orderpriority").alias("factor"), F.col("l_partkey").alias("region")).agg(
        F.sum("l_extendedprice").alias("weight")
    )


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], DataFrame]:
    """Nodes with non-negative arms and a neighbour list along (label, first factor)."""
    rows, names = cells(spark, d)
    nodes = rows.select(
        F.col("cell_id").alias("id"),
        "label",
        F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"),
        (F.col("cell_id") % 17).cast("double").alias("covariate"),
    )
    ordered = rows.select("label", F.col("x")[0].alias("first"), F.col("cell_id").alias("id"))
    ordered = positions(ordered, ["label", "first", "id"], "r").select("id", "r")
    steps = F.array(
        *[F.struct(F.lit(s).alias("d"), F.lit(i).alias("rank")) for i, s in enumerate((1, -1, 2, -2, 3, -3, 4, -4, 5, -5))]
    )
    wanted = ordered.select(F.col("id").alias("src"), "r", F.inline(steps))
    wanted = wanted.select("src", "rank", (F.col("r") + F.col("d")).alias("r"))
    return nodes, names, wanted.join(ordered.withColumnRenamed("id", "dst"), "r").select("src", "dst", "rank")


NB = EMB + """, xs AS (SELECT vec_id AS id, label, pos, factor, greatest(v, 0) AS x, CAST(vec_id % 17 AS DOUBLE) AS cov FROM emb),
ord AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY label, embedding[1], vec_id) AS r FROM embeddings),
offs AS (SELECT unnest([1, -1, 2, -2, 3, -3, 4, -4, 5, -5]) AS d, unnest(range(10)) AS rank),
nb AS (SELECT a.id AS src, b.id AS dst, a.label AS ls, b.label AS ld, rank FROM ord a JOIN offs ON true JOIN ord b ON b.r = a.r + offs.d)"""

CW = NB + """, mu AS (SELECT pos, avg(x) AS m FROM xs GROUP BY pos),
c AS (SELECT id, label, xs.pos, factor, x, cov, x - m AS c, m FROM xs JOIN mu ON mu.pos = xs.pos),
w AS (SELECT nb.src AS id, c.pos, avg(c.c) AS w FROM nb JOIN c ON c.id = nb.dst GROUP BY nb.src, c.pos),
cw AS (SELECT c.*, coalesce(w.w, 0) AS w, greatest(coalesce(w.w, -c.m), 0) AS e FROM c LEFT JOIN w ON w.id = c.id AND w.pos = c.pos)"""

"""Checked queries: group summaries, boxes, limits, correlation, sampling, sparse counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import boxes, factors, groups, matrix, qc, sampling, sketches
from factorloom.operators.factors import loadings_long
from factorloom.plans.inputs import EMB, cells
from factorloom.plans.registry import query, rounded, table
from factorloom.session import materialize, scratch_path

_Z95 = "1.959963984540054::DOUBLE"
_SUMMARY = """count(*) AS n, count({v}) AS n_scored, round(avg({v}), 4) AS mean, round(quantile_cont({v}, 0.5), 4) AS median,
  round(stddev_samp({v}), 4) AS std"""
_CI = """round(stddev_samp({v}) / sqrt(count({v})), 6) AS sem, round(avg({v}) - {z} * stddev_samp({v}) / sqrt(count({v})), 4) AS ci_low,
  round(avg({v}) + {z} * stddev_samp({v}) / sqrt(count({v})), 4) AS ci_high"""


def _select_summary(v: str) -> str:
    return _SUMMARY.format(v=v) + ", {q}" + _CI.format(v=v, z=_Z95)


def _round_summary(df):
    return df.select(
        *[F.round(f"`{c}`", 6 if c == "sem" else 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query(
    "summarize_by",
    "SELECT l_returnflag, l_linestatus, "
    + _select_summary("l_extendedprice").format(
        q="round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.995), 4) AS \"q99.5\", "
    )
    + " FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def summarize_by(spark, d):
    rows = table(spark, d, "lineitem")
    out = groups.summarize_by(
        rows, "l_extendedprice", by=["l_returnflag", "l_linestatus"], quantile_points=(10, 99.5)
    )
    return _round_summary(out.frame)


@query(
    "summarize_many_groups",
    "SELECT l_suppkey, " + _select_summary("l_quantity").format(q="") + " FROM lineitem GROUP BY l_suppkey HAVING count(l_quantity) >= 600",
)
def summarize_many_groups(spark, d):
    out = groups.summarize_by(table(spark, d, "lineitem"), "l_quantity", by="l_suppkey", min_cells=600)
    return _round_summary(out.frame)


@query(
    "summarize_dropped",
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(l_quantity) < 600",
)
def summarize_dropped(spark, d):
    out = groups.summarize_by(table(spark, d, "lineitem"), "l_quantity", by="l_suppkey", min_cells=600)
    return out.dropped.select("l_suppkey", "n")


@query(
    "summarize_null_key",
    "WITH x AS (SELECT nullif(event_type, 'error') AS kind, CASE WHEN user_id % 5 <> 0 THEN value END AS v FROM events) SELECT kind, "
    + _select_summary("v").format(q="")
    + " FROM x GROUP BY kind",
)
def summarize_null_key(spark, d):
    rows = table(spark, d, "events").select(
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.when(F.col("user_id") % 5 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"),
    )
    return _round_summary(groups.summarize_by(rows, "v", by="kind").frame)


@query(
    "group_matrix",
    """WITH x AS (SELECT nullif(o_orderpriority, '5-LOW') AS pr, o_orderstatus AS st, o_totalprice AS v FROM orders)
    SELECT pr, st, CASE WHEN count(v) >= 1200 THEN round(avg(v), 4) END AS mean, count(v) AS n FROM x
    WHERE pr IS NOT NULL AND st IS NOT NULL GROUP BY pr, st""",
)
def group_matrix(spark, d):
    rows = table(spark, d, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("pr"), F.col("o_orderstatus").alias("st"), "o_totalprice"
    )
    return rounded(groups.group_matrix(rows, "o_totalprice", index="pr", columns="st", min_cells=1200), 4)


@query(
    "group_matrix_grid",
    """WITH g AS (SELECT * FROM (VALUES ('1-URGENT'), ('5-LOW'), ('9-NONE')) a(pr) CROSS JOIN (VALUES ('P'), ('F')) b(st)),
    x AS (SELECT o_orderpriority AS pr, o_orderstatus AS st, avg(o_totalprice) AS m, count(o_totalprice) AS n FROM orders GROUP BY 1, 2)
    SELECT g.pr, g.st, CASE WHEN n >= 20 THEN round(m, 4) END AS mean, coalesce(n, 0) AS n FROM g LEFT JOIN x ON x.pr = g.pr AND x.st = g.st""",
)
def group_matrix_grid(spark, d):
    rows = table(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "pr", "o_orderstatus": "st"})
    out = groups.group_matrix(
        rows, "o_totalprice", index="pr", columns="st", index_order=["1-URGENT", "5-LOW", "9-NONE"], column_order=["P", "F"]
    )
    return rounded(out, 4)


@query(
    "group_matrix_one_order",
    """WITH g AS (SELECT * FROM (VALUES ('1-URGENT'), ('9-NONE')) a(pr) CROSS JOIN (SELECT DISTINCT o_orderstatus AS st FROM orders)),
    x AS (SELECT o_orderpriority AS pr, o_orderstatus AS st, avg(o_totalprice) AS m, count(o_totalprice) AS n FROM orders GROUP BY 1, 2)
    SELECT g.pr, g.st, CASE WHEN n >= 20 THEN round(m, 4) END AS mean, coalesce(n, 0) AS n FROM g LEFT JOIN x ON x.pr = g.pr AND x.st = g.st""",
)
def group_matrix_one_order(spark, d):
    rows = table(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "pr", "o_orderstatus": "st"})
    return rounded(groups.group_matrix(rows, "o_totalprice", index="pr", columns="st", index_order=["1-URGENT", "9-NONE"]), 4)


@query(
    "summary_of_joined_cells",
    "SELECT c_mktsegment, "
    + _select_summary("o_totalprice").format(q="")
    + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment ORDER BY avg(o_totalprice) DESC LIMIT 3",
)
def summary_of_joined_cells(spark, d):
    values = table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"), "o_totalprice")
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), "c_mktsegment")
    out = groups.summarize_by(groups.join_cells(values, cells), "o_totalprice", by="c_mktsegment", min_cells=1)
    # The three segments of the highest mean are the result.
    return _round_summary(out.order_by("mean").frame.limit(3))


@query(
    "per_category_order",
    """WITH o(o_orderpriority, slot) AS (VALUES ('5-LOW', 0), ('9-NONE', 1), ('1-URGENT', 2)),
    x AS (SELECT o_orderpriority, avg(o_totalprice) AS v, stddev_samp(o_totalprice) / sqrt(count(*)) AS se, count(*) AS n FROM orders GROUP BY 1)
    SELECT o.o_orderpriority, slot, round(v, 4) AS value, round(coalesce(se, 0), 4) AS se, coalesce(n, 0) AS n
    FROM o LEFT JOIN x ON x.o_orderpriority = o.o_orderpriority""",
)
def per_category_order(spark, d):
    order = ["5-LOW", "9-NONE", "1-URGENT"]
    return rounded(groups.per_category(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", order=order), 4)


@query(
    "keep_subset",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
)
def keep_subset(spark, d):
    kept = factors.keep_subset(table(spark, d, "orders"), "o_orderstatus", ["F", "P"])
    return rounded(kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query(
    "group_matrix_wide",
    """SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS "F",
      round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS "O", CAST(NULL AS DOUBLE) AS "X" FROM orders GROUP BY 1""",
)
def group_matrix_wide(spark, d):
    bins = groups.group_matrix(table(spark, d, "orders"), "o_totalprice", index="o_orderpriority", columns="o_orderstatus")
    means, _ = groups.group_matrix_wide(bins, index="o_orderpriority", columns="o_orderstatus", column_order=["F", "O", "X"])
    return rounded(means, 4)


@query(
    "profile_by_group",
    f"""WITH {EMB}, g AS (SELECT label, factor, pos, count(*) AS n, CASE WHEN count(*) >= 48 THEN avg(v) END AS m FROM emb GROUP BY label, factor, pos)
    SELECT label, factor, pos, n, round(m, 8) AS mean,
      round((m - avg(m) OVER (PARTITION BY pos)) / nullif(stddev_pop(m) OVER (PARTITION BY pos), 0), 6) AS z FROM g""",
)
def profile_by_group(spark, d):
    rows, names = cells(spark, d)
    out = groups.profile_by_group(rows, "x", names, "label", min_cells=48)
    return out.withColumn("mean", F.round("mean", 8)).withColumn("z", F.round("z", 6))


@query(
    "category_factor_means",
    f"WITH {EMB} SELECT label, factor, pos, count(*) AS n, round(avg(v), 8) AS mean, round(avg(v), 8) AS z FROM emb GROUP BY label, factor, pos",
)
def category_factor_means(spark, d):
    rows, names = cells(spark, d)
    return rounded(groups.profile_by_group(rows, "x", names, "label", zscore=False), 8)


@query(
    "eta_squared_factors",
    f"""WITH {EMB}, g AS (SELECT factor, label, count(*) AS n, avg(v) AS m, sum(v) AS s FROM emb GROUP BY factor, label),
    t AS (SELECT factor, avg(v) AS gm, var_pop(v) * count(*) AS ss FROM emb GROUP BY factor)
    SELECT g.factor, round(sum(n * (m - gm) * (m - gm)) / max(ss), 8) AS eta_squared FROM g JOIN t ON t.factor = g.factor GROUP BY g.factor""",
)
def eta_squared_factors(spark, d):
    rows, names = cells(spark, d)
    return rounded(groups.eta_squared(loadings_long(rows, "x", names, ["label"]), "value", "label", ["factor"]), 8)


@query(
    "eta_squared",
    """WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
    t AS (SELECT avg(l_extendedprice) AS gm, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem)
    SELECT round(sum(n * (m - gm) * (m - gm)) / max(ss), 8) AS eta_squared FROM g, t""",
)
def eta_squared(spark, d):
    return rounded(groups.eta_squared(table(spark, d, "lineitem"), "l_extendedprice", "l_suppkey"), 8)


_BLOCKS = """st AS (SELECT 's' || s_suppkey AS supplier, CASE WHEN s_nationkey < 20 THEN 'n' || s_nationkey END AS nation, s_acctbal AS mean FROM supplier),
slots AS (SELECT *, row_number() OVER (ORDER BY nation ASC NULLS LAST, mean DESC, supplier) - 1 AS slot FROM st)"""


def _block_input(spark, d):
    nation = F.when(F.col("s_nationkey") < 20, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("supplier"), nation.alias("nation"), F.col("s_acctbal").alias("mean")
    )


@query("block_order", f"WITH {_BLOCKS} SELECT supplier, nation, mean, slot FROM slots")
def block_order(spark, d):
    return groups.block_order(_block_input(spark, d), group="supplier", block="nation")[0]


@query("block_spans", f"WITH {_BLOCKS} SELECT nation, min(slot) AS start, max(slot) + 1 AS stop FROM slots GROUP BY nation")
def block_spans(spark, d):
    return groups.block_order(_block_input(spark, d), group="supplier", block="nation")[1]


for _agg, _value, _scale in (
    ("mean", "avg(o_totalprice)", "/ sqrt(count(*))"),
    ("median", "quantile_cont(o_totalprice, 0.5)", "/ sqrt(count(*))"),
    ("sum", "sum(o_totalprice)", "* sqrt(count(*))"),
):

    @query(
        f"per_category_{_agg}",
        f"""SELECT o_orderpriority, round({_value}, 2) AS value, round(stddev_samp(o_totalprice) {_scale}, 2) AS se, count(*) AS n
        FROM orders GROUP BY o_orderpriority""",
    )
    def per_category(spark, d, agg=_agg):
        return rounded(groups.per_category(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", agg=agg), 2)


# ---------------------------------------------------------------- boxes and limits
_BOX = """q AS (SELECT l_returnflag AS label, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS md,
  quantile_cont(l_extendedprice, 0.75) AS q3, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS n FROM lineitem GROUP BY 1)"""
_BOX_HEAD = "SELECT label, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3"


@query("box_stats_quartile", f"WITH {_BOX} {_BOX_HEAD}, round(q1, 4) AS whislo, round(q3, 4) AS whishi, n FROM q")
def box_stats_quartile(spark, d):
    return rounded(boxes.box_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query("box_stats_minmax", f"WITH {_BOX} {_BOX_HEAD}, round(lo, 4) AS whislo, round(hi, 4) AS whishi, n, round(hi, 4) AS maximum FROM q")
def box_stats_minmax(spark, d):
    rows = table(spark, d, "lineitem")
    return rounded(boxes.box_stats(rows, "l_extendedprice", "l_returnflag", whis="minmax", with_maximum=True), 4)


@query(
    "box_stats_iqr",
    """WITH x AS (SELECT o_orderpriority AS label, pow(o_totalprice / 100000.0, 3) AS v FROM orders),
    q AS (SELECT label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3, count(v) AS n FROM x GROUP BY 1)
    SELECT q.label, round(any_value(q1), 4) AS q1, round(any_value(md), 4) AS median, round(any_value(q3), 4) AS q3,
      round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 4) AS whislo, round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 4) AS whishi,
      any_value(n) AS n FROM q JOIN x ON x.label = q.label GROUP BY q.label""",
)
def box_stats_iqr(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.pow(F.col("o_totalprice") / 100000.0, 3).alias("v"))
    return rounded(boxes.box_stats(rows, "v", "o_orderpriority", whis="1.5iqr"), 4)


@query(
    "box_stats_by_factor",
    f"""WITH {EMB}, q AS (SELECT factor, pos, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3, count(v) AS n, max(v) AS mx FROM emb GROUP BY 1, 2)
    SELECT q.factor AS label, q.pos, round(any_value(q1), 8) AS q1, round(any_value(md), 8) AS median, round(any_value(q3), 8) AS q3,
      round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 8) AS whislo, round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 8) AS whishi,
      any_value(n) AS n, round(any_value(mx), 8) AS maximum FROM q JOIN emb ON emb.pos = q.pos GROUP BY q.factor, q.pos""",
)
def box_stats_by_factor(spark, d):
    rows, names = cells(spark, d)
    return rounded(boxes.box_stats_by_factor(rows, "x", names, whis="1.5iqr", with_maximum=True), 8)


@query(
    "box_order",
    f"WITH {_BOX} SELECT label, round(md, 4) AS median, row_number() OVER (ORDER BY md DESC) - 1 AS slot FROM q",
)
def box_order(spark, d):
    found = boxes.box_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    labels = [r["label"] for r in boxes.order_boxes(found, "median").select("label").collect()]
    return rounded(boxes.select_boxes(found, labels).select("label", "median", F.col("slot").cast("bigint").alias("slot")), 4)


@query(
    "robust_limits",
    "SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(quantile_cont(l_extendedprice, 0.995), 4) AS high FROM lineitem",
)
def robust_limits(spark, d):
    return rounded(boxes.robust_limits(table(spark, d, "lineitem"), "l_extendedprice"), 4)


@query(
    "quantile_sketches",
    """SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest,
      TRUE AS q1_within, TRUE AS q50_within, TRUE AS q995_within FROM lineitem GROUP BY 1""",
)
def quantile_sketches(spark, d):
    """Sketches per (flag, status), merged per flag; the ranks of three quantiles are counted.

    `rank_error` is kept with 99 % confidence; twice that is asked for, about five deviations.
    """
    rows, flag, points = table(spark, d, "lineitem"), "l_returnflag", {"q1": 0.01, "q50": 0.5, "q995": 0.995}
    stored = scratch_path(spark, "sketches")
    sketches.value_sketches(rows, "l_extendedprice", [flag, "l_linestatus"]).write.parquet(stored)
    merged = sketches.merge_sketches(spark.read.parquet(stored), [flag])
    # One row a flag.
    found = sketches.sketch_quantiles(merged, points | {"lowest": 0.0, "highest": 1.0})
    ranked = rows.select(flag, "l_extendedprice").join(F.broadcast(materialize(found)), flag)
    slack = 2 * sketches.rank_error()
    price = F.col("l_extendedprice")
    checks = [
        (
            (F.count_if(price < F.col(c)) <= (p + slack) * F.max("n")) & (F.count_if(price <= F.col(c)) >= (p - slack) * F.max("n"))
        ).alias(f"{c}_within")
        for c, p in points.items()
    ]
    ends = [F.max(c).alias(c) for c in ("n", "lowest", "highest")]
    return ranked.groupBy(flag).agg(*ends, *checks)


@query(
    "robust_limits_symmetric",
    """WITH x AS (SELECT l_discount - 0.03 AS v FROM lineitem WHERE l_tax > 0.0), q AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.9) AS b FROM x WHERE v <> 0)
    SELECT round(-greatest(abs(greatest(a, -0.025)), abs(b)), 8) AS low, round(greatest(abs(greatest(a, -0.025)), abs(b)), 8) AS high FROM q""",
)
def robust_limits_symmetric(spark, d):
    rows = table(spark, d, "lineitem").where("l_tax > 0").select((F.col("l_discount") - 0.03).alias("v"))
    out = boxes.robust_limits(rows, "v", percentiles=(5, 90), symmetric=True, nonzero_only=True, floor=-0.025)
    return rounded(out, 8)


@query(
    "factor_correlation",
    f"""WITH {EMB}, s AS (SELECT a.factor AS factor_a, b.factor AS factor_b, corr(a.v, b.v) AS r FROM emb a JOIN emb b ON a.vec_id = b.vec_id GROUP BY 1, 2)
    SELECT factor_a, factor_b, round(greatest(-1.0, least(1.0, r)), 8) AS r FROM s""",
)
def factor_correlation(spark, d):
    rows, names = cells(spark, d)
    return rounded(matrix.factor_correlation(rows, "x", names), 8)


# ---------------------------------------------------------------- sampling
@query("subsample", "SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY md5(l_orderkey || ':42'), l_orderkey LIMIT 3000")
def subsample(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey").distinct()
    return sampling.subsample(rows, 3000, row="l_orderkey")


@query(
    "subsample_stratified",
    """WITH g AS (SELECT max(1, 2000 // count(DISTINCT event_type)) AS cap FROM events),
    r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':7'), event_id) AS k FROM events)
    SELECT event_id, event_type FROM r WHERE k <= (SELECT greatest(1, 2000 // count(DISTINCT event_type)) FROM events)""".replace(
        "g AS (SELECT max(1, 2000 // count(DISTINCT event_type)) AS cap FROM events),\n    ", ""
    ),
)
def subsample_stratified(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return sampling.subsample(rows, 2000, row="event_id", seed=7, stratify="event_type")


@query(
    "balanced_sample",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':0'), o_orderkey) - 1 AS draw FROM orders)
    SELECT o_orderkey, o_orderstatus, draw FROM r WHERE draw < (SELECT min(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus))""",
)
def balanced_sample(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.balanced_sample(rows, "o_orderstatus", row="o_orderkey")


@query(
    "balanced_sample_replacement",
    """WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey || ':3'), s_suppkey) - 1 AS k,
        count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier),
    g AS (SELECT DISTINCT s_nationkey, size, unnest(range(50)) AS draw FROM r),
    p AS (SELECT s_nationkey, draw, CAST('0x' || substr(md5(draw || ':' || s_nationkey || ':3'), 1, 12) AS BIGINT) % size AS k FROM g)
    SELECT r.s_suppkey, p.s_nationkey, p.draw FROM p JOIN r ON r.s_nationkey = p.s_nationkey AND r.k = p.k""",
)
def balanced_sample_replacement(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return sampling.balanced_sample(rows, "s_nationkey", row="s_suppkey", min_count=50, seed=3, replacement=True)


@query(
    "permutations",
    """WITH s AS (SELECT unnest([1, 5]) AS seed), a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders),
    b AS (SELECT seed, o_orderkey AS other, row_number() OVER (PARTITION BY seed ORDER BY md5(o_orderkey || ':' || seed), o_orderkey) AS k FROM orders, s)
    SELECT b.seed, a.o_orderkey, b.other FROM a JOIN b ON b.k = a.k""",
)
def permutations(spark, d):
    return sampling.permutations(table(spark, d, "orders"), "o_orderkey", [1, 5])


# ---------------------------------------------------------------- sparse counts
_COUNTS = "SELECT l_orderkey AS cell, l_partkey AS feature, l_quantity AS n FROM lineitem"


def _counts(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("n")
    )


@query(
    "qc_cells",
    f"""WITH c AS ({_COUNTS}), a AS (SELECT cell, sum(n) AS total_a FROM c GROUP BY cell HAVING sum(n) >= 60),
    b AS (SELECT cell, sum(n) AS total_b FROM c WHERE n > 10 GROUP BY cell HAVING sum(n) >= 80) SELECT a.cell, total_a, total_b FROM a JOIN b ON a.cell = b.cell""",
)
def qc_cells(spark, d):
    counts = _counts(spark, d)
    return qc.cells_passing({"a": (counts, 60), "b": (counts.where("n > 10"), 80)})


@query(
    "qc_features",
    f"""WITH c AS (SELECT feature, cell, sum(n) AS n FROM ({_COUNTS}) GROUP BY 1, 2)
    SELECT feature, count(*) FILTER (WHERE n > 0) AS n_cells, sum(n) AS total_counts FROM c GROUP BY feature HAVING count(*) FILTER (WHERE n > 0) >= 28""",
)
def qc_features(spark, d):
    return qc.features_in_cells(_counts(spark, d), 28)


@query(
    "top_features",
    f"SELECT feature, sum(n) AS total_counts FROM ({_COUNTS}) GROUP BY feature ORDER BY total_counts DESC, feature LIMIT 200",
)
def top_features(spark, d):
    return qc.top_features(_counts(spark, d), 200)


@query(
    "keep_top_features",
    f"""WITH c AS ({_COUNTS}), t AS (SELECT feature FROM c GROUP BY feature ORDER BY sum(n) DESC, feature LIMIT 200)
    SELECT cell, feature, n FROM c WHERE feature IN (SELECT feature FROM t)""",
)
def keep_top_features(spark, d):
    counts = _counts(spark, d)
    return qc.keep_features(counts, qc.top_features(counts, 200))

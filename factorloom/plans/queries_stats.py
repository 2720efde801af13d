"""Checked queries: testing, factors, scores, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import (
    bare_chrom,
    chrom_sort_key,
    direction_label,
    p_one_tailed,
    safe_ratio,
    significance_class,
    significant,
    strict_bool,
)
from factorloom.operators import factors as fac
from factorloom.operators import scores as sc
from factorloom.operators import testing, views
from factorloom.operators.ordered import average_ranks, positions
from factorloom.plans.inputs import EMB, RES, RESQ, bh, cells, results, upper_p
from factorloom.plans.registry import query, rounded, table

Z = testing.Z_COLUMN


# ---------------------------------------------------------------- testing
@query(
    "bh_by_family",
    f"WITH {RESQ} SELECT trait, factor, round(z, 6) AS z, round(p, 9) AS p, round(q, 8) AS q FROM resq",
)
def bh_by_family(spark, d):
    rows = testing.add_fdr(results(spark, d), by="trait")
    return rows.select(
        "trait",
        "factor",
        F.round(F.col(f"`{Z}`"), 6).alias("z"),
        F.round("p_1tailed", 9).alias("p"),
        F.round("fdr_q", 8).alias("q"),
    )


_ORDER_P = "CASE WHEN o_orderstatus <> 'P' THEN least(1.0, o_totalprice / 500000.0) END"
_ORDERS = f"x AS (SELECT o_orderkey, o_orderpriority AS fam, {_ORDER_P} AS p FROM orders)"


def _order_tests(spark, d):
    p = F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0)
    missing = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan")))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("fam"), F.coalesce(missing, p).alias("p"))


@query("bh_orders", f"WITH {_ORDERS} SELECT o_orderkey, round(q, 8) AS q FROM ({bh('x', 'fam')})")
def bh_orders(spark, d):
    q = testing.bh_qvalues(_order_tests(spark, d), "p", by="fam", out="q")
    return rounded(q.select("o_orderkey", "q"), 8)


@query(
    "bh_pooled_ties",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10.0 AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(q, 8) AS q FROM ({bh('x', '')})""",
)
def bh_pooled_ties(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10.0).alias("p")
    )
    return rounded(testing.bh_qvalues(rows, "p", out="q").drop("p"), 8)


@query(
    "compare_bh",
    f"""WITH {_ORDERS}, c AS ({bh('x', 'fam')}), l AS (
      SELECT o_orderkey, least(1.0, p * count(*) OVER (PARTITION BY fam)
             / row_number() OVER (PARTITION BY fam ORDER BY p ASC NULLS LAST, o_orderkey)) AS ql, p AS pl FROM x)
    SELECT c.o_orderkey, round(p, 8) AS p, round(q, 8) AS q_correct, round(CASE WHEN pl IS NOT NULL THEN ql END, 8) AS q_legacy,
      round(q - CASE WHEN pl IS NOT NULL THEN ql END, 7) AS delta,
      (q < 0.5) <> coalesce(CASE WHEN pl IS NOT NULL THEN ql < 0.5 END, false) AS flips_at_05
    FROM c JOIN l ON l.o_orderkey = c.o_orderkey""",
)
def compare_bh(spark, d):
    rows = testing.compare_bh(_order_tests(spark, d), "p", order=["o_orderkey"], by="fam", alpha=0.5)
    return rows.select(
        "o_orderkey",
        F.round(F.when(~F.isnan("p"), F.col("p")), 8).alias("p"),
        F.round("q_correct", 8).alias("q_correct"),
        F.round("q_legacy", 8).alias("q_legacy"),
        F.round("delta", 7).alias("delta"),
        "flips_at_05",
    )


@query(
    "bh_boundary",
    f"""WITH {RESQ} SELECT trait, round(min(CASE WHEN q < 0.6 THEN z END), 6) AS z_upper FROM resq GROUP BY trait""",
)
def bh_boundary(spark, d):
    rows = testing.add_fdr(results(spark, d), by="trait")
    return rounded(testing.bh_boundary(rows, by="trait", alpha=0.6, out="z_upper"))


@query(
    "bh_boundary_lower",
    f"""WITH {RES}, x AS (SELECT *, 1.0 - {upper_p('z')} AS p FROM res), y AS ({bh('x', 'trait')})
    SELECT trait, round(max(CASE WHEN q < 0.6 THEN z END), 6) AS z_lower FROM y GROUP BY trait""",
)
def bh_boundary_lower(spark, d):
    rows = testing.add_fdr(results(spark, d), by="trait", tail="lower")
    return rounded(testing.bh_boundary(rows, by="trait", alpha=0.6, tail="lower", out="z_lower"))


@query(
    "significance",
    f"""WITH {_ORDERS} SELECT o_orderkey, p < 0.2 IS TRUE AS hit,
      CAST(CASE WHEN p < 0.05 THEN 0 WHEN p < 0.1 THEN 1 WHEN p < 0.5 THEN 2 ELSE 3 END AS INTEGER) AS cls FROM x""",
)
def significance(spark, d):
    return _order_tests(spark, d).select(
        "o_orderkey", significant("p", 0.2).alias("hit"), significance_class("p", (0.05, 0.1, 0.5)).alias("cls")
    )


@query(
    "p_one_tailed",
    f"""WITH x AS (SELECT c_custkey, (c_acctbal - 4500.0) / 1500.0 AS z FROM customer)
    SELECT c_custkey, round({upper_p('z')}, 9) AS p_upper, round(1.0 - {upper_p('z')}, 9) AS p_lower FROM x""",
)
def one_tailed(spark, d):
    rows = table(spark, d, "customer").withColumn("z", (F.col("c_acctbal") - 4500.0) / 1500.0)
    return rows.select(
        "c_custkey",
        F.round(p_one_tailed("z"), 9).alias("p_upper"),
        F.round(p_one_tailed("z", "lower"), 9).alias("p_lower"),
    )


# ---------------------------------------------------------------- ordering primitives
@query(
    "average_ranks",
    """SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey)
      + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0::DOUBLE AS rk FROM orders""",
)
def ranks(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return average_ranks(rows, "o_custkey", "rk", ["o_orderpriority"]).select("o_orderkey", "rk")


@query(
    "ordered_positions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos
    FROM lineitem""",
)
def ordered_positions(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, d, "lineitem").select(*keys, "l_returnflag", "l_extendedprice")
    return positions(rows, ["l_extendedprice", *keys], "pos", ["l_returnflag"]).select(*keys, "pos")


# ---------------------------------------------------------------- factors
@query(
    "factor_stats",
    f"""WITH {EMB} SELECT factor, pos, round(min(v), 8) AS min, round(max(v), 8) AS max, round(max(abs(v)), 8) AS max_abs,
      round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std, round(avg(abs(v)), 8) AS mean_abs,
      max(abs(v)) < 0.4 AS vanished, max(v) < 0.4 AS vanished_positive_direction FROM emb GROUP BY factor, pos""",
)
def factor_stats(spark, d):
    rows, names = cells(spark, d)
    return rounded(fac.factor_stats(rows, "x", names, threshold=0.4), 8)


@query(
    "split_directions",
    f"""WITH {EMB} SELECT vec_id AS cell_id, factor || '_pos' AS arm, greatest(v, 0) AS value FROM emb
    UNION ALL SELECT vec_id, factor || '_neg', greatest(-v, 0) FROM emb""",
)
def split_directions(spark, d):
    rows, names = cells(spark, d)
    arms, arm_names = fac.split_directions(rows, "x", names)
    return fac.loadings_long(arms, "x", arm_names, ["cell_id"]).select("cell_id", F.col("factor").alias("arm"), "value")


@query(
    "directions_long",
    f"""WITH {EMB} SELECT vec_id AS cell_id, factor, 'pos' AS direction, greatest(v, 0) AS value FROM emb
    UNION ALL SELECT vec_id, factor, 'neg', greatest(-v, 0) FROM emb""",
)
def directions_long(spark, d):
    rows, names = cells(spark, d)
    long = fac.loadings_long(rows, "x", names, ["cell_id"])
    return fac.directions_long(long, "value").select("cell_id", "factor", "direction", "value")


_FMAP = EMB + """, st AS (SELECT factor, pos, min(v) AS mn, max(v) AS mx, max(abs(v)) < 0.4 AS vanished, max(v) < 0.4 AS pv FROM emb GROUP BY factor, pos),
fm AS (SELECT factor, pos, vanished, CASE WHEN vanished THEN 'vanished' WHEN factor IN ('f3', 'f5') THEN 'exclude_dims' ELSE '' END AS drop_reason, vanished <> pv AS negative_only FROM st),
fmap AS (SELECT *, drop_reason = '' AS kept, CASE WHEN drop_reason = '' THEN CAST(row_number() OVER (PARTITION BY drop_reason = '' ORDER BY pos) AS INTEGER) END AS annot_index FROM fm)"""


def _factor_map(spark, d):
    rows, names = cells(spark, d)
    stats = fac.factor_stats(rows, "x", names, threshold=0.4)
    return rows, names, stats, fac.select_factors(stats, names, exclude=["f3", "f5"])


@query("select_factors", f"WITH {_FMAP} SELECT factor, pos, vanished, kept, drop_reason, annot_index, negative_only FROM fmap")
def select_factors(spark, d):
    return _factor_map(spark, d)[3]


@query(
    "kept_loadings",
    f"WITH {_FMAP} SELECT vec_id AS cell_id, emb.factor, annot_index - 1 AS pos, v AS value FROM emb JOIN fmap ON fmap.factor = emb.factor WHERE kept",
)
def kept_loadings(spark, d):
    rows, _, _, fmap = _factor_map(spark, d)
    kept, names = fac.kept_loadings(rows, "x", fmap)
    return fac.loadings_long(kept, "x", names, ["cell_id"]).select("cell_id", "factor", "pos", "value")


@query(
    "kept_loadings_long",
    f"WITH {_FMAP} SELECT vec_id AS cell_id, emb.factor, annot_index, v AS value FROM emb JOIN fmap ON fmap.factor = emb.factor WHERE kept",
)
def kept_loadings_long(spark, d):
    rows, names, _, fmap = _factor_map(spark, d)
    long = fac.loadings_long(rows, "x", names, ["cell_id"])
    return fac.kept_loadings_long(long, fmap).select("cell_id", "factor", "annot_index", "value")


def _factor_table(spark, d):
    rows, names, stats, _ = _factor_map(spark, d)
    return rows, names, stats.withColumn("title", F.concat(F.lit("DR "), F.col("pos"))).withColumn(
        "order", F.lit(100.0) - F.col("pos")
    )


@query(
    "directional_limits",
    f"""WITH {_FMAP} SELECT factor || '+' AS arm, 'pos' AS direction, 'DR ' || pos || '+' AS title, round(100.0 - pos + 1e-8, 9) AS "order",
      0.0::DOUBLE AS vmin, round(greatest(greatest(mx, 0), 0.3), 8) AS vmax FROM st
    UNION ALL SELECT factor || '-', 'neg', 'DR ' || pos || '-', round(100.0 - pos - 1e-8, 9), 0.0, round(greatest(greatest(-mn, 0), 0.3), 8) FROM st""",
)
def directional_limits(spark, d):
    _, _, factors = _factor_table(spark, d)
    arms = fac.factor_limits(fac.directional_factor_table(factors), thresholds=(-0.3, 0.3))
    return arms.select(
        "arm", "direction", "title", F.round("order", 9).alias("order"), "vmin", F.round("vmax", 8).alias("vmax")
    )


@query(
    "signed_limits",
    f"WITH {_FMAP} SELECT factor, round(least(mn, -0.4), 8) AS vmin, round(greatest(mx, 0.4), 8) AS vmax FROM st",
)
def signed_limits(spark, d):
    _, _, factors = _factor_table(spark, d)
    rows = fac.factor_limits(factors, thresholds=(-0.4, 0.4), directional=False)
    return rounded(rows.select("factor", "vmin", "vmax"), 8)


@query(
    "order_by_specificity",
    f"""WITH {_FMAP}, s AS (SELECT factor, pos, CASE WHEN pos % 5 <> 0 THEN round(mx - abs(mn), 8) END AS specificity FROM st)
    SELECT factor, pos, specificity, row_number() OVER (ORDER BY specificity DESC NULLS LAST, pos) - 1 AS slot FROM s""",
)
def order_by_specificity(spark, d):
    _, _, factors = _factor_table(spark, d)
    score = F.when(F.col("pos") % 5 != 0, F.round(F.col("max") - F.abs("min"), 8))
    scores = factors.select(F.col("title").alias("factor"), score.alias("specificity"))
    ordered = fac.order_by_specificity(factors, scores)
    return positions(
        ordered.select("factor", "pos", "specificity"), [F.col("specificity").desc_nulls_last(), "pos"], "slot"
    )


@query(
    "order_by_peak_cell",
    f"""WITH {EMB}, r AS (SELECT factor, pos, vec_id AS cell_id, abs(v) AS a, row_number() OVER (PARTITION BY pos ORDER BY abs(v) DESC, vec_id) AS k FROM emb)
    SELECT factor, pos, cell_id, a AS max_abs FROM r WHERE k = 1""",
)
def order_by_peak_cell(spark, d):
    rows, names = cells(spark, d)
    return fac.order_by_peak_row(rows, "x", names, "cell_id")


@query(
    "rank_by_statistic",
    f"""WITH {_FMAP} SELECT factor, 100.0::DOUBLE - pos AS rank, round(mx, 8) AS value, vanished,
      (SELECT min(mx) > 0 FROM st WHERE NOT vanished) AS log_scale FROM st WHERE NOT vanished""",
)
def rank_by_statistic(spark, d):
    _, _, factors = _factor_table(spark, d)
    return rounded(fac.rank_by_statistic(factors, "max"), 8)


@query(
    "strict_bool",
    """SELECT doc_id, CASE lower(trim(q)) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END AS flag
    FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN ' True ' WHEN quality = 1 THEN '1' ELSE '0' END AS q FROM labels)""",
)
def bool_flags(spark, d):
    text = F.when(F.col("toxic") == 1, " True ").when(F.col("quality") == 1, "1").otherwise("0")
    rows = table(spark, d, "labels").select("doc_id", text.alias("flag"))
    return fac.require_bool(rows, "flag").select("doc_id", "flag")


@query(
    "display_labels",
    f"WITH {RES} SELECT trait, factor, CASE WHEN factor = 'f1' THEN 'DR 2' ELSE factor END || '-' AS label FROM res",
)
def display_labels(spark, d):
    rows = results(spark, d).withColumn("direction", F.lit("neg"))
    return rows.select("trait", "factor", direction_label("factor", "direction", {"f1": "DR 2"}).alias("label"))


@query(
    "chrom_order",
    """WITH c AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'chr' || n_nationkey END AS chrom FROM nation),
    b AS (SELECT chrom, regexp_replace(chrom, '^[cC][hH][rR]', '') AS bare FROM c)
    SELECT chrom, bare, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(bare, '[0-9]+') THEN 0 ELSE 1 END,
      TRY_CAST(bare AS BIGINT), bare) - 1 AS slot FROM b""",
)
def chrom_order(spark, d):
    label = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(
        F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))
    )
    rows = table(spark, d, "nation").select(label.alias("chrom")).distinct()
    rows = rows.withColumn("bare", bare_chrom("chrom"))
    return positions(rows, chrom_sort_key("chrom"), "slot")


@query(
    "safe_ratio",
    "SELECT o_orderkey, round(o_totalprice / nullif(o_custkey % 7, 0), 6) AS ratio FROM orders",
)
def ratio(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(safe_ratio("o_totalprice", F.col("o_custkey") % 7), 6).alias("ratio")
    )


# ---------------------------------------------------------------- scores
_T0 = f"{RES}, wz AS (SELECT pos, greatest(z, 0) AS w, z, se FROM res WHERE trait = 't0')"
_SIZES = f"{_T0}, sz AS (SELECT pos, count(*) FILTER (WHERE v > 0) AS a FROM emb GROUP BY pos)"
_RATIO = f"""{_SIZES}, en AS (SELECT wz.pos, 1.0 + z / 10.0 AS e, a FROM wz JOIN sz ON sz.pos = wz.pos WHERE wz.pos NOT IN (7, 9)),
ratio AS (SELECT vec_id, CASE WHEN sum(greatest(v, 0) * a) > 0 THEN sum(greatest(v, 0) * a * e) / sum(greatest(v, 0) * a) END AS cs
  FROM emb JOIN en ON en.pos = emb.pos GROUP BY vec_id),
zs AS (SELECT vec_id, sum(greatest(v, 0) * w) AS cs FROM emb JOIN wz ON wz.pos = emb.pos GROUP BY vec_id)"""


def _z_scores(spark, d):
    rows, names = cells(spark, d)
    one = results(spark, d).where("trait = 't0'")
    return sc.score_from_z(rows, one, x="x", names=names, model="m", trait="t0", direction="pos", keep=["label"])


def _ratio_scores(spark, d):
    rows, names = cells(spark, d)
    long = fac.loadings_long(rows, "x", names)
    sizes = long.groupBy("factor").agg(F.count_if(F.col("value") > 0).alias("annot_size"))
    one = results(spark, d).where("trait = 't0'").select("factor", (1.0 + F.col(f"`{Z}`") / 10.0).alias("enrichment"))
    return sc.score_from_enrichment(
        rows, one.join(sizes, "factor"), x="x", names=names, model="m", trait="t0", direction="pos", exclude=["f7", "f9"]
    )


@query(
    "cell_score_z",
    f"WITH {_RATIO} SELECT vec_id AS cell_id, round(cs, 7) AS cs, 'z_weighted' AS kind, 'm' AS model, 't0' AS trait, 0.0::DOUBLE AS \"null\" FROM zs",
)
def cell_score_z(spark, d):
    return rounded(_z_scores(spark, d).table(), 7)


@query(
    "cell_score_old_column",
    f"WITH {_RATIO} SELECT vec_id AS cell_id, round(cs, 7) AS cs FROM zs",
)
def cell_score_old_column(spark, d):
    rows, names = cells(spark, d)
    old = results(spark, d).where("trait = 't0'").withColumnRenamed("factor", "dim")
    found = sc.score_from_z(rows, old, x="x", names=names, model="m", trait="t0", direction="pos")
    return rounded(found.frame.select("cell_id", "cs"), 7)


@query(
    "cell_score_ratio",
    f"WITH {_RATIO} SELECT vec_id AS cell_id, round(cs, 7) AS cs, 'enrichment_ratio' AS kind, 'm' AS model, 't0' AS trait, 1.0::DOUBLE AS \"null\" FROM ratio",
)
def cell_score_ratio(spark, d):
    return rounded(_ratio_scores(spark, d).table(), 7)


@query(
    "score_describe",
    f"""WITH {_RATIO} SELECT count(cs) AS count, round(avg(cs), 7) AS mean, round(stddev_samp(cs), 7) AS std, round(min(cs), 7) AS min,
      round(quantile_cont(cs, 0.25), 7) AS q25, round(quantile_cont(cs, 0.5), 7) AS q50, round(quantile_cont(cs, 0.75), 7) AS q75,
      round(max(cs), 7) AS max, 0.0::DOUBLE AS "null" FROM zs""",
)
def score_describe(spark, d):
    return rounded(_z_scores(spark, d).describe(), 7)


@query(
    "compare_scores",
    f"""WITH {_RATIO}, b AS (SELECT zs.cs AS a, ratio.cs AS b FROM zs JOIN ratio ON ratio.vec_id = zs.vec_id),
    k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM b WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT (SELECT count(*) FROM b) AS n_shared, count(*) AS n_compared, round(corr(a, b), 8) AS pearson, round(corr(ra, rb), 8) AS spearman,
      0.0::DOUBLE AS null_left, 1.0::DOUBLE AS null_right FROM k""",
)
def compare_scores(spark, d):
    return rounded(sc.compare_scores(_z_scores(spark, d), _ratio_scores(spark, d)), 8)


# ---------------------------------------------------------------- views
@query(
    "landscape",
    f"""WITH {RESQ}, o AS (SELECT *, row_number() OVER (ORDER BY z DESC) AS k FROM resq WHERE trait = 't1')
    SELECT factor, CASE WHEN factor = 'f1' THEN 'DR 2' ELSE factor END AS label, round(z, 6) AS z, round(coef, 8) AS tau, round(se, 8) AS tau_se,
      round(q, 8) AS q, CAST(CASE WHEN q < 0.6 THEN 0 WHEN q < 0.9 THEN 1 ELSE 2 END AS INTEGER) AS q_class,
      round((SELECT min(z) FROM o WHERE q < 0.6), 6) AS z_boundary, k <= 4 AS labelled FROM o""",
)
def landscape(spark, d):
    rows = testing.add_fdr(results(spark, d), by="trait").drop("direction")
    out = views.landscape(rows, trait="t1", alpha=0.6, thresholds=(0.6, 0.9), titles={"f1": "DR 2"})
    return out.select(
        "factor",
        "label",
        F.round("z", 6).alias("z"),
        F.round("tau", 8).alias("tau"),
        F.round("tau_se", 8).alias("tau_se"),
        F.round("q", 8).alias("q"),
        "q_class",
        F.round("z_boundary", 6).alias("z_boundary"),
        "labelled",
    )


_PAIR = RES + """, pr AS (SELECT factor, max(CASE WHEN trait = 't1' THEN z END) AS zl, max(CASE WHEN trait = 't2' THEN z END) AS zr FROM res GROUP BY factor),
dl AS (SELECT factor, zl, zr, zr - zl AS delta FROM pr WHERE zl IS NOT NULL AND zr IS NOT NULL)"""


@query(
    "trait_concordance",
    f"WITH {_PAIR} SELECT factor, 'combined' AS direction, factor AS label, round(zl, 6) AS z_left, round(zr, 6) AS z_right, round(delta, 6) AS delta FROM dl",
)
def trait_concordance(spark, d):
    return rounded(views.trait_concordance(results(spark, d), traits=["t1", "t2"]))


@query(
    "concordance_summary",
    f"""WITH {_PAIR} SELECT count(*) AS n, round(quantile_cont(delta, 0.5), 6) AS median_shift,
      CAST(least(30, greatest(5, count(*) // 2)) AS INTEGER) AS bins, round(min(delta), 6) AS low, round(max(delta), 6) AS high FROM dl""",
)
def concordance_summary(spark, d):
    return rounded(views.concordance_summary(views.trait_concordance(results(spark, d), traits=["t1", "t2"])))


@query(
    "concordance_histogram",
    f"""WITH {_PAIR}, s AS (SELECT least(30, greatest(5, count(*) // 2)) AS b, min(delta) AS lo, max(delta) AS hi FROM dl),
    h AS (SELECT least(CAST(floor((delta - lo) / ((hi - lo) / b)) AS INTEGER), b - 1) AS bin, count(*) AS n FROM dl, s GROUP BY 1)
    SELECT CAST(g.i AS INTEGER) AS bin, round(lo + g.i * ((hi - lo) / b), 6) AS "left", round(lo + (g.i + 1) * ((hi - lo) / b), 6) AS "right",
      coalesce(h.n, 0) AS n FROM s, range(0, 30) g(i) LEFT JOIN h ON h.bin = g.i WHERE g.i < b""",
)
def concordance_histogram(spark, d):
    return rounded(views.concordance_histogram(views.trait_concordance(results(spark, d), traits=["t1", "t2"])))

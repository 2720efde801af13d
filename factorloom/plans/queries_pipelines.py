"""Checked queries: whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators.motif import covariate_strata
from factorloom.plans import inputs as i
from factorloom.plans.pipelines import motif_analysis, trait_analysis
from factorloom.plans.queries_genome import _MAP, _bin_sql, _edges_sql, _nes_digits
from factorloom.plans.queries_groups import _round_summary, _select_summary
from factorloom.plans.queries_stats import _RATIO
from factorloom.plans.registry import query


@query(
    "trait_analysis",
    f"WITH {_RATIO}, x AS (SELECT zs.vec_id, label, cs FROM zs JOIN embeddings ON embeddings.vec_id = zs.vec_id), "
    + f"tested AS (SELECT min(q) AS q, count(*) FILTER (WHERE q < 0.6) AS n FROM (WITH {i.RESQ} SELECT q FROM resq WHERE trait = 't0')) SELECT label, "
    + _select_summary("cs").format(q="")
    + ", (SELECT round(q, 8) FROM tested) AS least_q, (SELECT n FROM tested) AS n_significant FROM x GROUP BY label",
)
def trait_summary(spark, d):
    rows, names = i.cells(spark, d)
    done = trait_analysis(rows, i.results(spark, d), x="x", names=names, trait="t0", by="label")
    tested = done.results.where("trait = 't0'").agg(F.min("fdr_q").alias("q"), F.count_if(F.col("fdr_q") < 0.6).alias("n")).first()
    return _round_summary(done.summary.frame).withColumns(
        {"least_q": F.lit(round(tested["q"], 8)), "n_significant": F.lit(tested["n"]).cast("bigint")}
    )


@query("trait_analysis_results", f"WITH {i.RESQ} SELECT trait, factor, round(p, 8) AS p, round(q, 8) AS fdr_q FROM resq")
def trait_results(spark, d):
    """The corrected tests of every trait, as the whole analysis leaves them."""
    rows, names = i.cells(spark, d)
    done = trait_analysis(rows, i.results(spark, d), x="x", names=names, trait="t0", by="label")
    return done.results.select("trait", "factor", *[F.round(c, 8).alias(n) for c, n in (("p_1tailed", "p"), ("fdr_q", "fdr_q"))])


_REGION_STRATA = f"""wid AS (SELECT DISTINCT regions.region, CAST(e - s AS DOUBLE) AS a, CAST(s AS DOUBLE) AS b FROM regions),
{_edges_sql('ea', 'wid', 'a', 3)}, {_edges_sql('eb', 'wid', 'b', 2)},
code AS (SELECT region, {_bin_sql('ea', 'a')} + 3 * {_bin_sql('eb', 'b')} AS c FROM wid),
strata AS (SELECT region, c AS stratum FROM code WHERE region IN (SELECT region FROM mp))"""


@query(
    "motif_analysis",
    f"""WITH {i.EMB}, {_MAP}, {i.LOADINGS}, {_REGION_STRATA},
    w0 AS (SELECT region, factor, avg(loading) AS w FROM mp JOIN ld ON ld.peak = mp.peak AND direction = 'pos' GROUP BY region, factor),
    wn AS (SELECT factor, w0.region, stratum, w / sum(w) OVER (PARTITION BY factor) AS w FROM w0 JOIN strata ON strata.region = w0.region),
    s AS (SELECT strata.region, l_suppkey AS motif, sum(l_quantity) AS score, any_value(stratum) AS stratum FROM lineitem JOIN strata ON strata.region = 'r' || l_partkey GROUP BY 1, 2),
    ng AS (SELECT stratum, count(*) AS n FROM strata GROUP BY stratum),
    t AS (SELECT factor, motif, sum(w * score) AS t FROM wn JOIN s ON s.region = wn.region GROUP BY 1, 2),
    wm AS (SELECT factor, stratum, sum(w) AS a, sum(w * w) AS a2 FROM wn GROUP BY 1, 2),
    sm AS (SELECT motif, stratum, sum(score) AS b, sum(score * score) AS b2 FROM s GROUP BY 1, 2),
    nul AS (SELECT factor, motif, sum(a * b / n) AS e, sum((a2 - a * a / n) * (b2 - b * b / n) / greatest(n - 1, 1)) AS var
      FROM wm JOIN sm ON wm.stratum = sm.stratum JOIN ng ON ng.stratum = wm.stratum GROUP BY 1, 2),
    tot AS (SELECT count(*) AS r FROM strata), w1 AS (SELECT factor, sum(a) AS a, sum(a2) AS a2 FROM wm GROUP BY 1), s1 AS (SELECT motif, sum(b) AS b, sum(b2) AS b2 FROM sm GROUP BY 1)
    SELECT nul.factor, nul.motif AS motif_id, round(coalesce(t, 0), 8) AS weighted_score, round(CASE WHEN var > 0 THEN (coalesce(t, 0) - e) / sqrt(var) ELSE 0 END, 6) AS nes,
      round((coalesce(t, 0) - w1.a * s1.b / r) / sqrt((w1.a2 - w1.a * w1.a / r) * (s1.b2 - s1.b * s1.b / r) / (r - 1)), 6) AS nes_unstratified,
      CAST(r AS INTEGER) AS n_regions
    FROM nul JOIN w1 ON w1.factor = nul.factor JOIN s1 ON s1.motif = nul.motif JOIN tot ON true LEFT JOIN t ON t.factor = nul.factor AND t.motif = nul.motif""",
)
def motif_tables(spark, d):
    regions = i.regions(spark, d)
    shape = regions.select(
        "region", (F.col("end") - F.col("start")).cast("double").alias("a"), F.col("start").cast("double").alias("b")
    )
    strata = covariate_strata(shape, ["a", "b"], [3, 2], min_size=1)
    loads = i.peak_loadings(spark, d).where("direction = 'pos'").withColumnRenamed("loading", "weight")
    scores = i.motif_scores(spark, d).withColumn("region", F.concat(F.lit("r"), F.col("region").cast("string")))
    return _nes_digits(motif_analysis(i.peaks(spark, d), regions, loads, scores, strata))

"""Checked queries: intervals, risk, sequence content, strata, motif enrichment."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from factorloom.functions import interval_name, is_primary_interval, parse_interval
from factorloom.operators import intervals, motif, risk, sequence
from factorloom.plans import inputs as i
from factorloom.plans.registry import query, rounded, table
from factorloom.session import scratch_path
from factorloom.sources.snps import thin_annotation


# ---------------------------------------------------------------- intervals
@query(
    "interval_names",
    f"""WITH {i.PEAKS} SELECT peak, chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", peak AS again,
      regexp_full_match(peak, 'chr([1-9]|1[0-9]|2[0-2]|X|Y):\\d+-\\d+') AS is_primary FROM peaks""",
)
def interval_names(spark, d):
    chrom, start, end = parse_interval("peak")
    rows = i.peaks(spark, d).select("peak", chrom.alias("chrom"), start.alias("start"), end.alias("end"))
    return rows.select(
        "*", interval_name("chrom", "start", "end").alias("again"), is_primary_interval("peak").alias("is_primary")
    )


@query("assign_points", f"WITH {i.ASSIGNED} SELECT row_ix, chrom, bp, peak FROM assigned")
def assign_points(spark, d):
    return i.assigned(spark, d).select("row_ix", "chrom", "bp", "peak")


_MIXED = f"""{i.PEAKS}, {i.SNPS}, long AS (SELECT peak, chrom, s * 10 AS s, CASE WHEN p_partkey % 3 = 0 THEN s * 10 + 9000 ELSE s * 10 + 40 END AS e FROM peaks)"""


@query(
    "assign_points_mixed_lengths",
    f"""WITH {_MIXED} SELECT snps.row_ix, long.peak FROM snps
    LEFT JOIN long ON 'chr' || snps.chrom = long.chrom AND long.s < snps.bp AND snps.bp <= long.e""",
)
def assign_points_mixed_lengths(spark, d):
    start = F.col("start") * 10
    end = F.when(F.col("p_partkey") % 3 == 0, start + 9000).otherwise(start + 40)
    rows = i.peaks(spark, d).select("peak", "chrom", start.alias("start"), end.alias("end"))
    return intervals.assign_points(i.snps(spark, d), rows).select("row_ix", "peak")


@query("interval_counts", f"WITH {i.COUNTS} SELECT peak, n_snps FROM counts")
def interval_counts(spark, d):
    return intervals.interval_counts(i.snps(spark, d), i.peaks(spark, d))


@query(
    "overlap_check",
    f"""WITH {i.PEAKS} SELECT count(*) FILTER (WHERE s < prev) AS overlaps FROM (
      SELECT s, max(e) OVER (PARTITION BY chrom ORDER BY s, e, peak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM peaks)""",
)
def overlap_check(spark, d):
    rows = i.peaks(spark, d)
    intervals.check_disjoint(rows)
    pairs = intervals.overlap_pairs(rows.select("peak", "chrom", "start", "end"), rows.select("peak", "chrom", "start", "end"))
    return pairs.agg(F.count_if(F.col("peak") < F.col("peak_2")).alias("overlaps"))


@query(
    "overlap_count",
    f"""WITH {i.PEAKS}, w AS (SELECT peak, chrom, s, e + 2000 AS e FROM peaks)
    SELECT count(*) AS overlaps FROM w a JOIN w b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND a.peak < b.peak""",
)
def overlap_count(spark, d):
    wide = i.peaks(spark, d).select("peak", "chrom", "start", (F.col("end") + 2000).alias("end"))
    return intervals.overlap_pairs(wide, wide).agg(F.count_if(F.col("peak") < F.col("peak_2")).alias("overlaps"))


@query(
    "overlap_pairs",
    f"""WITH {i.PEAKS}, {i.REGIONS} SELECT peaks.peak, regions.region, CAST(least(peaks.e, regions.e) - greatest(peaks.s, regions.s) AS BIGINT) AS overlap
    FROM peaks JOIN regions ON peaks.chrom = regions.chrom AND peaks.s < regions.e AND regions.s < peaks.e""",
)
def overlap_pairs(spark, d):
    pairs = intervals.overlap_pairs(
        i.peaks(spark, d).select("peak", "chrom", "start", "end"), i.regions(spark, d)
    )
    return pairs.select("peak", F.col("region_2").alias("region"), "overlap")


@query(
    "overlap_pairs_mixed_lengths",
    f"""WITH {i.PEAKS}, {i.REGIONS},
    a AS (SELECT peak, chrom, s, CASE WHEN p_partkey % 50 = 0 THEN s + 60000 WHEN p_partkey % 7 = 0 THEN s + 5000 ELSE e END AS e FROM peaks),
    b AS (SELECT region, chrom, s, CASE WHEN s % 11 = 0 THEN s + 9000 ELSE e END AS e FROM regions)
    SELECT a.peak, b.region, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS BIGINT) AS overlap FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e""",
)
def overlap_pairs_mixed_lengths(spark, d):
    k = F.col("p_partkey")
    end = F.when(k % 50 == 0, F.col("start") + 60000).when(k % 7 == 0, F.col("start") + 5000).otherwise(F.col("end"))
    a = i.peaks(spark, d).select("peak", "chrom", "start", end.alias("end"))
    end = F.when(F.col("start") % 11 == 0, F.col("start") + 9000).otherwise(F.col("end"))
    b = i.regions(spark, d).select("region", "chrom", "start", end.alias("end"))
    return intervals.overlap_pairs(a, b).select("peak", F.col("region_2").alias("region"), "overlap")


_MAP = f"""{i.PEAKS}, {i.REGIONS}, ov AS (SELECT region, peak, least(peaks.e, regions.e) - greatest(peaks.s, regions.s) AS o, peaks.e - peaks.s AS lp, regions.e - regions.s AS lr
    FROM peaks JOIN regions ON peaks.chrom = regions.chrom AND peaks.s < regions.e AND regions.s < peaks.e),
mp AS (SELECT region, peak, CAST(o AS BIGINT) AS overlap FROM ov WHERE o / lp::DOUBLE > 0.4 OR o / lr::DOUBLE > 0.4)"""


def _region_map(spark, d):
    return intervals.region_map(i.peaks(spark, d), i.regions(spark, d))


@query("region_map", f"WITH {_MAP} SELECT region, peak, overlap FROM mp")
def region_map(spark, d):
    return _region_map(spark, d)


@query(
    "restrict_to_reference",
    f"""WITH {i.SNPS}, ref AS (SELECT 'rs' || l_orderkey AS snp, min(l_suppkey) * 100000000 + l_orderkey AS ref_ix FROM lineitem GROUP BY l_orderkey)
    SELECT snps.snp, bp, ref_ix FROM snps JOIN ref ON ref.snp = snps.snp""",
)
def restrict_to_reference(spark, d):
    ref = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    ref = ref.select(
        F.concat(F.lit("rs"), F.col("l_orderkey").cast("string")).alias("snp"),
        (F.col("s") * 100000000 + F.col("l_orderkey")).alias("ref_ix"),
    )
    return intervals.restrict_to_reference(i.snps(spark, d), ref).select("snp", "bp", "ref_ix")


@query(
    "thin_annotation",
    f"""WITH {i.EMB}, {i.ASSIGNED}, {i.LOADINGS}, an AS (SELECT DISTINCT factor FROM ld)
    SELECT an.factor AS annot, chrom, row_ix, coalesce(ld.loading, 0) AS value FROM assigned CROSS JOIN an
    LEFT JOIN ld ON ld.peak = assigned.peak AND ld.factor = an.factor AND ld.direction = 'pos'""",
)
def thin(spark, d):
    loads = i.peak_loadings(spark, d).where("direction = 'pos'").withColumnRenamed("factor", "annot")
    return thin_annotation(i.snps(spark, d), i.peaks(spark, d), loads)


# ---------------------------------------------------------------- risk
_RISK = f"""{i.RES}, {i.COUNTS}, {i.LOADINGS}, risk AS (
  SELECT ld.peak, chrom, s AS start, e AS "end", ld.factor, direction, loading, coef AS tau, loading * coef AS risk_rate, loading * coef * n_snps AS risk_total
  FROM ld JOIN peaks ON peaks.peak = ld.peak JOIN res ON res.factor = ld.factor AND res.trait = 't0' JOIN counts ON counts.peak = ld.peak WHERE loading <> 0)"""
_RISK_COLS = """peak, chrom, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", factor, direction, round(loading, 8) AS loading,
  round(tau, 8) AS tau, round(risk_rate, 9) AS risk_rate, round(risk_total, 8) AS risk_total"""


def _risk(spark, d):
    counts = intervals.interval_counts(i.snps(spark, d), i.peaks(spark, d))
    return risk.peak_risk(i.peak_loadings(spark, d), i.fitted(spark, d), counts)


def _round_risk(df):
    return rounded(df.withColumn("risk_rate", F.round("risk_rate", 9).cast("decimal(20,9)")), 8).withColumn(
        "risk_rate", F.col("risk_rate").cast("double")
    )


@query("peak_risk", f"WITH {_RISK} SELECT {_RISK_COLS} FROM risk")
def peak_risk(spark, d):
    return _round_risk(_risk(spark, d))


@query("top_risk", f"WITH {_RISK} SELECT {_RISK_COLS} FROM (SELECT * FROM risk ORDER BY risk_total DESC, peak, factor, direction LIMIT 20)")
def top_risk(spark, d):
    return _round_risk(risk.top_risk(_risk(spark, d)))


@query(
    "top_risk_per_factor",
    f"""WITH {_RISK}, r AS (SELECT *, row_number() OVER (PARTITION BY factor, direction ORDER BY risk_rate DESC, peak) AS k FROM risk)
    SELECT {_RISK_COLS} FROM r WHERE k <= 5""",
)
def top_risk_per_factor(spark, d):
    return _round_risk(risk.top_risk_per_group(_risk(spark, d), 5, by="risk_rate"))


_TRACK = f"""{_RISK}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peak ORDER BY risk_rate DESC, factor, direction) AS k FROM risk) WHERE k = 1),
offs AS (SELECT chrom, coalesce(sum(m + 1) OVER (ORDER BY CAST(substr(chrom, 4) AS INTEGER) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM (SELECT chrom, max("end") AS m FROM best GROUP BY chrom)),
track AS (SELECT peak, best.chrom, CAST(start AS BIGINT) AS start, factor, direction, CAST(o + start AS BIGINT) AS x, round(risk_rate, 9) AS y FROM best JOIN offs ON offs.chrom = best.chrom)"""


@query("risk_track", f"WITH {_TRACK} SELECT * FROM track")
def risk_track(spark, d):
    return rounded(risk.risk_track(_risk(spark, d), value="risk_rate"), 9)


@query("risk_track_ticks", f"WITH {_TRACK} SELECT chrom, min(x - start) + quantile_cont(start, 0.5) AS tick FROM track GROUP BY chrom")
def risk_track_ticks(spark, d):
    return risk.track_ticks(risk.risk_track(_risk(spark, d), value="risk_rate"))


# ---------------------------------------------------------------- sequence content
_WINDOWS = """win AS (SELECT doc_id || ':' || w AS region, CAST(doc_id AS VARCHAR) AS chrom, w * 200 AS s, w * 200 + 50 + (w * 37 + doc_id * 13) % 200 AS e, text
  FROM (SELECT doc_id, text, unnest(range(length(text) // 200 + 1)) AS w FROM documents)),
gcs AS (SELECT region, chrom, s, e, substring(text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)) AS q FROM win),
gc AS (SELECT region, chrom, s, e, round_even(length(regexp_replace(q, '[^GCgc]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(q, '[^ACGTacgt]', '', 'g')), 0), 3) AS gc FROM gcs)"""


def _windows(spark, d):
    docs = table(spark, d, "documents")
    w = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 200).cast("int")))
    rows = docs.select("doc_id", w.alias("w"))
    start = F.col("w").cast("bigint") * 200
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("w").cast("string")).alias("region"),
        F.col("doc_id").cast("string").alias("chrom"),
        start.alias("start"),
        (start + 50 + (F.col("w") * 37 + F.col("doc_id") * 13) % 200).alias("end"),
    )


def _chunks(spark, d):
    return sequence.chunk_sequences(table(spark, d, "documents"), "doc_id", "text", 1024)


@query("gc_content", f"WITH {_WINDOWS} SELECT region, gc FROM gc")
def gc_content(spark, d):
    return sequence.gc_content(_windows(spark, d), _chunks(spark, d), size=1024).select("region", "gc")


def _edges_sql(name: str, source: str, column: str, n: int) -> str:
    points = ", ".join(str(k / n) for k in range(n + 1))
    return f"{name} AS (SELECT DISTINCT unnest(quantile_cont({column}, [{points}])) AS e FROM {source})"


def _bin_sql(name: str, column: str) -> str:
    return f"greatest(0, least((SELECT count(*) FROM {name} WHERE e <= {column}) - 1, (SELECT count(*) FROM {name}) - 2))"


_STRATA = f"""cv AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part),
{_edges_sql('ea', 'cv', 'a', 4)}, {_edges_sql('eb', 'cv', 'b', 5)},
code AS (SELECT p_partkey, {_bin_sql('ea', 'a')} + 4 * {_bin_sql('eb', 'b')} AS c FROM cv),
big AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS stratum FROM code GROUP BY c HAVING count(*) >= 10),
strata AS (SELECT p_partkey AS region, CAST(stratum AS INTEGER) AS stratum FROM code JOIN big ON big.c = code.c)"""


def _strata(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("region"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")
    )
    return motif.covariate_strata(rows, ["a", "b"], [4, 5], min_size=10).select("region", "stratum")


@query("covariate_strata", f"WITH {_STRATA} SELECT region, stratum FROM strata")
def covariate_strata(spark, d):
    return _strata(spark, d)


@query(
    "gc_width_strata",
    f"""WITH {_WINDOWS}, cv AS (SELECT region, gc AS a, CAST(e - s AS DOUBLE) AS b FROM gc WHERE gc IS NOT NULL),
    {_edges_sql('ea', 'cv', 'a', 6)}, {_edges_sql('eb', 'cv', 'b', 5)},
    code AS (SELECT region, {_bin_sql('ea', 'a')} + 6 * {_bin_sql('eb', 'b')} AS c FROM cv),
    big AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS stratum FROM code GROUP BY c HAVING count(*) >= 2)
    SELECT region, CAST(stratum AS INTEGER) AS stratum FROM code JOIN big ON big.c = code.c""",
)
def gc_width_strata(spark, d):
    rows = motif.gc_width_strata(_windows(spark, d), _chunks(spark, d), gc_bins=6, width_bins=5, size=1024)
    return rows.select("region", "stratum")


# ---------------------------------------------------------------- motif enrichment
@query(
    "soft_threshold",
    f"""WITH {i.WEIGHTS}, cut AS (SELECT factor, quantile_cont(weight, 0.5) AS c FROM weights WHERE weight > 0 GROUP BY factor)
    SELECT weights.factor, region, round(CASE WHEN weight < c THEN 0 ELSE weight END, 2) AS weight FROM weights JOIN cut ON cut.factor = weights.factor""",
)
def soft_threshold(spark, d):
    return rounded(motif.soft_threshold(i.motif_weights(spark, d)).select("factor", "region", "weight"), 2)


@query(
    "regionise",
    f"""WITH {i.EMB}, {_MAP}, {i.LOADINGS} SELECT region, factor, round(avg(loading), 8) AS weight
    FROM mp JOIN ld ON ld.peak = mp.peak AND direction = 'pos' GROUP BY region, factor""",
)
def regionise(spark, d):
    loads = i.peak_loadings(spark, d).where("direction = 'pos'").withColumnRenamed("loading", "weight")
    return rounded(motif.regionise(_region_map(spark, d), loads), 8)


_NES = f"""{_STRATA}, {i.SCORES}, {i.WEIGHTS}, cutp AS (SELECT factor, quantile_cont(weight, 0.5) AS c FROM weights GROUP BY factor),
w AS (SELECT weights.factor, region, strata.stratum, CASE WHEN weight < c THEN 0 ELSE weight END AS w0 FROM weights JOIN cutp ON cutp.factor = weights.factor JOIN strata USING (region)),
wn AS (SELECT factor, region, stratum, w0 / sum(w0) OVER (PARTITION BY factor) AS w FROM w),
s AS (SELECT region, motif, score, stratum FROM scores JOIN strata USING (region)),
ng AS (SELECT stratum, count(*) AS n FROM strata GROUP BY stratum), tot AS (SELECT count(*) AS r FROM strata),
km AS (SELECT f.factor, m.motif FROM (SELECT DISTINCT factor FROM wn) f CROSS JOIN (SELECT DISTINCT motif FROM scores) m),
t AS (SELECT factor, motif, sum(w * score) AS t FROM wn JOIN s USING (region) GROUP BY factor, motif),
wm AS (SELECT factor, stratum, sum(w) AS a, sum(w * w) AS a2 FROM wn GROUP BY factor, stratum),
sm AS (SELECT motif, stratum, sum(score) AS b, sum(score * score) AS b2 FROM s GROUP BY motif, stratum),
nul AS (SELECT factor, motif, sum(a * b / n) AS e, sum((a2 - a * a / n) * (b2 - b * b / n) / greatest(n - 1, 1)) AS var
  FROM wm JOIN sm USING (stratum) JOIN ng USING (stratum) GROUP BY factor, motif),
w1 AS (SELECT factor, sum(w) AS a, sum(w * w) AS a2 FROM wn GROUP BY factor), s1 AS (SELECT motif, sum(score) AS b, sum(score * score) AS b2 FROM s GROUP BY motif),
full_ AS (SELECT km.factor, km.motif, coalesce(t.t, 0) AS t, coalesce(e, 0) AS e, coalesce(var, 0) AS var, w1.a * coalesce(s1.b, 0) / r AS e1,
    (w1.a2 - w1.a * w1.a / r) * (coalesce(s1.b2, 0) - coalesce(s1.b, 0) * coalesce(s1.b, 0) / r) / (r - 1) AS var1, r
  FROM km JOIN tot ON true JOIN w1 USING (factor) LEFT JOIN s1 USING (motif) LEFT JOIN t USING (factor, motif) LEFT JOIN nul USING (factor, motif))
SELECT factor, motif AS motif_id, round(t, 8) AS weighted_score, round(CASE WHEN var > 0 THEN (t - e) / sqrt(var) ELSE 0 END, 6) AS nes,
  round(CASE WHEN var1 > 0 THEN (t - e1) / sqrt(var1) ELSE 0 END, 6) AS nes_unstratified"""


def _nes_digits(df):
    return df.select(
        "factor",
        "motif_id",
        F.round("weighted_score", 8).alias("weighted_score"),
        F.round("nes", 6).alias("nes"),
        F.round("nes_unstratified", 6).alias("nes_unstratified"),
        *[c for c in df.columns if c in ("tf_annotation", "n_regions")],
    )


@query(
    "motif_enrichment",
    f"WITH {_NES}, CASE WHEN motif % 2 = 0 THEN 'TF' || motif END AS tf_annotation, CAST(r AS INTEGER) AS n_regions FROM full_",
)
def motif_enrichment(spark, d):
    tf = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("motif"), F.concat(F.lit("TF"), F.col("s_suppkey").cast("string")).alias("tf_annotation")
    )
    weights = motif.soft_threshold(i.motif_weights(spark, d))
    return _nes_digits(motif.motif_enrichment(weights, i.motif_scores(spark, d), _strata(spark, d), tf=tf))


_DENSE = i.EMB + """, scores AS (SELECT p_partkey AS region, factor AS motif, v AS score
  FROM part JOIN emb ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""


@query("motif_enrichment_dense", f"WITH {_NES.replace(i.SCORES, _DENSE)}, CAST(r AS INTEGER) AS n_regions FROM full_")
def motif_enrichment_dense(spark, d):
    """Scores that are stored as arrays, in four slabs."""
    cells, _ = i.cells(spark, d)
    regions = table(spark, d, "part").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") % cells.count()).alias("cell_id"))
    vectors = regions.join(cells, "cell_id").select("region", F.col("x").alias("s"))
    last = cells.agg(F.max(F.size("x")).alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("pos"))
    names = last.select("pos", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("motif"))
    weights = motif.soft_threshold(i.motif_weights(spark, d))
    return _nes_digits(motif.motif_enrichment(weights, vectors, _strata(spark, d), motifs=names, block=16))


@query("motif_enrichment_checked", f"WITH {_NES}, CAST(r AS INTEGER) AS n_regions FROM full_")
def motif_enrichment_checked(spark, d):
    """With a scaled copy of the first factor on the same pass; scores that differ from it raise."""
    weights = motif.soft_threshold(i.motif_weights(spark, d))
    return _nes_digits(motif.motif_enrichment(weights, i.motif_scores(spark, d), _strata(spark, d), check_invariance=True))


@query(
    "region_map_coverage",
    f"""WITH {_MAP} SELECT count(DISTINCT region) AS regions_matched, (SELECT count(*) FROM regions) AS regions,
      count(DISTINCT peak) AS features_matched, (SELECT count(*) FROM peaks) AS features FROM mp""",
)
def region_map_coverage(spark, d):
    counts = intervals.map_regions(i.peaks(spark, d), i.regions(spark, d)).coverage
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))


@query(
    "used_regions",
    f"WITH {_STRATA}, {i.SCORES} SELECT region, motif, score FROM scores WHERE region IN (SELECT region FROM strata)",
)
def used_regions(spark, d):
    return motif.used_regions(i.motif_scores(spark, d), _strata(spark, d)).select("region", "motif", "score")


@query(
    "enrichment_meta",
    f"""WITH {_STRATA} SELECT (SELECT count(*) FROM strata) AS n_regions, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_factors,
      (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_motifs, (SELECT count(DISTINCT stratum) FROM strata) AS n_strata""",
)
def enrichment_meta(spark, d):
    seen = Observation()
    found = motif.motif_enrichment(i.motif_weights(spark, d), i.motif_scores(spark, d), _strata(spark, d), observation=seen)
    found.write.parquet(scratch_path(spark, "enrichment"))
    counts = motif.enrichment_meta(seen)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))

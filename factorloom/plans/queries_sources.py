"""Checked queries: readers and writers. Files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import factors as fac
from factorloom.operators.sequence import gc_content
from factorloom.plans import inputs as i
from factorloom.plans.queries_genome import _WINDOWS, _windows
from factorloom.plans.queries_stats import _RATIO, _ratio_scores
from factorloom.plans.registry import query, rounded, table
from factorloom.session import scratch_path
from factorloom.sources import manifest
from factorloom.sources import results as res
from factorloom.sources import scores as scs
from factorloom.sources import sequences, snps


@query(
    "read_results",
    f"""WITH {i.RESQ} SELECT 'own' AS "Category", trait, 'k' || (pos + 1) AS annot, factor, 'combined' AS direction,
      round(coef, 8) AS coef, round(z, 6) AS z, round(q, 8) AS q FROM resq""",
)
def read_results(spark, d):
    rows, names = i.cells(spark, d)
    number = F.regexp_extract("factor", r"(\d+)", 1).cast("int") + 1
    stats = i.results(spark, d).withColumn("annot", F.concat(F.lit("k"), number.cast("string")))
    own = F.concat_ws("\t", F.lit("own"), F.col("Coefficient").cast("string"), F.col("`Coefficient_z-score`").cast("string"))
    text = F.concat_ws("\n", F.lit("Category\tCoefficient\tCoefficient_z-score"), own, F.lit("baseline_1\t0.5\t1.5"))
    path = scratch_path(spark, "results")
    stats.select("trait", "annot", text.alias("value")).repartition("trait").write.partitionBy("trait", "annot").text(path)
    traits = sorted(r[0] for r in stats.select("trait").distinct().collect())
    back = res.read_results(
        spark,
        path,
        traits=traits,
        annot2factor={f"k{k + 1}": n for k, n in enumerate(names)},
        layout=res.PARTITION_LAYOUT,
    )
    return back.select(
        "Category",
        "trait",
        "annot",
        "factor",
        "direction",
        F.round("Coefficient", 8).alias("coef"),
        F.round("`Coefficient_z-score`", 6).alias("z"),
        F.round("fdr_q", 8).alias("q"),
    )


@query("results_files", "SELECT DISTINCT 't' || label AS annot FROM embeddings WHERE label IS NOT NULL")
def results_files(spark, d):
    traits = i.results(spark, d).select("trait").distinct()
    path = scratch_path(spark, "files")
    traits.select("trait", F.lit("Category").alias("value")).write.partitionBy("trait").text(path)
    # Files are named by Spark; the trait folder stands for the annotation here.
    found = res.results_files(spark, path, pattern="*.txt", layout=r"trait=([^/]+)/[^/]+$")
    return found.select("annot")


@query(
    "read_snp_table",
    f"""WITH {i.SNPS} SELECT row_number() OVER (ORDER BY row_ix) - 1 AS row_ix, chrom, snp, 0.5::DOUBLE AS cm, bp, 'A' AS a1, 'G' AS a2 FROM snps""",
)
def read_snp_table(spark, d):
    rows = i.snps(spark, d)
    line = F.concat_ws("\t", "chrom", "snp", F.lit("0.5"), F.col("bp").cast("string"), F.lit("A"), F.lit("G"))
    path = scratch_path(spark, "snps")
    rows.orderBy("row_ix").select(line.alias("value")).write.text(path)
    return snps.read_snp_table(spark, path)


@query("read_cell_scores", f"WITH {_RATIO} SELECT CAST(vec_id AS VARCHAR) AS barcode, round(cs, 7) AS cs FROM ratio")
def read_cell_scores(spark, d):
    path = scratch_path(spark, "scores")
    frame = _ratio_scores(spark, d).frame.withColumnRenamed("cell_id", "barcode")
    frame.write.option("sep", "\t").option("header", "true").csv(path)
    return rounded(scs.read_cell_scores(spark, path, model="m", trait="t0").frame, 7)


@query(
    "write_thin_annotation",
    f"""WITH {i.EMB}, {i.ASSIGNED}, {i.LOADINGS}, an AS (SELECT DISTINCT factor FROM ld)
    SELECT an.factor AS annot, chrom, count(*) AS n, round(sum(coalesce(ld.loading, 0)), 6) AS total FROM assigned CROSS JOIN an
    LEFT JOIN ld ON ld.peak = assigned.peak AND ld.factor = an.factor AND ld.direction = 'pos' GROUP BY 1, 2""",
)
def write_thin_annotation(spark, d):
    loads = i.peak_loadings(spark, d).where("direction = 'pos'").withColumnRenamed("factor", "annot")
    path = scratch_path(spark, "annot")
    values, names = snps.thin_values(i.snps(spark, d), i.peaks(spark, d), loads)
    snps.write_thin_annotation(values, path, names=names)
    back = snps.read_thin_annotation(spark, path)
    return back.groupBy("annot", "chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    "pending_work",
    """SELECT DISTINCT l_returnflag AS annot, l_linestatus AS chrom FROM lineitem WHERE l_returnflag <> 'R'""",
)
def pending_work(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("annot"), F.col("l_linestatus").alias("chrom"), "l_quantity")
    keys, path = ["annot", "chrom"], scratch_path(spark, "done")
    manifest.write_work(rows, rows.where("annot = 'R'"), path, keys)
    # Files of a run that was lost before it committed.
    rows.where("annot = 'N' AND l_quantity < 10").write.mode("append").partitionBy(*keys).parquet(path)
    return manifest.pending_work(rows.select(*keys).distinct(), path, keys)


@query(
    "arm_store",
    f"WITH {i.RES} SELECT trait, factor, 'combined' AS direction, round(CASE WHEN trait IN ('t0', 't1', 't2', 't3', 't4') THEN coef * 2 ELSE coef END, 8) AS coef FROM res",
)
def arm_store(spark, d):
    rows, names = i.cells(spark, d)
    stats = i.results(spark, d).select("trait", "factor", "direction", F.col("Coefficient").alias("coef"))
    fmap = fac.select_factors(fac.factor_stats(rows, "x", names, threshold=0.1), names)
    first = F.col("trait").isin("t0", "t1", "t2", "t3", "t4")
    path = scratch_path(spark, "arms")
    res.write_arm(stats.where(first), fmap, path, "first")
    res.write_arm(stats.where(~first), fmap, path, "second")
    # The second write of an arm replaces it and leaves the other one alone.
    res.write_arm(stats.where(first).withColumn("coef", F.col("coef") * 2), fmap, path, "first")
    parts = [res.read_arm(spark, path, arm)["results"] for arm in ("first", "second")]
    return rounded(parts[0].unionByName(parts[1]), 8)


@query("score_regions", "SELECT DISTINCT l_partkey AS region FROM lineitem")
def score_regions(spark, d):
    path = scratch_path(spark, "db")
    i.motif_scores(spark, d).write.parquet(path)
    return scs.score_regions(scs.read_score_table(spark, path))


@query("score_motifs", "SELECT motif, row_number() OVER (ORDER BY motif) - 1 AS pos FROM (SELECT DISTINCT l_suppkey AS motif FROM lineitem)")
def score_motifs(spark, d):
    return scs.score_motifs(i.motif_scores(spark, d))


@query(
    "wide_scores",
    """SELECT l_returnflag AS region, CAST(l_suppkey AS VARCHAR) AS motif, CAST(sum(l_quantity) AS FLOAT)::DOUBLE AS score FROM lineitem GROUP BY 1, 2""",
)
def wide_scores(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("motifs")).pivot("l_returnflag", ["A", "N", "R"]).sum("l_quantity")
    wide = wide.select("A", "N", "R", "motifs")
    rows = scs.wide_to_long(wide, ["A", "N", "R"]).where("score is not null")
    return rows.withColumn("score", F.col("score").cast("double"))


@query("gc_from_fasta", f"WITH {_WINDOWS} SELECT region, gc FROM gc")
def gc_from_fasta(spark, d):
    docs = table(spark, d, "documents")
    body = F.translate(F.col("text"), "\n\r\t >", "NNNNN")
    width = 60
    starts = F.sequence(F.lit(0), F.floor((F.length("b") - 1) / width).cast("int"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" a sequence")),
        F.array_join(F.transform(starts, lambda s: F.substring(F.col("b"), s * width + 1, F.lit(width))), "\n"),
    )
    path = scratch_path(spark, "fasta")
    docs.select("doc_id", body.alias("b")).where("length(b) > 0").select(lines.alias("value")).write.text(path)
    chunks = sequences.read_fasta(spark, path, 1024)
    return gc_content(_windows(spark, d), chunks, size=1024).select("region", "gc")

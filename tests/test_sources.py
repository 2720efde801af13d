import gzip

import pytest
from pyspark.sql import functions as F

from factorloom.operators import qc
from factorloom.operators.sequence import gc_content
from factorloom.sources import manifest
from factorloom.sources import results as res
from factorloom.sources import scores as scs
from factorloom.sources import sequences, snps
from tests.conftest import close, rows

Z = "Coefficient_z-score"


def tree(root, traits=("t1", "t2"), annots=("k1", "k2")):
    for t in traits:
        (root / t).mkdir(parents=True)
        for i, a in enumerate(annots):
            text = f"Category\t{Z}\tCoefficient\nown\t{i + 1.5}\t0.{i + 1}\nbaseline_1\t9.0\t9.0\n"
            (root / t / f"{a}.results").write_text(text)
    return str(root)


A2F = {"k1": "d0", "k2": "d1"}


def test_results_take_the_tested_row_of_every_file(spark, tmp_path):
    root = tree(tmp_path / "r")
    got = res.read_results(spark, root, traits=["t1", "t2"], annot2factor=A2F)
    assert got.columns == ["Category", Z, "Coefficient", "trait", "annot", "factor", "direction", "p_1tailed", "fdr_q"]
    found = {(r["trait"], r["annot"]): r for r in got.collect()}
    assert len(found) == 4 and found[("t2", "k2")]["factor"] == "d1" and found[("t2", "k2")][Z] == 2.5
    assert all(r["Category"] == "own" and r["direction"] == "combined" for r in found.values())
    base = res.read_results(spark, root, traits=["t1"], annot2factor=A2F, row=1, fdr=False, direction={"k1": "pos", "k2": "neg"})
    assert rows(base.select("Category", "direction")) == [("baseline_1", "neg"), ("baseline_1", "pos")]


def test_results_guards(spark, tmp_path):
    root = tree(tmp_path / "r")
    with pytest.raises(FileNotFoundError, match="k9"):
        res.read_results(spark, root, traits=["t1"], annot2factor={**A2F, "k9": "d9"})
    partial = res.read_results(spark, root, traits=["t1"], annot2factor={**A2F, "k9": "d9"}, strict=False)
    assert partial.count() == 2
    with pytest.raises(ValueError, match="row 7"):
        res.read_results(spark, root, traits=["t1"], annot2factor=A2F, row=7)
    with pytest.raises(FileNotFoundError):
        res.read_results(spark, root, traits=["nope"], annot2factor=A2F)
    with pytest.raises(ValueError, match="no traits"):
        res.read_results(spark, root, traits=[], annot2factor=A2F)
    assert [r["annot"] for r in res.results_files(spark, f"{root}/t1").collect()] == ["k1", "k2"]
    with pytest.raises(FileNotFoundError):
        res.results_files(spark, f"{root}/zz").collect()


def test_results_with_other_columns_per_file(spark, tmp_path):
    root = tmp_path / "r"
    tree(root, traits=("t1",))
    (root / "t1" / "k2.results").write_text(f"{Z}\tExtra\n2.0\t7\n")
    got = {r["annot"]: r for r in res.read_results(spark, str(root), traits=["t1"], annot2factor=A2F).collect()}
    assert got["k2"]["Extra"] == 7.0 and got["k2"]["Coefficient"] is None and got["k1"]["Extra"] is None


def test_snp_rows_keep_file_order_over_many_splits(spark, tmp_path):
    n = 20000
    lines = [f"{i % 22 + 1}\trs{(i * 7919) % n} 0.0\t {i + 1}\tA\tC" for i in range(n)]
    path = tmp_path / "x.bim"
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = snps.read_snp_table(spark, str(path)).orderBy("row_ix").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["row_ix"] for r in got] == list(range(n))
    assert [r["snp"] for r in got] == [f"rs{(i * 7919) % n}" for i in range(n)]
    assert got[3]["bp"] == 4 and got[3]["chrom"] == "4" and got[3]["cm"] == 0.0
    empty = tmp_path / "e.bim"
    empty.write_text("")
    with pytest.raises(ValueError, match="no variants"):
        snps.read_snp_table(spark, str(empty))


def test_thin_annotation_files_hold_rows_in_order(spark, tmp_path):
    data = [("k1", "1", i, float((i * 37) % 101)) for i in range(500)] + [("k1", "2", i, 1.0) for i in range(500, 510)]
    df = spark.createDataFrame(data, "annot string, chrom string, row_ix long, value double").repartition(7)
    out = tmp_path / "annot"
    snps.write_thin_annotation(df, str(out))
    got = []
    for part in sorted((out / "annot=k1" / "chrom=1").glob("*.csv.gz")):
        text = gzip.open(part, "rt").read().splitlines()
        assert text[0] == "value"
        got += [float(v) for v in text[1:]]
    assert got == [float((i * 37) % 101) for i in range(500)]
    assert snps.read_thin_annotation(spark, str(out)).where("chrom = '2'").count() == 10
    work = spark.createDataFrame([("k1", "1"), ("k1", "3")], "annot string, chrom string")
    assert rows(manifest.pending_work(work, str(out), ["annot", "chrom"])) == [("k1", "3")]
    assert manifest.pending_work(work, str(tmp_path / "none"), ["annot", "chrom"]).count() == 2


def test_thin_values_are_written_in_the_order_of_points(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snps, "SORTED_ROWS", 300)
    points = spark.createDataFrame([(i, "1", i + 1) for i in range(500)], "row_ix long, chrom string, bp long").repartition(7)
    peaks = spark.createDataFrame([(f"p{k}", "chr1", k * 50, k * 50 + 25) for k in range(10)], "peak string, chrom string, start long, end long")
    loads = [(f"p{k}", a, k + v) for k in range(9) for a, v in (("k1", 0.25), ("k2", 0.5)) if (k, a) != (3, "k1")]
    loads = spark.createDataFrame(loads, "peak string, annot string, loading double")
    values, names = snps.thin_values(points, peaks, loads)
    out = tmp_path / "wide"
    snps.write_thin_annotation(values, str(out), names=names)
    for a, v in (("k1", 0.25), ("k2", 0.5)):
        files = sorted((out / f"annot={a}" / "chrom=1").glob("*.csv.gz"))
        got = [float(t) for f in files for t in gzip.open(f, "rt").read().splitlines()[1:]]
        held = [(i // 50) for i in range(500)]
        want = [k + v if i % 50 < 25 and k < 9 and (k, a) != (3, "k1") else 0.0 for i, k in enumerate(held)]
        assert len(files) > 1 and got == want
    long = snps.thin_annotation(points, peaks, loads.withColumn("annot", F.expr("int(substring(annot, 2))")))
    assert dict(long.dtypes)["annot"] == "int" and long.where("annot = 2 AND value > 0").count() == 225


def test_rows_of_one_partition_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 4000, 1, 4).select(F.lit("a").alias("k"), "id")
    manifest.write_work(df, df.select("k"), str(tmp_path / "o"), ["k"])
    assert len(list((tmp_path / "o" / "k=a").glob("*.parquet"))) == 4


def test_only_committed_partitions_are_finished(spark, tmp_path):
    keys, out = ["annot", "chrom"], tmp_path / "store"
    data = [("k/1", 1, 1.0), ("k/1", 1, 2.0), ("k/1", 2, 3.0), (None, 2, 4.0), ("k 3", 1, 5.0)]
    df = spark.createDataFrame(data, "annot string, chrom int, v double")
    work = spark.createDataFrame([("k/1", 1), ("k/1", 2), (None, 2), ("k 3", 1), ("none", 9)], "annot string, chrom int")

    def pending(**options):
        return set(map(tuple, manifest.pending_work(work, str(out), keys, **options).collect()))

    # A run that was lost while it wrote: part of one partition is there, nothing is committed.
    df.where("v = 1").write.partitionBy(*keys).parquet(str(out))
    assert len(pending()) == 5 and len(pending(committed=False)) == 4
    # Two partitions are finished, one of them empty; rows outside the work list are not written.
    first = work.where("annot = 'none' OR (annot = 'k/1' AND chrom = 1)")
    manifest.write_work(df, first, str(out), keys)
    assert pending() == {("k/1", 2), (None, 2), ("k 3", 1)}
    assert spark.read.parquet(str(out)).count() == 2
    manifest.write_work(df, manifest.pending_work(work, str(out), keys), str(out), keys)
    assert pending() == set() and spark.read.parquet(str(out)).count() == 5
    manifest.write_work(df, work.limit(0), str(out), keys)
    assert pending() == set()
    # A file that went away, or one more that nobody committed, opens its partition again.
    df.where("annot = 'k 3'").write.mode("append").partitionBy(*keys).parquet(str(out))
    next((out / "annot=__HIVE_DEFAULT_PARTITION__" / "chrom=2").glob("*.parquet")).unlink()
    assert pending() == {(None, 2), ("k 3", 1)}
    with pytest.raises(RuntimeError, match="nothing is committed"):
        manifest.write_work(df.where("annot <> 'k 3'"), work.where("annot = 'k 3'"), str(out), keys)
    with pytest.raises(KeyError, match="zz"):
        manifest.write_work(df, work, str(out), ["zz"])


def test_cell_scores_file(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("barcode\tcs\nc1\t1.5\nc2\tNaN\nc3\t\n")
    got = scs.read_cell_scores(spark, str(path), model="m", trait="t")
    assert got.null == 1.0 and got.n_unscored() == 2
    assert rows(got.frame) == [("c1", 1.5), ("c2", None), ("c3", None)]
    with pytest.raises(KeyError, match="zz"):
        scs.read_cell_scores(spark, str(path), model="m", trait="t", column="zz")
    with pytest.raises(FileNotFoundError):
        scs.read_cell_scores(spark, str(tmp_path / "no.tsv"), model="m", trait="t")


def test_arm_store_replaces_one_arm_only(spark, tmp_path):
    fmap = spark.createDataFrame([("d0", True, 1)], "factor string, kept boolean, annot_index int")
    one = spark.createDataFrame([("d0", 1.0)], "factor string, q double")
    store = str(tmp_path / "arms")
    res.write_arm(one, fmap, store, "a")
    res.write_arm(one, fmap, store, "b")
    res.write_arm(one.withColumn("q", F.lit(9.0)), fmap, store, "a")
    assert res.read_arm(spark, store, "a")["results"].first()["q"] == 9.0
    assert res.read_arm(spark, store, "b")["results"].first()["q"] == 1.0
    assert res.read_arm(spark, store, "b")["factor_selection"].columns == ["factor", "kept"]


def test_wide_scores_need_the_motif_column_last(spark):
    wide = spark.createDataFrame([(1.0, 2.0, "m1")], "`chr1:0-5` float, r2 float, motifs string")
    assert rows(scs.wide_to_long(wide, ["chr1:0-5", "r2"])) == [("chr1:0-5", "m1", 1.0), ("r2", "m1", 2.0)]
    with pytest.raises(ValueError, match="last column"):
        scs.wide_to_long(wide.select("motifs", "r2"), ["r2"])


def test_fasta_lines_become_chunks(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">chr1 first\nACGTA\nCGTAC\nGG\n>chr2\nNNNGC\n\n>empty\n>chr3\nTT\n")
    chunks = sequences.read_fasta(spark, str(path), 4)
    got = {}
    for r in chunks.orderBy("chrom", "chunk_ix").collect():
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
        assert len(r["seq"]) <= 4
    assert got == {"chr1": "ACGTACGTACGG", "chr2": "NNNGC", "chr3": "TT"}
    regions = spark.createDataFrame([("a", "chr1", 3, 12), ("b", "chr2", 0, 5)], "region string, chrom string, start long, end long")
    gc = {r["region"]: r["gc"] for r in gc_content(regions, chunks, size=4).collect()}
    assert close(gc["a"], 0.556) and gc["b"] == 1.0


def test_sparse_count_filters(spark):
    counts = spark.createDataFrame([(1, "a", 5.0), (1, "b", 1.0), (2, "a", 2.0), (3, "b", 0.0)], "cell int, feature string, n double")
    assert rows(qc.cells_passing({"x": (counts, 2.0)})) == [(1, 6.0), (2, 2.0)]
    assert rows(qc.features_in_cells(counts, 2)) == [("a", 2, 7.0)]
    top = qc.top_features(counts, 1)
    assert rows(top) == [("a", 7.0)] and qc.keep_features(counts, top).count() == 2

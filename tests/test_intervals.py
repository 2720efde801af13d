import random

import pytest
from pyspark.sql import functions as F

from factorloom.functions import bare_chrom, chrom_sort_key, interval_name, is_primary_interval, parse_interval
from factorloom.operators import intervals, risk
from factorloom.operators.ordered import positions
from factorloom.sources.snps import thin_annotation
from tests.conftest import close, rows


def peaks(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "peak string")
    chrom, start, end = parse_interval("peak")
    return df.select("peak", chrom.alias("chrom"), start.alias("start"), end.alias("end"))


def points(spark, chrom, bps):
    return spark.createDataFrame([(i, chrom, b) for i, b in enumerate(bps)], "row_ix long, chrom string, bp long")


def assigned(*args, **kw):
    return [r["peak"] for r in intervals.assign_points(*args, **kw).orderBy("row_ix").collect()]


def test_edges_are_one_based_points_in_zero_based_intervals(spark):
    got = assigned(points(spark, "1", [99, 100, 101, 150, 200, 201]), peaks(spark, ["chr1:100-200"]))
    assert [g is not None for g in got] == [False, False, True, True, True, False]
    got = assigned(points(spark, "1", [200, 201]), peaks(spark, ["chr1:100-200", "chr1:200-300"]))
    assert got == ["chr1:100-200", "chr1:200-300"]


@pytest.mark.parametrize(
    ("names", "pair"),
    [
        (["chr1:100-300", "chr1:200-400"], "chr1:100-300 and chr1:200-400"),
        (["chr1:100-1000", "chr1:200-300", "chr1:400-500"], "chr1:100-1000 and"),
        (["chr1:100-200", "chr5:100-300", "chr5:200-400"], "chr5:100-300 and chr5:200-400"),
    ],
)
def test_overlapping_intervals_raise_wherever_the_points_are(spark, names, pair):
    with pytest.raises(ValueError, match=f"must not overlap: {pair}"):
        assigned(points(spark, "1", [150]), peaks(spark, names))


def test_zero_length_and_absent_chromosomes(spark):
    assert assigned(points(spark, "1", [100, 150]), peaks(spark, ["chr1:100-100", "chr1:120-200"])) == [None, "chr1:120-200"]
    assert assigned(points(spark, "1", [150]), peaks(spark, ["chr1:100-200", "chr1:150-150"])) == ["chr1:100-200"]
    assert assigned(points(spark, "2", [150, 250]), peaks(spark, ["chr1:100-200"])) == [None, None]
    assert assigned(points(spark, "1", [150]), peaks(spark, ["chr1:100-100"])) == [None]


def test_coordinates_may_differ_from_names_and_be_missing(spark):
    lifted = spark.createDataFrame(
        [("chr1:100-200", "chr1", 1000, 1100), ("chr1:300-400", "chr1", None, None)], "peak string, chrom string, start long, end long"
    )
    assert assigned(points(spark, "CHR1", [150, 1050, 350]), lifted) == [None, "chr1:100-200", None]


def test_guards_name_columns(spark):
    with pytest.raises(KeyError, match="bp"):
        intervals.assign_points(points(spark, "1", [1]).drop("bp"), peaks(spark, ["chr1:1-2"]))
    with pytest.raises(ValueError, match="at least one interval"):
        intervals.assign_points(points(spark, "1", [1]), peaks(spark, ["chr1:1-2"]).limit(0))


def test_hot_bin_and_mixed_lengths_match_brute_force(spark):
    rng = random.Random(5)
    left = [(f"a{i}", "c", s, s + rng.choice([1, 40, 700, 5000, 300000])) for i, s in enumerate(rng.choices(range(100000), k=150))]
    left += [(f"h{i}", "c", 50000, 50100) for i in range(100)]
    right = [(f"b{i}", "c", s, s + rng.choice([3, 600, 9000, 80000])) for i, s in enumerate(rng.choices(range(120000), k=150))]
    schema = "n string, chrom string, start long, end long"
    got = intervals.overlap_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    got = sorted((r["n"], r["n_2"], r["overlap"]) for r in got.collect())
    want = sorted((a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[2] < b[3] and b[2] < a[3])
    assert got == want


def test_region_map_rule_is_strict_and_either_sided(spark):
    features = peaks(spark, ["chr1:0-100", "chr1:200-1200"])
    regions = spark.createDataFrame([("r1", "chr1", 60, 160), ("r2", "chr1", 1100, 1150), ("r3", "chr1", 1000, 5000)], "region string, chrom string, start long, end long")
    # r1 shares exactly 0.4 of both, r2 lies inside the second, r3 shares 0.2 and 0.05.
    assert rows(intervals.region_map(features, regions).select("region", "peak")) == [("r2", "chr1:200-1200")]
    with pytest.raises(ValueError, match="no overlap"):
        intervals.region_map(features, regions.where("region = 'r3'"))
    with pytest.raises(ValueError, match="repeat"):
        intervals.region_map(features.union(features), regions)
    found = intervals.map_regions(features, regions)
    assert rows(found.pairs.select("region", "peak")) == [("r2", "chr1:200-1200")]
    with pytest.raises(ValueError, match="no overlap"):
        intervals.map_regions(features, regions.where("region = 'r3'"))
    with pytest.raises(ValueError, match="repeat"):
        intervals.map_regions(features.union(features), regions)
    assert found.coverage == {"regions_matched": 1, "regions": 3, "features_matched": 1, "features": 2}


def test_reference_restriction(spark):
    table = spark.createDataFrame([("rs1", 0.1), ("rs2", 0.2), ("rs3", 0.3)], "snp string, l2 double")
    ref = spark.createDataFrame([("rs3", 0), ("rs1", 1)], "snp string, ref_ix int")
    assert [r["snp"] for r in intervals.restrict_to_reference(table, ref).orderBy("ref_ix").collect()] == ["rs3", "rs1"]
    with pytest.raises(ValueError, match="rs99"):
        intervals.restrict_to_reference(table, ref.union(spark.createDataFrame([("rs99", 2)], ref.schema)))
    with pytest.raises(KeyError, match="id"):
        intervals.restrict_to_reference(table, ref, key="id")


def test_name_functions(spark):
    df = spark.createDataFrame([("chr10",), ("chrX",), ("2",), ("Chr1",), ("scaffold_3",)], "c string")
    got = [r["c"] for r in positions(df, chrom_sort_key("c")).orderBy("pos").collect()]
    assert got == ["Chr1", "2", "chr10", "chrX", "scaffold_3"]
    assert [r[0] for r in df.select(bare_chrom("c")).collect()][:2] == ["10", "X"]
    one = peaks(spark, ["chr1:5-9"])
    assert one.select(interval_name("chrom", "start", "end")).first()[0] == "chr1:5-9"
    names = spark.createDataFrame([("chr22:1-2",), ("chr23:1-2",), ("chrUn:1-2",), ("chrX:1-2x",)], "n string")
    assert [r[0] for r in names.select(is_primary_interval("n")).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("chr1:a-9",)], "peak string").select(parse_interval("peak")[1]).collect()


@pytest.fixture(scope="module")
def risky(spark):
    loads = spark.createDataFrame(
        [("chr1:0-100", "d0", "pos", 2.0), ("chr1:0-100", "d1", "pos", 0.0), ("chr2:0-50", "d0", "neg", 3.0), ("chr2:0-50", "d1", "pos", 1.0)],
        "peak string, factor string, direction string, loading double",
    )
    fits = spark.createDataFrame([("d0", "pos", 0.5), ("d1", "pos", -1.0), ("d0", "neg", 2.0)], "factor string, direction string, Coefficient double")
    snps = spark.createDataFrame([(0, "1", 5), (1, "1", 100), (2, "2", 51)], "row_ix long, chrom string, bp long")
    return loads, fits, intervals.interval_counts(snps, peaks(spark, ["chr1:0-100", "chr2:0-50"]))


def test_counts_include_zero(risky):
    assert rows(risky[2]) == [("chr1:0-100", 2), ("chr2:0-50", 0)]


def test_peak_risk_by_hand(risky):
    loads, fits, counts = risky
    got = {(r["peak"], r["factor"], r["direction"]): (r["risk_rate"], r["risk_total"]) for r in risk.peak_risk(loads, fits, counts).collect()}
    assert got == {("chr1:0-100", "d0", "pos"): (1.0, 2.0), ("chr2:0-50", "d0", "neg"): (6.0, 0.0), ("chr2:0-50", "d1", "pos"): (-1.0, -0.0)}
    assert risk.peak_risk(loads, fits, include_zero=True).count() == 4
    assert "risk_total" not in risk.peak_risk(loads, fits).columns


def test_peak_risk_guards(spark, risky):
    loads, fits, _ = risky
    with pytest.raises(KeyError, match="d1"):
        risk.peak_risk(loads, fits.where("factor = 'd0'"))
    with pytest.raises(ValueError, match="more than one fit"):
        risk.peak_risk(loads, fits.union(fits))
    with pytest.raises(ValueError, match="no non-zero"):
        risk.peak_risk(loads.where("loading = 0"), fits)
    with pytest.raises(KeyError, match="risk_total"):
        risk.top_risk(risk.peak_risk(loads, fits))


def test_track_offsets_follow_chromosome_order(risky):
    loads, fits, counts = risky
    table = risk.peak_risk(loads, fits, counts)
    got = {r["peak"]: (r["factor"], r["x"], r["y"]) for r in risk.risk_track(table, value="risk_rate").collect()}
    assert got == {"chr1:0-100": ("d0", 0, 1.0), "chr2:0-50": ("d0", 101, 6.0)}
    assert [(r["chrom"], r["tick"]) for r in risk.track_ticks(risk.risk_track(table, value="risk_rate")).orderBy("chrom").collect()] == [("chr1", 0.0), ("chr2", 101.0)]
    assert risk.risk_track(table, value="risk_rate", factors=["d1"]).count() == 1
    with pytest.raises(KeyError, match="zz"):
        risk.risk_track(table, factors=["zz"])
    assert [r["peak"] for r in risk.top_risk(table, 1, by="risk_rate").collect()] == ["chr2:0-50"]
    assert risk.top_risk_per_group(table, 1, by="risk_rate").count() == 3


def test_sides_of_a_pair_join_are_not_broadcast(spark):
    side = spark.createDataFrame([("a", "1", 0, 10), ("b", "1", 5, 90)], "n string, chrom string, start long, end long")
    pairs = intervals.overlap_pairs(side, side)
    assert pairs.count() == 4
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_thin_annotation_fills_zero_in_order(spark):
    snps = points(spark, "1", [50, 150, 250])
    loads = spark.createDataFrame([("chr1:100-200", "k1", 0.7), ("chr1:200-300", "k2", 0.2)], "peak string, annot string, loading double")
    got = thin_annotation(snps, peaks(spark, ["chr1:100-200", "chr1:200-300"]), loads)
    values = {(r["annot"], r["row_ix"]): r["value"] for r in got.collect()}
    assert values == {("k1", 0): 0.0, ("k1", 1): 0.7, ("k1", 2): 0.0, ("k2", 0): 0.0, ("k2", 1): 0.0, ("k2", 2): 0.2}
    assert close(got.agg(F.sum("value")).first()[0], 0.9)

import math
import random

import pytest
from pyspark.sql import functions as F

from factorloom.functions import p_one_tailed, significance_class, significant
from factorloom.functions.columns import significance_labels
from factorloom.operators import testing
from tests.conftest import NAN, close


def r_adjust(p, n=None):
    """Largest to smallest, min so far: an independent form of the correction."""
    finite = sorted([(v, i) for i, v in enumerate(p) if not math.isnan(v)], reverse=True)
    m = len(finite)
    q, best = [1.0] * len(p), math.inf
    for k, (v, i) in enumerate(finite):
        best = min(best, v * (n or m) / (m - k))
        q[i] = min(1.0, best)
    return q


def frame(spark, p):
    return spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i long, p double")


@pytest.mark.parametrize("case", ["uniform", "ties", "edges", "nan", "one"])
def test_bh_matches_the_step_up_form(spark, case):
    rng = random.Random(case)
    p = {
        "uniform": [rng.random() for _ in range(200)],
        "ties": [rng.choice([0.01, 0.01, 0.2, 0.5]) for _ in range(150)],
        "edges": [0.0, 1.0, 0.0, 0.3],
        "nan": [0.01, NAN, 0.02, NAN, 0.5],
        "one": [0.04],
    }[case]
    got = {r["i"]: r["q"] for r in testing.bh_qvalues(frame(spark, p), "p", out="q").collect()}
    for i, q in enumerate(r_adjust(p)):
        assert close(got[i], q)


def test_explicit_number_of_tests(spark):
    p = [0.01, 0.02, 0.5]
    got = testing.bh_qvalues(frame(spark, p), "p", n=10, out="q").orderBy("i").collect()
    assert all(close(r["q"], q) for r, q in zip(got, r_adjust(p, 10), strict=True))
    with pytest.raises(ValueError, match="smaller"):
        testing.bh_qvalues(frame(spark, p), "p", n=2)


def test_families_are_corrected_apart_and_null_is_one(spark):
    data = [("a", 3.0), ("a", 1.0), (None, 2.0), (None, -1.0), (None, NAN)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, fam string, z double")
    got = {r["i"]: r for r in testing.add_fdr(df, by="fam", z_col="z").collect()}
    p = [got[i]["p_1tailed"] for i in range(4)]
    assert [got[i]["fdr_q"] for i in (0, 1)] == pytest.approx(r_adjust(p[:2]))
    assert [got[i]["fdr_q"] for i in (2, 3)] == pytest.approx(r_adjust(p[2:]))
    assert got[4]["p_1tailed"] is None and got[4]["fdr_q"] == 1.0


def test_missing_columns_are_named(spark):
    df = frame(spark, [0.1])
    with pytest.raises(KeyError, match="Coefficient_z-score"):
        testing.add_fdr(df)
    with pytest.raises(KeyError, match="trait"):
        testing.add_fdr(df, by="trait", z_col="p")


def test_p_one_tailed_known_values_and_tails(spark):
    df = spark.createDataFrame([(0.0,), (1.6448536269514722,), (10.0,), (float("inf"),), (NAN,), (None,)], "z double")
    up = [r[0] for r in df.select(p_one_tailed("z")).collect()]
    low = [r[0] for r in df.select(p_one_tailed("z", "lower")).collect()]
    assert close(up[0], 0.5) and close(up[1], 0.05) and up[3] == 0.0
    assert up[2] == pytest.approx(7.619853024160527e-24, rel=1e-9)
    assert close(low[1], 0.95) and up[4] is None and up[5] is None
    with pytest.raises(ValueError, match="tail"):
        p_one_tailed("z", "both")


def test_legacy_is_not_monotone_and_compare_reports_flips(spark):
    p = [0.02, 0.021, 0.9, 0.04]
    df = testing.compare_bh(frame(spark, p), "p", order=["i"]).orderBy("i")
    got = df.collect()
    ranks = [1, 2, 4, 3]
    for r, v, k in zip(got, p, ranks, strict=True):
        assert close(r["q_legacy"], min(1.0, v * 4 / k))
        assert r["q_correct"] <= r["q_legacy"] + 1e-12
        assert r["flips_at_05"] == ((r["q_correct"] < 0.05) != (r["q_legacy"] < 0.05))


def test_boundary_follows_the_tail(spark):
    df = spark.createDataFrame([(0.01, 3.0), (0.04, 2.0), (0.2, 1.0), (NAN, 9.0)], "fdr_q double, z double")
    assert testing.bh_boundary(df, z="z").first()[0] == 2.0
    assert testing.bh_boundary(df, z="z", tail="lower").first()[0] == 3.0
    assert testing.bh_boundary(df, z="z", alpha=1e-9).first()[0] is None


def test_significance(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.1,), (NAN,), (None,)], "q double")
    got = [tuple(r) for r in df.select(significant("q"), significance_class("q")).collect()]
    assert got == [(True, 0), (False, 1), (False, 2), (False, 2), (False, 2)]
    with pytest.raises(ValueError, match="ascending"):
        significance_class("q", (0.1, 0.05))
    assert significance_labels() == ["BH q < 0.05", "BH q < 0.1", "BH q >= 0.1"]


def test_input_columns_survive(spark):
    df = frame(spark, [0.1, 0.2]).withColumn("note", F.lit("x"))
    assert testing.bh_qvalues(df, "p").columns == ["i", "p", "note", "fdr_q"]


def test_q_belongs_to_the_p_that_were_ranked(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, 0.01), (2, 0.02)], "id int, p double").write.parquet(path)
    got = testing.bh_qvalues(spark.read.parquet(path), "p")
    # Rows computed anew would hold other values than the ranks, as sums of doubles may.
    spark.createDataFrame([(1, 0.011), (2, 0.021)], "id int, p double").write.mode("overwrite").parquet(path)
    assert sorted((r["id"], r["fdr_q"]) for r in got.collect()) == [(1, 0.02), (2, 0.02)]

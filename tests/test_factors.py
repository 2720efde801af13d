import pytest

from factorloom.operators import factors as fac
from factorloom.operators import views
from tests.conftest import NAN, rows


@pytest.fixture(scope="module")
def latent(spark):
    return spark.createDataFrame([(0, [1.0, -2.0, 0.01]), (1, [-0.5, -3.0, -0.02])], "id int, x array<double>")


def test_split_keeps_order_and_names(latent):
    arms, names = fac.split_directions(latent, "x", ["a", "b", "c"])
    assert names == ["a_pos", "b_pos", "c_pos", "a_neg", "b_neg", "c_neg"]
    assert arms.orderBy("id").first()["x"] == [1.0, 0.0, 0.01, 0.0, 2.0, 0.0]
    assert fac.split_directions(latent, "x", ["a", "b", "c"], naming="signed")[1][3] == "a-"
    with pytest.raises(ValueError, match="naming"):
        fac.split_directions(latent, "x", ["a", "b", "c"], naming="x")
    with pytest.raises(ValueError, match="names"):
        fac.split_directions(latent, "x", ["a", "b"])


def test_selection_numbers_kept_factors(latent):
    stats = fac.factor_stats(latent, "x", ["a", "b", "c"], threshold=0.1)
    fmap = fac.select_factors(stats, ["a", "b", "c"])
    got = {r["factor"]: r for r in fmap.collect()}
    assert got["c"]["drop_reason"] == "vanished" and got["c"]["annot_index"] is None
    assert (got["a"]["annot_index"], got["b"]["annot_index"]) == (1, 2)
    assert got["b"]["negative_only"] and not got["a"]["negative_only"]
    assert fac.kept_factors(fmap) == ["a", "b"]
    kept, names = fac.kept_loadings(latent, "x", fmap)
    assert names == ["a", "b"] and kept.orderBy("id").first()["x"] == [1.0, -2.0]
    got = {r["factor"]: r["drop_reason"] for r in fac.select_factors(stats, ["a", "b", "c"], exclude=["a", "c"]).collect()}
    assert got == {"a": "exclude_dims", "b": "", "c": "vanished"}
    assert fac.select_factors(stats, ["a", "b", "c"], exclude_vanished=False).where("kept").count() == 3


def test_selection_guards(spark, latent):
    stats = fac.factor_stats(latent, "x", ["a", "b", "c"], threshold=0.1)
    with pytest.raises(ValueError, match="same factors"):
        fac.select_factors(stats, ["a", "b"])
    with pytest.raises(ValueError, match="unknown factors"):
        fac.select_factors(stats, ["a", "b", "c"], exclude=["zz"])
    with pytest.raises(ValueError, match="every factor"):
        fac.select_factors(stats, ["a", "b", "c"], exclude=["a", "b"])
    text = spark.createDataFrame([("a", "True"), ("b", " false "), ("c", "1")], "factor string, vanished string")
    assert fac.kept_factors(fac.select_factors(text, ["a", "b", "c"])) == ["b"]
    odd = spark.createDataFrame([("a", "yes"), ("b", "0")], "factor string, vanished string")
    with pytest.raises(ValueError, match="yes"):
        fac.select_factors(odd, ["a", "b"])


def test_legacy_factor_column(spark):
    df = spark.createDataFrame([("a", 1)], "dim string, v int")
    with pytest.warns(DeprecationWarning):
        assert fac.with_factor_column(df).columns == ["factor", "v"]


def test_directional_table_and_limits(spark):
    factors = spark.createDataFrame([("a", "DR 1", 1.0, -3.0, 0.5), ("b", "DR 2", 0.0, 0.2, 2.0)], "factor string, title string, `order` double, min double, max double")
    arms = fac.factor_limits(fac.directional_factor_table(factors), thresholds=(-1.0, 1.0))
    got = [(r["arm"], r["title"], r["vmin"], r["vmax"]) for r in arms.orderBy("order").collect()]
    assert got == [("b-", "DR 2-", 0.0, 1.0), ("b+", "DR 2+", 0.0, 2.0), ("a-", "DR 1-", 0.0, 3.0), ("a+", "DR 1+", 0.0, 1.0)]
    signed = {r["factor"]: (r["vmin"], r["vmax"]) for r in fac.factor_limits(factors, directional=False).collect()}
    assert signed == {"a": (-3.0, 1.0), "b": (-1.0, 2.0)}
    plain = {r["factor"]: (r["vmin"], r["vmax"]) for r in fac.factor_limits(factors, directional=False, thresholds=None).collect()}
    assert plain["b"] == (0.2, 2.0)


def test_specificity_order_by_name_or_title(spark):
    factors = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B"), ("c", 2, "C")], "factor string, pos int, title string")
    by_name = spark.createDataFrame([("a", NAN), ("b", 0.1), ("c", 0.9)], "factor string, specificity double")
    assert [r["factor"] for r in fac.order_by_specificity(factors, by_name).collect()] == ["c", "b", "a"]
    by_title = spark.createDataFrame([("A", 0.5), ("B", 0.5), ("C", 0.9)], "factor string, specificity double")
    assert [r["factor"] for r in fac.order_by_specificity(factors, by_title).collect()] == ["c", "a", "b"]
    with pytest.raises(KeyError, match="c"):
        fac.order_by_specificity(factors, by_name.where("factor <> 'c'"))


def test_peak_row_and_subset(latent):
    got = rows(fac.order_by_peak_row(latent, "x", ["a", "b", "c"], "id"), "factor", "id")
    assert [(r[0], r[1]) for r in got] == [("a", 0), ("b", 1), ("c", 1)]
    long = fac.loadings_long(latent, "x", ["a", "b", "c"], ["id"])
    assert fac.keep_subset(long, "factor", ["b"]).count() == 2
    with pytest.raises(KeyError, match="zz"):
        fac.keep_subset(long, "factor", ["b", "zz"])


def test_concordance_keeps_directions_apart(spark):
    z = "Coefficient_z-score"
    data = [("t1", "f", "pos", 1.0), ("t1", "f", "neg", 5.0), ("t2", "f", "pos", 2.0), ("t2", "f", "neg", 6.0), ("t1", "g", "pos", 3.0)]
    df = spark.createDataFrame(data, f"trait string, factor string, direction string, `{z}` double")
    got = rows(views.trait_concordance(df, traits=["t1", "t2"], titles={"f": "DR 1"}).select("label", "delta"))
    assert got == [("DR 1+", 1.0), ("DR 1-", 1.0)]
    # A constant difference has no spread: five bins around it.
    summary = views.concordance_summary(views.trait_concordance(df, traits=["t1", "t2"])).first()
    assert summary["bins"] == 5 and summary["low"] < 1.0 < summary["high"]
    hist = views.concordance_histogram(views.trait_concordance(df, traits=["t1", "t2"]))
    assert hist.count() == 5 and hist.groupBy().sum("n").first()[0] == 2
    with pytest.raises(ValueError, match="two traits"):
        views.trait_concordance(df, traits=["t1"])
    with pytest.raises(KeyError, match="t9"):
        views.trait_concordance(df, traits=["t1", "t9"])

"""Order-sensitive primitives against plain Python on skewed data."""

import random

import numpy as np
import pytest

from factorloom.operators import boxes, groups, sketches
from factorloom.operators import ordered as o
from tests.conftest import NAN, close


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them, NULL keys and NaN values."""
    rng = random.Random(1)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        value = 0.0 if rng.random() < 0.35 else rng.gauss(0, 10)
        data.append((i, key, NAN if i % 50 == 0 else value))
    df = spark.createDataFrame(data, "id long, k string, v double").cache()
    return data, df


def by_key(data):
    groups = {}
    for i, k, v in data:
        groups.setdefault(k, []).append((i, v))
    return groups


def test_quantiles_match_numpy_for_every_group(skewed):
    data, df = skewed
    got = {r["k"]: r for r in o.quantiles(df, "v", {"lo": 0.0, "q": 0.37, "m": 0.5, "hi": 1.0}, ["k"]).collect()}
    groups = by_key(data)
    assert set(got) == set(groups)
    for k, items in groups.items():
        v = np.array([x for _, x in items if not np.isnan(x)])
        assert got[k]["n"] == v.size
        for name, p in (("lo", 0), ("q", 37), ("m", 50), ("hi", 100)):
            assert close(got[k][name], np.percentile(v, p))


def test_quantiles_without_keys_and_of_one_value(spark, skewed):
    data, df = skewed
    v = np.array([x for *_, x in data if not np.isnan(x)])
    assert close(o.quantiles(df, "v", {"m": 0.9}).first()["m"], np.percentile(v, 90))
    one = spark.createDataFrame([(4.0,)], "v double")
    assert o.quantiles(one, "v", {"m": 0.3}).first()["m"] == 4.0
    none = spark.createDataFrame([(None,)], "v double")
    assert o.quantiles(none, "v", {"m": 0.3}).count() == 0


def test_quantile_search_narrows_in_rounds(monkeypatch, skewed):
    data, df = skewed
    monkeypatch.setattr(o, "SEARCH_SEGMENTS", 4)
    monkeypatch.setattr(o, "SORT_ROWS", 200)
    got = {r["k"]: r for r in o.quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.99}, ["k"]).collect()}
    for k, items in by_key(data).items():
        v = np.array([x for _, x in items if not np.isnan(x)])
        assert [got[k][c] for c in "amz"] == pytest.approx(list(np.percentile(v, [10, 50, 99])))
        assert got[k]["n"] == v.size


def test_quantile_blocks_of_groups_on_separate_ranges_fit(monkeypatch, spark):
    monkeypatch.setattr(o, "SORT_ROWS", 100)
    left = []
    narrowed = o._narrowed
    monkeypatch.setattr(o, "_narrowed", lambda *a: left.append(narrowed(*a)) or left[0])
    df = spark.range(30_000).selectExpr("id % 30 AS k", "CAST((id % 30) * 1000000 + id DIV 30 AS DOUBLE) AS v")
    got = {r["k"]: r for r in o.quantiles(df, "v", {"q": 0.25, "m": 0.5}, ["k"]).collect()}
    for k in range(30):
        v = k * 1_000_000 + np.arange(1000.0)
        assert [got[k]["q"], got[k]["m"]] == list(np.percentile(v, [25, 50]))
    assert left[0].groupBy(o.KEY, "_start").count().agg({"count": "max"}).first()[0] <= 100


def test_values_join_in_parts_like_whole(monkeypatch, spark, skewed):
    data, df = skewed
    whole = {(r["id"], r["rk"]) for r in o.average_ranks(df, "v", "rk", ["k"]).collect()}
    monkeypatch.setattr(o, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(o, "HEAVY_PARTS", 20)
    parts = o.average_ranks(df, "v", "rk", ["k"])
    assert parts.columns == ["id", "k", "v", "rk"]
    found = [(r["id"], r["rk"]) for r in parts.collect()]
    assert len(found) == len(data) and set(found) == whole


def test_average_ranks_share_ties(skewed):
    data, df = skewed
    got = {r["id"]: r["rk"] for r in o.average_ranks(df, "v", "rk", ["k"]).collect()}
    assert len(got) == len(data)
    for items in by_key(data).values():
        values = [v for _, v in items if not np.isnan(v)]
        for i, v in items:
            if np.isnan(v):
                assert got[i] is None
            else:
                below = sum(x < v for x in values)
                assert got[i] == below + (values.count(v) + 1) / 2


def test_positions_number_every_row_once(skewed):
    data, df = skewed
    clean = df.na.fill(0.0, ["v"])
    got = {r["id"]: r["pos"] for r in o.positions(clean, ["v", "id"], keys=["k"]).collect()}
    for items in by_key(data).values():
        order = sorted(((0.0 if np.isnan(v) else v), i) for i, v in items)
        assert [got[i] for _, i in order] == list(range(len(order)))


def test_running_carries_across_segments(skewed):
    data, df = skewed
    placed = o.keyed(o.by_order(df.na.fill(0.0, ["v"]), ["k", "id"]), ["k"])
    out = o.running(placed, [df.id], {"s": ("sum", "id"), "m": ("max", "v")}, before=True)
    got = {r["id"]: (r["s"], r["m"]) for r in out.collect()}
    for items in by_key(data).values():
        total, top = 0, None
        for i, v in sorted(items):
            assert got[i][0] == total
            assert got[i][1] == top or close(got[i][1], top)
            total += i
            v = 0.0 if np.isnan(v) else v
            top = v if top is None else max(top, v)


@pytest.mark.parametrize("ranked", [o.RANKED, 10])
def test_first_k_per_group(skewed, monkeypatch, ranked):
    monkeypatch.setattr(o, "RANKED", ranked)
    data, df = skewed
    got = o.first_k_per_group(df, ["k"], [df.id.desc()], 7, ["id"])
    found = {}
    for r in got.collect():
        found.setdefault(r["k"], []).append(r["id"])
    for k, items in by_key(data).items():
        assert sorted(found[k], reverse=True) == sorted((i for i, _ in items), reverse=True)[:7]


def test_sketches_keep_their_rank_error_and_merge(skewed):
    data, df = skewed
    points = {"low": 0.0, "mid": 0.5, "q90": 0.9, "high": 1.0}
    stored = sketches.value_sketches(df.withColumn("part", df.id % 5), "v", ["k", "part"], k=200)
    found = sketches.sketch_quantiles(sketches.merge_sketches(stored, ["k"], k=200), points)
    groups = by_key(data)
    got = {r["k"]: r for r in found.collect()}
    assert set(got) == set(groups)
    for k, items in groups.items():
        v = np.sort([x for _, x in items if not np.isnan(x)])
        assert got[k]["n"] == len(v) and got[k]["low"] == v[0] and got[k]["high"] == v[-1]
        slack = 2 * sketches.rank_error(200) * len(v)
        for name in ("mid", "q90"):
            below, upto = np.searchsorted(v, got[k][name], "left"), np.searchsorted(v, got[k][name], "right")
            assert below - slack <= points[name] * len(v) <= upto + slack
    assert sketches.approximate_quantiles(df.where("v is null"), "v", points).count() == 0


def test_summaries_boxes_and_limits_take_a_sketch(skewed):
    _, df = skewed
    exact = groups.summarize_by(df, "v", by="k", quantile_points=(90,)).frame
    close_by = groups.summarize_by(df, "v", by="k", quantile_points=(90,), sketch_k=4000).frame
    want, got = ({r["k"]: r for r in f.collect()} for f in (exact, close_by))
    assert exact.columns == close_by.columns and set(want) == set(got)
    assert all(got[k]["mean"] == pytest.approx(want[k]["mean"]) and abs(got[k]["q90"] - want[k]["q90"]) < 1.5 for k in want)
    box = {r["label"]: r for r in boxes.box_stats(df, "v", "k", whis="minmax", sketch_k=4000).collect()}
    plain = {r["label"]: r for r in boxes.box_stats(df, "v", "k", whis="minmax").collect()}
    assert all(box[k]["whislo"] == plain[k]["whislo"] and abs(box[k]["q3"] - plain[k]["q3"]) < 1.5 for k in plain)
    (a, b), (c, e) = boxes.robust_limits(df, "v", sketch_k=4000).first(), boxes.robust_limits(df, "v").first()
    assert abs(a - c) < 2 and abs(b - e) < 3 and a < b

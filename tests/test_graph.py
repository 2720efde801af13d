import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import graph as g
from factorloom.operators import sampling
from tests.conftest import NAN, rows


def nodes_of(spark, x, **columns):
    names = list(columns)
    data = [(i, x[i].tolist(), *[columns[c][i] for c in names]) for i in range(len(x))]
    kinds = {str: "string", float: "double", int: "int", type(None): "string"}
    extra = "".join(f", {c} {kinds[type(columns[c][0])]}" for c in names)
    return spark.createDataFrame(data, "id long, x array<double>" + extra)


def edges_of(spark, nb):
    data = [(i, int(j), k) for i, row in enumerate(nb) for k, j in enumerate(row)]
    return spark.createDataFrame(data, "src long, dst long, rank int")


def dense(nb, n):
    w = np.zeros((n, n))
    for i, row in enumerate(nb):
        for j in row:
            if i != j:
                w[i, j] += 1
    total = w.sum(1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)


@pytest.fixture(scope="module")
def world(spark):
    """Blobs of 30 cells; a blob factor, a factor coherent inside blobs, noise, a constant."""
    rng = np.random.default_rng(0)
    n, size = 240, 30
    blob = np.arange(n) // size
    place = rng.random(n)
    order = np.lexsort((place, blob))
    slot = np.empty(n, int)
    slot[order] = np.arange(n)
    nb = []
    for i in range(n):
        near = [order[s] for s in range(slot[i] - 4, slot[i] + 5) if 0 <= s < n and blob[order[s]] == blob[i]]
        near = sorted(near, key=lambda j: abs(slot[j] - slot[i]))
        nb.append((near + near)[:7])
    x = np.stack([(blob == 0).astype(float), place, rng.random(n), np.full(n, 2.0)], axis=1)
    group = [f"g{b}" for b in blob]
    cov = rng.normal(size=n)
    nodes = nodes_of(spark, x, group=group, cov=[float(c) for c in cov]).cache()
    return x, np.array(group), cov, nb, nodes, edges_of(spark, nb).cache()


NAMES = ["blob", "state", "noise", "flat"]


def by(df, column):
    return {r["factor"]: r[column] for r in df.collect()}


def test_neighbour_mean_counts_repeats_and_drops_self(spark):
    nodes = nodes_of(spark, np.array([[1.0], [3.0], [8.0]]))
    nb = edges_of(spark, [[0, 1, 1, 2], [1], [0]])
    out = {r["id"]: r["wx"] for r in g.neighbour_mean(nodes, g.neighbour_edges(nb, nodes)).collect()}
    assert out[0] == pytest.approx([14 / 3]) and out[1] is None and out[2] == [1.0]
    # The prefix is cut before the self edge goes.
    assert g.neighbour_edges(nb, nodes, k=2).where("src = 0").count() == 1
    with pytest.raises(ValueError, match="outside"):
        g.neighbour_edges(nb, nodes, k=9)
    bad = nb.withColumn("dst", F.col("dst") + 5)
    with pytest.raises(ValueError, match="unknown nodes"):
        g.neighbour_edges(bad, nodes)


def test_sparse_graph_edges_are_unweighted(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (0, 1, 0.5), (1, 0, 0.0)], "src long, dst long, w double")
    assert rows(g.graph_edges(pairs, weight="w")) == [(0, 1)]


def test_moran_participation_and_shares_match_dense_algebra(world):
    x, group, _, nb, nodes, nbrs = world
    edges = g.neighbour_edges(nbrs)
    w = dense(nb, len(x))
    c = x - x.mean(0)
    want = (c * (w @ c)).sum(0)[:3] / (c**2).sum(0)[:3]
    got = by(g.moran(nodes, edges, NAMES), "moran_i")
    assert [got[n] for n in NAMES[:3]] == pytest.approx(want) and got["flat"] is None
    e = np.maximum(w @ x - x.mean(0), 0)
    pr = by(g.participation(nodes, edges, NAMES), "pr")
    assert [pr[n] for n in NAMES[:3]] == pytest.approx(e.sum(0)[:3] ** 2 / (len(x) * (e**2).sum(0)[:3]))
    shares = {(r["factor"], r["label"]): r["share"] for r in g.footprint_shares(nodes, edges, NAMES, "group").collect()}
    assert shares[("noise", "g3")] == pytest.approx(e[group == "g3", 2].sum() / e[:, 2].sum())
    top = {r["factor"]: (r["top"], r["top_share"]) for r in g.footprint_top(g.footprint_shares(nodes, edges, NAMES, "group")).collect()}
    assert top["blob"] == ("g0", 1.0) and top["flat"] == (None, None)


def test_full_table_separates_identity_state_and_noise(world):
    x, group, cov, nb, nodes, nbrs = world
    table = g.graph_specificity(
        nodes, nbrs, NAMES, ks=[7, 3], group="group", annotate=["group"], covariate="cov", control="blob", n_perm=9
    ).collect()
    got = {(r["factor"], r["k"]): r for r in table}
    assert len(got) == 12
    blob, state, noise, control = (got[(n, 7)] for n in ("blob", "state", "noise", g.PERM_CONTROL))
    assert blob["specificity"] > 0.4 and blob["moran_p"] == 0.1 and blob["top_group"] == "g0"
    assert blob["moran_i_within_group"] is None and state["moran_i_within_group"] > 0.5
    assert abs(noise["moran_i"]) < 0.25 and abs(control["moran_i"]) < 0.25 and abs(control["specificity"]) < 0.35
    assert got[("flat", 7)]["moran_i"] is None and got[("flat", 7)]["covariate_spearman"] is None
    assert got[(g.COVARIATE, 7)]["covariate_spearman"] == pytest.approx(1.0)
    assert got[(g.COVARIATE, 7)]["moran_i_resid"] is None
    w = dense(nb, len(x))
    design = np.column_stack([np.ones(len(x)), cov])
    r = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    want = (r * (w @ r)).sum(0) / (r**2).sum(0)
    assert state["moran_i_resid"] == pytest.approx(want[1])
    rank = lambda v: np.argsort(np.argsort(v))
    assert state["covariate_spearman"] == pytest.approx(np.corrcoef(rank(x[:, 1]), rank(cov))[0, 1])
    again = g.graph_specificity(nodes, nbrs, NAMES, ks=[7], n_perm=9)
    assert by(again, "moran_p")["blob"] == 0.1
    assert by(again, "pr_null")["state"] == pytest.approx(state["pr_null"])


def test_graph_guards(spark, world):
    *_, nodes, nbrs = world
    edges = g.neighbour_edges(nbrs)
    with pytest.raises(ValueError, match="repeat"):
        g.graph_specificity(nodes, edges, ["a", "a", "b", "c"])
    with pytest.raises(ValueError, match="values"):
        g.graph_specificity(nodes, edges, ["a"])
    with pytest.raises(KeyError, match="zz"):
        g.graph_specificity(nodes, edges, NAMES, control="zz")
    with pytest.raises(ValueError, match="collide"):
        g.graph_specificity(nodes, edges, [g.COVARIATE, "a", "b", "c"], covariate="cov")
    with pytest.raises(ValueError, match="negative"):
        g.graph_specificity(nodes.withColumn("x", F.transform("x", lambda v: -v)), edges, NAMES)
    with pytest.raises(ValueError, match="finite"):
        g.graph_specificity(nodes.withColumn("x", F.transform("x", lambda v: v + NAN)), edges, NAMES)
    with pytest.raises(ValueError, match="without a group"):
        g.moran_within_groups(nodes.withColumn("group", F.nullif("group", F.lit("g1"))), edges, NAMES, "group")


def test_spn_by_hand_and_with_ties(spark):
    x = np.arange(6.0)[:, None]
    nodes = nodes_of(spark, x, lab=["on", "on", "off", "on", "off", "off"])
    assert {(r["label"], r["spn"]) for r in g.same_process_neighbours(nodes, "x", ["f"], "lab").collect()} == {("on", 0.0), ("off", 0.0)}
    runs = nodes_of(spark, x, lab=["a", "a", "a", "b", "b", "b"])
    got = {r["label"]: r["spn"] for r in g.same_process_neighbours(runs, "x", ["f"], "lab").collect()}
    assert got["a"] == pytest.approx((2 / 3 - 0.5) / 0.5) and got["b"] == 1.0
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, size=(60, 2)).astype(float)
    lab = [None if i % 7 == 0 else f"l{i % 3}" for i in range(60)]
    lab[1], lab[2] = "solo", "l2"
    got = {(r["factor"], r["label"]): r["spn"] for r in g.same_process_neighbours(nodes_of(spark, x, lab=["l0" if v is None else v for v in lab]).withColumn("lab", F.when(F.col("id") % 7 != 0, F.col("lab"))), "x", ["a", "b"], "lab").collect()}
    for c, name in enumerate("ab"):
        order = [lab[i] for i in np.argsort(x[:, c], kind="stable")]
        for p in {v for v in lab if v}:
            f = lab.count(p) / 60
            first = [i for i in range(59) if order[i] == p]
            both = sum(order[i + 1] == p for i in first)
            want = None if lab.count(p) < 2 else max(0.0, (both / len(first) - f) / (1 - f))
            assert got[(name, p)] == (None if want is None else pytest.approx(want))
    best = g.spn_best(g.same_process_neighbours(runs, "x", ["f"], "lab")).first()
    assert (best["label"], best["spn"]) == ("b", 1.0)


def test_subsample_is_repeatable_and_keeps_rare_groups(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 5, "rare").otherwise("common").alias("g"))
    a = sampling.subsample(df, 100, row="id")
    assert rows(a) == rows(sampling.subsample(df, 100, row="id")) and a.count() == 100
    assert rows(a) != rows(sampling.subsample(df, 100, row="id", seed=1))
    parts = {r["g"]: r["count"] for r in sampling.subsample(df, 100, row="id", stratify="g").groupBy("g").count().collect()}
    assert parts == {"rare": 5, "common": 50}
    assert sampling.subsample(df, 5000, row="id") is df
    with pytest.raises(ValueError, match="positive"):
        sampling.subsample(df, 0, row="id")


def test_balanced_sample(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 20, "a").otherwise("b").alias("c"))
    got = sampling.balanced_sample(df, "c", row="id")
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"a": 20, "b": 20}
    assert got.select("id").distinct().count() == 40
    few = sampling.balanced_sample(df.where("id >= 17"), "c", row="id")
    assert {r["c"]: r["count"] for r in few.groupBy("c").count().collect()} == {"a": 10, "b": 10}


def test_balanced_sample_with_replacement_of_large_categories(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 40, "a").otherwise("b").alias("c"))
    got = sampling.balanced_sample(df, "c", row="id", min_count=5, replacement=True)
    assert sorted((r["c"], r["draw"]) for r in got.collect()) == [(c, i) for c in "ab" for i in range(5)]


def test_permutations_are_bijections(spark):
    got = sampling.permutations(spark.range(50), "id", [1, 2]).collect()
    for seed in (1, 2):
        pairs = [(r["id"], r["other"]) for r in got if r["seed"] == seed]
        assert sorted(a for a, _ in pairs) == sorted(b for _, b in pairs) == list(range(50))
        assert sum(a == b for a, b in pairs) < 10


def test_permutation_sums_do_not_depend_on_the_blocks(spark):
    rows = [(i, [float((i * 7) % 5), float(i % 3), 1.0]) for i in range(12)]
    nodes = spark.createDataFrame(rows, "id long, c array<double>")
    edges = spark.createDataFrame([(i, (i + s) % 12) for i in range(11) for s in (1, 3)], "src long, dst long")
    seeds = [11, 5, 8, 9, 30]
    perms = g.permutations(nodes, "id", seeds).cache()
    other = {(r["seed"], r["id"]): r["other"] for r in perms.collect()}
    values = dict(rows)
    want = {}
    for s in seeds:
        moved = {i: values[other[s, i]] for i in values}
        near = {i: [moved[(i + 1) % 12], moved[(i + 3) % 12]] for i in range(11)}
        for p in range(3):
            want[s, p] = sum(moved[i][p] * sum(v[p] for v in near[i]) / 2 for i in near)
    for block in (1, 2, 5, 8):
        got = {(r["seed"], r["pos"]): r["vw"] for r in g.permutation_sums(nodes, edges, "c", seeds, perms, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_array_goes_along_an_edge(spark):
    """what is sent for a permutation is edges, not the arrays of their ends."""
    n, width = 1000, 64
    rng = np.random.default_rng(3)
    nodes = nodes_of(spark, rng.random((n, width))).withColumnRenamed("x", "c").cache()
    edges = spark.createDataFrame([(i, (i * s + s) % n) for i in range(n) for s in range(1, 11)], "src long, dst long")
    seeds = list(range(10, 18))
    perms = sampling.permutations(nodes.select("id"), "id", seeds).cache()
    perms.count()
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = sum(e.totalShuffleWrite() for e in _executors(tracker))
    g.permutation_sums(nodes, edges, "c", seeds, perms).count()
    written = sum(e.totalShuffleWrite() for e in _executors(tracker)) - before
    # The arrays of 10 neighbours of 1,000 nodes under 8 permutations are 41 MB.
    assert written < 12e6, written


def _executors(tracker):
    found = tracker.executorList(False)
    return [found.apply(k) for k in range(found.size())]


@pytest.mark.parametrize("ranked", [100_000, 40, 1])
def test_first_by_hash_equals_a_full_ranking(spark, ranked):
    # One group holds most rows, one holds k of them, one fewer.
    group = F.when(F.col("id") < 30, "few").when(F.col("id") < 80, "even").otherwise("hot")
    df = spark.range(9000).select("id", group.alias("g"))
    got = sampling.first_by_hash(df, "g", "id", 7, 50, ranked=ranked)
    want = {}
    for r in df.withColumn("h", sampling.hash_order("id", 7)).collect():
        want.setdefault(r["g"], []).append((r["h"], r["id"]))
    assert rows(got) == sorted((i, g) for g, found in want.items() for _, i in sorted(found)[:50])

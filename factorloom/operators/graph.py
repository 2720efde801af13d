"""Specificity of factors to neighbourhoods of a cell graph.

Nodes carry all factor values in one array, so each neighbourhood mean costs one join and
one aggregation of edges whatever the number of factors. Columns that need the same graph
(centred values, a permuted copy, residuals) ride along in one longer array, and sums over nodes
are vector sums. The permutation null goes over renamed edges, in blocks of seeds, so a node never
holds all permutations and no array is sent along an edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.guards import finite, require_columns, require_none, require_unique
from factorloom.operators.factors import as_doubles, loadings_long
from factorloom.operators.ordered import SEG, average_ranks, by_order
from factorloom.operators.sampling import permutations
from factorloom.operators.scores import pearson
from factorloom.session import BROADCAST_ROWS, broadcast_if_small, materialize

PERM_CONTROL = "_perm_control"
COVARIATE = "_covariate"

#: Permutations that share one pass over the edges; an edge holds two nodes for each.
SEED_BLOCK = 64

#: Groups that the permuted nodes are dealt into at least, and bytes of arrays in a group.
PARTS = 8
NODE_BYTES = 64 << 20

#: Relative energy below which a centred column counts as constant.
_VANISHED = 1e-12


def neighbour_edges(
    neighbours: DataFrame,
    nodes: DataFrame | None = None,
    *,
    k: int | None = None,
    src: str = "src",
    dst: str = "dst",
    rank: str = "rank",
    node: str = "id",
) -> DataFrame:
    """Edges from neighbour lists: ranks below k, self edges dropped, repeats kept.

    The prefix is cut before self edges go, so a row may keep fewer than k. Edges to
    unknown nodes raise.
    """
    require_columns(neighbours, [src, dst, rank], "neighbours")
    if k is not None:
        widest = neighbours.agg(F.max(rank)).first()[0]
        if k < 1 or widest is None or k > widest + 1:
            raise ValueError(f"k={k} outside 1..{None if widest is None else widest + 1} neighbours")
        neighbours = neighbours.where(F.col(rank) < k)
    edges = neighbours.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return _known(edges, nodes, node).where("src <> dst")


def graph_edges(pairs: DataFrame, nodes: DataFrame | None = None, *, src: str = "src", dst: str = "dst",
                weight: str | None = None, node: str = "id") -> DataFrame:
    """Edges from a sparse graph: non-zero entries once, diagonal dropped."""
    require_columns(pairs, [src, dst], "graph")
    rows = pairs if weight is None else pairs.where(F.col(weight) != 0)
    edges = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    return _known(edges.distinct(), nodes, node)


def _known(edges: DataFrame, nodes: DataFrame | None, node: str) -> DataFrame:
    if nodes is not None:
        ids = nodes.select(F.col(node).alias("dst"))
        require_none(edges.join(ids, "dst", "left_anti"), "dst", "edges lead to unknown nodes")
        ids = nodes.select(F.col(node).alias("src"))
        require_none(edges.join(ids, "src", "left_anti"), "src", "edges start at unknown nodes")
    return edges


def neighbour_mean(nodes: DataFrame, edges: DataFrame, *, node: str = "id", x: str = "x", out: str = "wx") -> DataFrame:
    """Nodes with the mean of `x` over their neighbours; NULL for a node without edges.

    Vector sums are combined before the shuffle on the source node.
    """
    values = nodes.select(F.col(node).alias("dst"), array_to_vector(as_doubles(x)).alias("_v"))
    means = (
        edges.join(values, "dst")
        .groupBy("src")
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select(F.col("src").alias(node), vector_to_array("_m").alias(out))
    )
    return nodes.join(means, node, "left")


def _column_means(nodes: DataFrame, x: str) -> list[float]:
    """Mean of every array position (one number per factor is fetched)."""
    long = nodes.select(F.posexplode(as_doubles(x)).alias("pos", "v"))
    rows = long.groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()
    return [r["m"] for r in rows]


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _minus(x: Column | str, values: Sequence[float]) -> Column:
    return F.zip_with(as_doubles(x), _literal(values), lambda a, b: a - b)


def _products(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def _vector_sum(values: Column | str) -> Column:
    """Sum of arrays, position by position, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(values)))


def _sums(nodes: DataFrame, edges: DataFrame, v: str, rest: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """Arrays v, their neighbour means w and the excess e, one row per node.

    A node without edges has w = 0 and the excess of `rest` at that position.
    """
    joined = neighbour_mean(nodes.select("id", v, *keep), edges, x=v, out="_w")
    zeros = F.transform(v, lambda a: F.lit(0.0))
    excess = F.transform(F.coalesce("_w", _literal(rest)), lambda a: F.greatest(a, F.lit(0.0)))
    return joined.select(*keep, F.col(v).alias("v"), F.coalesce("_w", zeros).alias("w"), excess.alias("e"))


def _totals(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sums over the nodes of `_sums`, one row per position (and values of `keep`)."""
    sums = {
        "vw": _vector_sum(_products("v", "w")),
        "vv": _vector_sum(_products("v", "v")),
        "e1": _vector_sum("e"),
        "e2": _vector_sum(_products("e", "e")),
    }
    whole = rows.groupBy(*(keep or [F.lit(0).alias("_all")])).agg(
        *[s.alias(c) for c, s in sums.items()], F.count(F.lit(1)).alias("n")
    )
    long = whole.select(*keep, "n", F.posexplode(F.arrays_zip(*sums)).alias("pos", "_z"))
    return long.select(*keep, "pos", *[F.col(f"_z.{c}").alias(c) for c in sums], "n")


def _named(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    labels = F.array(*[F.lit(str(n)) for n in names])
    return stats.withColumn("factor", labels[F.col("pos")])


def moran(nodes: DataFrame, edges: DataFrame, names: Sequence[str], *, x: str = "x") -> DataFrame:
    """Moran's I of every factor: factor, pos, moran_i; NULL for a constant factor."""
    rest = [0.0] * len(names)
    centred = nodes.select("id", _minus(x, _column_means(nodes, x)).alias("_c"))
    stats = _totals(_sums(centred, edges, "_c", rest))
    return _named(stats, names).select(
        "factor", "pos", F.when(F.col("vv") > 0, F.try_divide("vw", "vv")).alias("moran_i")
    )


def participation(nodes: DataFrame, edges: DataFrame, names: Sequence[str], *, x: str = "x") -> DataFrame:
    """Effective share of nodes in each factor's footprint: factor, pos, pr."""
    means = _column_means(nodes, x)
    centred = nodes.select("id", _minus(x, means).alias("_c"))
    stats = _totals(_sums(centred, edges, "_c", [-m for m in means]))
    return _named(stats, names).select("factor", "pos", _pr().alias("pr"))


def _pr() -> Column:
    return F.try_divide(F.col("e1") * F.col("e1"), F.col("n") * F.col("e2"))


def footprint_shares(nodes: DataFrame, edges: DataFrame, names: Sequence[str], label: str, *, x: str = "x") -> DataFrame:
    """Share of each factor's footprint per label: factor, pos, label, share.

    Unlabelled mass has no row but stays in the denominator.
    """
    means = _column_means(nodes, x)
    centred = nodes.select("id", label, _minus(x, means).alias("_c"))
    rows = _totals(_sums(centred, edges, "_c", [-m for m in means], [label]), [label])
    return _shares(rows.select("pos", label, F.col("e1").alias("e")), label, names)


def _shares(rows: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    by_label = rows.groupBy("pos", label).agg(F.sum("e").alias("_e"))
    total = by_label.groupBy("pos").agg(F.sum("_e").alias("_t"))
    # One row per factor.
    share = F.when(F.col("_t") > 0, F.col("_e") / F.col("_t")).otherwise(F.col("_e"))
    shares = by_label.join(F.broadcast(total), "pos").where(F.col(label).isNotNull())
    return _named(shares, names).select("factor", "pos", F.col(label).alias("label"), share.alias("share"))


def footprint_top(shares: DataFrame) -> DataFrame:
    """Label with the largest share of each factor, first in order on ties; NULL if none."""
    best = F.min(F.struct((-F.col("share")).alias("s"), F.col("label").alias("l"))).alias("_b")
    top = shares.groupBy("factor", "pos").agg(best)
    some = F.col("_b.s") < 0
    return top.select("factor", "pos", F.when(some, F.col("_b.l")).alias("top"), F.when(some, -F.col("_b.s")).alias("top_share"))


def moran_within_groups(nodes: DataFrame, edges: DataFrame, names: Sequence[str], group: str, *, x: str = "x") -> DataFrame:
    """Moran's I over edges inside a group, values centred inside their group.

    Nodes without such an edge do not take part. NULL where nothing is left to vary.
    """
    require_none(nodes.where(F.col(group).isNull()), "id", "nodes without a group")
    label = nodes.select("id", F.col(group).alias("_g"))
    a = label.select(F.col("id").alias("src"), F.col("_g").alias("_gs"))
    b = label.select(F.col("id").alias("dst"), F.col("_g").alias("_gd"))
    same = edges.join(a, "src").join(b, "dst").where("_gs = _gd").select("src", "dst")
    same = materialize(same)
    linked = same.select(F.col("src").alias("id")).distinct().withColumn("_has", F.lit(True))
    means = nodes.groupBy(F.col(group).alias("_g")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(as_doubles(x)))).alias("_gm")
    )
    rows = nodes.select("id", F.col(group).alias("_g"), as_doubles(x).alias("_x"))
    rows = rows.join(broadcast_if_small(means, BROADCAST_ROWS // max(len(names), 1)), "_g").join(linked, "id", "left")
    inside = F.zip_with("_x", "_gm", lambda p, q: p - q)
    centred = F.when(F.col("_has"), inside).otherwise(F.transform("_x", lambda p: F.lit(0.0)))
    rows = rows.select("id", centred.alias("_c"))
    energy = nodes.select(F.posexplode(as_doubles(x)).alias("pos", "v")).groupBy("pos").agg(
        F.sum(F.col("v") * F.col("v")).alias("xx")
    )
    stats = _totals(_sums(rows, same, "_c", [0.0] * len(names)))
    # One row per factor.
    stats = stats.join(F.broadcast(energy), "pos")
    alive = F.col("vv") > _VANISHED * F.greatest(F.col("xx"), F.lit(1e-300))
    return _named(stats, names).select(
        "factor", "pos", F.when(alive, F.try_divide("vw", "vv")).alias("moran_i_within_group")
    )


def covariate_spearman(nodes: DataFrame, names: Sequence[str], covariate: str, *, x: str = "x") -> DataFrame:
    """Rank correlation of every factor with a per-node value; NULL for a constant factor."""
    ranked = average_ranks(nodes.select("id", covariate, x), covariate, "_ry")
    long = loadings_long(ranked, x, names, ["_ry"])
    long = average_ranks(long, "value", "_rx", ["pos"])
    return long.groupBy("factor", "pos").agg(pearson("_rx", "_ry").alias("covariate_spearman"))


def _residual_fit(nodes: DataFrame, covariate: str, x: str) -> list[tuple[float, float]]:
    """(intercept, slope) of every factor on the covariate, two numbers per factor."""
    long = nodes.select(F.col(covariate).cast("double").alias("c"), F.posexplode(as_doubles(x)).alias("pos", "v"))
    slope = F.coalesce(F.try_divide(F.covar_pop("c", "v"), F.var_pop("c")), F.lit(0.0))
    fit = long.groupBy("pos").agg(slope.alias("b"), F.avg("v").alias("mv"), F.avg("c").alias("mc"))
    return [(r["mv"] - r["b"] * r["mc"], r["b"]) for r in fit.orderBy("pos").collect()]


def residuals(nodes: DataFrame, covariate: str, *, x: str = "x", out: str = "resid") -> DataFrame:
    """Nodes with their factor values after least squares on [1, covariate]."""
    fit = _residual_fit(nodes, covariate, x)
    line = F.zip_with(
        _literal([a for a, _ in fit]), _literal([b for _, b in fit]),
        lambda a, b: a + b * F.col(covariate).cast("double"),
    )
    return nodes.withColumn(out, F.zip_with(as_doubles(x), line, lambda v, f: v - f))


def moran_residual(nodes: DataFrame, edges: DataFrame, names: Sequence[str], covariate: str, *, x: str = "x") -> DataFrame:
    """Moran's I after removing a linear effect of the covariate."""
    rows = residuals(nodes, covariate, x=x, out="_r")
    rows = rows.select("id", _minus("_r", _column_means(rows, "_r")).alias("_c"))
    stats = _totals(_sums(rows, edges, "_c", [0.0] * len(names)))
    centred = nodes.select(_minus(x, _column_means(nodes, x)).alias("_c"))
    energy = centred.select(F.posexplode("_c").alias("pos", "v")).groupBy("pos").agg(
        F.sum(F.col("v") * F.col("v")).alias("ref")
    )
    # One row per factor.
    stats = stats.join(F.broadcast(energy), "pos")
    return _named(stats, names).select("factor", "pos", _resid_i().alias("moran_i_resid"))


def _resid_i() -> Column:
    alive = F.col("vv") > _VANISHED * F.greatest(F.col("ref"), F.lit(1e-300))
    return F.when(alive, F.try_divide("vw", "vv"))


def _permuted(nodes: DataFrame, v: str, seeds: Sequence[int], perms: DataFrame) -> DataFrame:
    """(id, _perms): the arrays of the permuted nodes, one after the other in seed order."""
    values = nodes.select(F.col("id").alias("other"), F.col(v).alias("_o"))
    wanted = perms.where(F.col("seed").isin(*seeds))
    # As many rows per node as there are seeds.
    lists = wanted.join(values, "other").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("seed", "_o"))).alias("_l")
    )
    return lists.select("id", F.flatten(F.transform("_l", lambda s: s["_o"])).alias("_perms"))


def _packed(batches):
    """Rows (a, v) with the doubles of v as bytes: a null array in each row of edges is slow to send."""
    import pyarrow as pa

    for batch in batches:
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array([row.tobytes() for row in flat], pa.binary())], names=["a", "v"])


def _edge_products(seeds: int):
    """Rows (o, a, b, w, v) in order of `o` to the sums (at, vw) of w * v[a] * v[b] by `at`.

    `o` is key * (seeds + 1) + at + 1: a key's nodes (at = -1; a, v) come before its edges, so a task
    holds the nodes of one key and a batch of edges.
    """

    def products(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        key, ids, held, index, table, sums = None, [], [], None, None, None
        for batch in batches:
            o = batch.column("o").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(o)) + 1).tolist(), len(o)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                now, at = divmod(int(o[start]), seeds + 1)
                if now != key:
                    key, ids, held, index = now, [], [], None
                if at == 0:
                    ids.append(piece.column("a").to_pandas())
                    held.append(np.frombuffer(b"".join(piece.column("v").to_pylist())).reshape(stop - start, -1))
                    continue
                if index is None:
                    index, table, held = pd.Index(pd.concat(ids)), np.concatenate(held), []
                    sums = np.zeros((seeds, table.shape[1])) if sums is None else sums
                a, b = (index.get_indexer(piece.column(c).to_pandas()) for c in ("a", "b"))
                weighted = table[a] * piece.column("w").to_numpy()[:, None]
                sums[at - 1] += np.einsum("ij,ij->j", weighted, table[b])
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(seeds), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["at", "sums"]
            )

    return products


def permutation_sums(
    nodes: DataFrame, edges: DataFrame, v: str, seeds: Sequence[int], perms: DataFrame, *, block: int = SEED_BLOCK
) -> DataFrame:
    """(seed, pos, vw): the product of every permuted value with its neighbour mean, summed over the nodes.

    That is the sum over the edges i -> j of v[p(i)] * v[p(j)] / degree(i), so edges are renamed by each
    permutation and no array goes along an edge. Nodes are dealt into groups; a renamed edge goes
    to the pair of groups of its ends, and every group's arrays to the pairs it is in. Groups hold
    about NODE_BYTES of arrays, at most; beyond PARTS such groups their number, and with it what is sent of
    the arrays, grows with the table. Seeds go in blocks, each written before the next one starts.
    """
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(v)).alias("width")).first()
    parts = max(PARTS, -(-size["n"] * max(size["width"] or 0, 1) * 8 // NODE_BYTES))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    pair = lambda p, q: F.least(p, q) * parts + F.greatest(p, q)

    known = edges.select("src", "dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    degrees = known.groupBy("src").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    links = known.join(degrees, "src")
    kind = dict(nodes.dtypes)["id"]
    arrays = nodes.select(F.col("id").alias("a"), as_doubles(v).alias("v")).mapInArrow(_packed, f"a {kind}, v binary")
    arrays = arrays.withColumns({"_p": dealt("a"), "_q": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})

    out = None
    if len(seeds) > block:
        links = materialize(links)
    for start in range(0, len(seeds), block):
        some = sorted(seeds[start : start + block])
        n = len(some)
        lists = perms.where(F.col("seed").isin(*some)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seed", "other"))).alias("_l"))
        moved = lists.select("id", F.transform("_l", lambda s: s["other"]).alias("_o"))
        ends = links.join(moved.select(F.col("id").alias("src"), F.col("_o").alias("a")), "src")
        ends = ends.join(moved.select(F.col("id").alias("dst"), F.col("_o").alias("b")), "dst")
        renamed = ends.select("w", F.posexplode(F.arrays_zip("a", "b")).alias("at", "e")).select("at", "e.a", "e.b", "w")
        sent = renamed.withColumn("key", pair(dealt("a"), dealt("b"))).select(
            "key", (F.col("key") * (n + 1) + F.col("at") + 1).alias("o"), "a", "b", "w", F.lit(None).cast("binary").alias("v")
        )
        held = arrays.withColumn("key", pair(F.col("_p"), F.col("_q"))).select(
            "key", (F.col("key") * (n + 1)).alias("o"), "a", F.lit(None).cast(kind).alias("b"),
            F.lit(None).cast("double").alias("w"), "v",
        )
        met = held.unionByName(sent).repartition("key").sortWithinPartitions("o").drop("key")
        partial = met.mapInArrow(_edge_products(n), "at int, sums array<double>")
        long = partial.select("at", F.posexplode("sums").alias("pos", "s")).groupBy("at", "pos").agg(F.sum("s").alias("vw"))
        order = F.array(*[F.lit(s) for s in some])
        sums = materialize(long.select(order[F.col("at")].alias("seed"), "pos", "vw"))
        out = sums if out is None else out.unionByName(sums)
    return out


def moran_permutation_p(
    nodes: DataFrame, edges: DataFrame, names: Sequence[str], *, x: str = "x", n_perm: int = 49, seed: int = 0
) -> DataFrame:
    """Moran's I and its one-sided permutation p, the same permutations for all factors."""
    rows = graph_specificity(nodes, edges, names, x=x, n_perm=n_perm, seed=seed)
    return rows.select("factor", "pos", "moran_i", "moran_p")


def _perm_seeds(seed: int, n_perm: int) -> list[int]:
    """Seeds of the Moran permutations, apart from the two derived reference seeds."""
    return [seed * 1_000 + 10 + i for i in range(n_perm)]


def graph_specificity(
    nodes: DataFrame,
    edges: DataFrame,
    names: Sequence[str],
    *,
    x: str = "x",
    ks: Sequence[int] | None = None,
    group: str | None = None,
    annotate: Sequence[str] = (),
    covariate: str | None = None,
    control: str | None = None,
    n_perm: int = 49,
    seed: int = 0,
) -> DataFrame:
    """Every specificity measure, one row per (factor, k).

    `nodes`: id, the non-negative array `x`, label and covariate columns. `edges`: src, dst
    (see `neighbour_edges`, `graph_edges`); with `ks` it must be a neighbour list with
    ``rank`` instead, scored at each prefix length. Columns: factor, pos, k, moran_i,
    moran_p, pr, pr_null, specificity, then moran_i_within_group, moran_i_resid and
    covariate_spearman, top_<label> and top_<label>_share as asked for. Reference rows
    ``_perm_control`` (the `control` factor permuted) and ``_covariate`` follow the factors.
    """
    names = [str(n) for n in names]
    if len(set(names)) != len(names):
        raise ValueError("factor names repeat")
    extra = [c for c in (group, covariate, *annotate) if c]
    require_columns(nodes, ["id", x, *extra], "nodes")
    require_unique(nodes, ["id"], "node ids repeat")
    _check_values(nodes, x, len(names), covariate)
    if control is not None and str(control) not in names:
        raise KeyError(f"control {control!r} is not one of the factors")
    refs = ([PERM_CONTROL] if control is not None else []) + ([COVARIATE] if covariate else [])
    if set(refs) & set(names):
        raise ValueError(f"factor names collide with reference rows {sorted(set(refs) & set(names))}")

    moran_seeds = _perm_seeds(seed, n_perm)
    perms = permutations(nodes, "id", [seed + 1, seed + 2, *moran_seeds])
    perms = materialize(perms)
    full = nodes.select("id", as_doubles(x).alias("x"), *dict.fromkeys(extra))
    if control is not None:
        at = names.index(str(control))
        other = full.select(F.col("id").alias("other"), F.col("x")[at].alias("_ctl"))
        swapped = perms.where(F.col("seed") == seed + 1).join(other, "other").select("id", "_ctl")
        full = full.join(swapped, "id").withColumn("x", F.concat("x", F.array("_ctl"))).drop("_ctl")
    if covariate:
        full = full.withColumn("x", F.concat("x", F.array(F.col(covariate).cast("double"))))
    labels = names + refs
    m = len(labels)
    means = _column_means(full, "x")
    full = full.withColumn("_c", _minus("x", means))
    if covariate:
        full = residuals(full, covariate, out="_r")
        full = full.withColumn("_r", _minus("_r", _column_means(full, "_r")))
    full = materialize(full)

    # One long array per node: centred | participation null | residuals.
    wide = full.join(_permuted(full, "_c", [seed + 2], perms).withColumnRenamed("_perms", "_null"), "id")
    parts, rest = ["_c", "_null"], [-v for v in means] * 2
    if covariate:
        parts.append("_r")
        rest += [0.0] * m
    wide = materialize(wide.select("id", F.concat(*parts).alias("_v"), *dict.fromkeys(annotate)))

    spearman = covariate_spearman(full, labels, covariate).drop("factor") if covariate else None
    spearman = materialize(spearman) if covariate else None

    out = None
    for k in ks if ks is not None else [None]:
        linked = materialize(neighbour_edges(edges, k=k) if ks is not None else edges.select("src", "dst"))
        rows = _sums(wide, linked, "_v", rest, list(dict.fromkeys(annotate)))
        totals = _totals(rows, list(dict.fromkeys(annotate)))
        if annotate:
            # The excess per label is needed again, for the first m positions only.
            rows = materialize(totals)
            totals = rows.groupBy("pos").agg(*[F.sum(c).alias(c) for c in ("vw", "vv", "e1", "e2", "n")])
        totals = materialize(totals)
        base = totals.where(F.col("pos") < m).select(
            "pos",
            F.when(F.col("vv") > 0, F.try_divide("vw", "vv")).alias("moran_i"),
            F.col("vv").alias("_vv"),
            F.when(F.col("e2") > 0, _pr()).alias("pr"),
        )
        null = totals.where((F.col("pos") >= m) & (F.col("pos") < 2 * m)).select(
            (F.col("pos") - m).alias("pos"), F.when(F.col("e2") > 0, _pr()).alias("pr_null")
        )
        # Tables below have one row per factor.
        table = base.join(F.broadcast(null), "pos").withColumn(
            "specificity", F.lit(1.0) - F.try_divide("pr", "pr_null")
        )
        if n_perm:
            drawn = permutation_sums(full, linked, "_c", moran_seeds, perms).select("pos", F.col("vw").alias("_nv"))
            beaten = drawn.join(F.broadcast(base.select("pos", "moran_i", "_vv")), "pos").groupBy("pos").agg(
                F.count_if(F.try_divide("_nv", "_vv") >= F.col("moran_i")).alias("_b")
            )
            p = F.when(F.col("moran_i").isNotNull(), (F.col("_b") + 1) / F.lit(float(n_perm + 1)))
            table = table.join(F.broadcast(beaten), "pos").withColumn("moran_p", p)
        else:
            table = table.withColumn("moran_p", F.lit(None).cast("double"))
        order = ["pos", "moran_i", "moran_p", "pr", "pr_null", "specificity"]
        table = _named(table, labels)
        if group:
            within = moran_within_groups(full, linked, labels, group).drop("factor")
            table = table.join(F.broadcast(within), "pos")
            order.append("moran_i_within_group")
        if covariate:
            resid = totals.where((F.col("pos") >= 2 * m) & (F.col("pos") < 3 * m)).select(
                (F.col("pos") - 2 * m).alias("pos"), "vw", "vv"
            )
            resid = resid.join(F.broadcast(base.select("pos", F.col("_vv").alias("ref"))), "pos")
            table = table.join(F.broadcast(resid.select("pos", _resid_i().alias("moran_i_resid"))), "pos")
            table = table.join(F.broadcast(spearman), "pos")
            order += ["moran_i_resid", "covariate_spearman"]
        for a in dict.fromkeys(annotate):
            per_label = rows.where(F.col("pos") < m).groupBy("pos", a).agg(F.sum("e1").alias("e"))
            top = footprint_top(_shares(per_label, a, labels)).drop("factor")
            top = top.withColumnsRenamed({"top": f"top_{a}", "top_share": f"top_{a}_share"})
            table = table.join(F.broadcast(top), "pos", "left")
            order += [f"top_{a}", f"top_{a}_share"]
        kept = table.select("factor", *order, F.lit(k).cast("int").alias("k"))
        out = kept if out is None else out.unionByName(kept)
    return out


def _check_values(nodes: DataFrame, x: str, width: int, covariate: str | None) -> None:
    """Raise on a wrong width, a non-finite or negative value, or a missing covariate."""
    require_none(nodes.where(F.size(x) != width), "id", f"nodes without {width} values")
    values = nodes.select(F.explode(as_doubles(x)).alias("v"))
    bad = values.agg(
        F.count_if(finite("v").isNull()).alias("odd"), F.count_if(F.col("v") < 0).alias("below")
    ).first()
    if bad["odd"]:
        raise ValueError(f"values must be finite: {bad['odd']} are not")
    if bad["below"]:
        raise ValueError(f"{bad['below']} negative values; split signed factors into arms first")
    if covariate:
        require_none(nodes.where(finite(covariate).isNull()), "id", "nodes without a finite covariate")


def same_process_neighbours(
    df: DataFrame, x: str, names: Sequence[str], label: str, *, row: str = "id"
) -> DataFrame:
    """How far a factor's own order keeps the cells of a label together: factor, label, spn.

    Cells are sorted by the factor (ties by `row`); spn is the excess over chance, as a
    share of its maximum, that the cell after one with the label has it too, floored at 0.
    NULL for a label on fewer than two cells or on all of them. Sorting is spread over range
    partitions and the pair across each border is added from a table of first rows.
    """
    require_columns(df, [x, label, row])
    per_label = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_label"))
    n = df.count()
    per_label = per_label.where("label is not null")

    rows = loadings_long(df.select(row, x, F.col(label).alias("label")), x, names, [row, "label"])
    placed = by_order(rows.select("pos", "value", row, "label"), ["pos", "value", row])
    inside = Window.partitionBy("pos", SEG).orderBy("value", row)
    following = F.lead(F.struct("label")).over(inside)
    firsts = placed.groupBy("pos", SEG).agg(
        F.min_by(F.struct("label"), F.struct("value", row)).alias("_first")
    )
    border = firsts.select("pos", SEG, F.lead("_first").over(Window.partitionBy("pos").orderBy(SEG)).alias("_border"))
    pairs = placed.withColumn("_next", following).join(border, ["pos", SEG])
    pairs = pairs.withColumn("_next", F.coalesce("_next", "_border")).where("_next is not null and label is not null")
    counted = pairs.groupBy("pos", "label").agg(
        F.count(F.lit(1)).alias("_on"), F.count_if(F.col("_next.label") == F.col("label")).alias("_both")
    )
    grid = per_label.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    f = F.col("n_label") / F.lit(float(n))
    spn = F.greatest(F.lit(0.0), F.try_divide(F.try_divide(F.col("_both"), F.col("_on")) - f, F.lit(1.0) - f))
    defined = (F.col("n_label") >= 2) & (F.col("n_label") < n)
    joined = grid.join(counted, ["pos", "label"], "left")
    return _named(joined, names).select("factor", "pos", "label", F.when(defined, spn).alias("spn"))


def spn_best(spn: DataFrame) -> DataFrame:
    """Each factor's best label and its score."""
    best = F.min(F.struct((-F.col("spn")).alias("s"), F.col("label").alias("l"))).alias("_b")
    return spn.where("spn is not null").groupBy("factor", "pos").agg(best).select(
        "factor", "pos", F.col("_b.l").alias("label"), (-F.col("_b.s")).alias("spn")
    )

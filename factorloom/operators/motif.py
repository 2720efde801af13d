"""Factor against motif enrichment with an exact stratified permutation null.

The statistic of a (factor, motif) pair is the sum over regions of weight times score. Under
permutation of regions inside strata its mean and variance are closed forms of per-stratum
sums and sums of squares of the weights and of the scores, so nothing is sampled. Strata
enter the one pass over the score table as extra rows of the weight table with weight 1:
the same join and aggregation then yields both the statistic and the score moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from factorloom.guards import finite, require_columns, require_rows, require_unique
from factorloom.operators.ordered import quantiles
from factorloom.operators.sequence import CHUNK, gc_content
from factorloom.session import broadcast_if_small, materialize

#: Motifs of a slab of a dense product.
BLOCK = 256

#: Bytes of sums that a task of the pass over long scores holds before it emits them.
SUMS_BYTES = 64 << 20

#: Smallest stratum with a defined permutation variance.
MIN_STRATUM_SIZE = 2
DEFAULT_THRESHOLD_PCT = 50.0
DEFAULT_GC_BINS = 10
DEFAULT_WIDTH_BINS = 10


def soft_threshold(
    weights: DataFrame, pct: float = DEFAULT_THRESHOLD_PCT, *, factor: str = "factor", weight: str = "weight"
) -> DataFrame:
    """Weights below a percentile of their factor's positive weights become 0.

    A factor without positive weights is untouched; ``pct <= 0`` changes nothing.
    """
    require_columns(weights, [factor, weight], "weights")
    if pct <= 0:
        return weights
    # Read for the cuts and again to apply them.
    weights = materialize(weights)
    cuts = quantiles(weights.where(F.col(weight) > 0), weight, {"_cut": pct / 100.0}, [factor])
    joined = weights.join(broadcast_if_small(cuts.drop("n")), factor, "left")
    kept = F.when(F.col(weight) < F.col("_cut"), F.lit(0.0)).otherwise(F.col(weight))
    return joined.withColumn(weight, kept).drop("_cut")


def regionise(
    pairs: DataFrame,
    weights: DataFrame,
    *,
    region: str = "region",
    feature: str = "peak",
    factor: str = "factor",
    weight: str = "weight",
) -> DataFrame:
    """Mean weight of the features matched to each region, per factor.

    `weights` may leave out zero weights: the mean divides by the matched features of the
    region. A (region, factor) whose features all have no weight has no row.
    """
    require_columns(pairs, [region, feature], "region map")
    require_columns(weights, [feature, factor, weight], "weights")
    matched = pairs.groupBy(region).agg(F.count(F.lit(1)).alias("_n"))
    # The counts ride on the pairs, of which a task hashes its part, so the long weights are not sorted.
    counted = pairs.select(region, feature).join(matched, region)
    rows = weights.select(feature, factor, weight).join(counted.hint("shuffle_hash"), feature)
    mean = F.sum(F.col(weight).cast("double")) / F.first("_n")
    return rows.groupBy(region, factor).agg(mean.alias(weight))


def covariate_strata(
    df: DataFrame,
    covariates: Sequence[str],
    n_bins: int | Sequence[int],
    *,
    min_size: int = MIN_STRATUM_SIZE,
    out: str = "stratum",
) -> DataFrame:
    """Rows with the stratum their quantile-binned covariates cross into.

    Rows with a missing or infinite covariate, or in a stratum below `min_size`, are left
    out. Strata are numbered from 0 in the order of their bins. Bin edges are the distinct
    quantiles of each covariate (a few numbers fetched to the driver); a constant covariate
    is one bin.
    """
    covariates = list(covariates)
    if not covariates:
        raise ValueError("strata need a covariate, none was named")
    bins = [n_bins] * len(covariates) if isinstance(n_bins, int) else list(n_bins)
    if len(bins) != len(covariates):
        raise ValueError("n_bins must be one number or one per covariate")
    require_columns(df, covariates)
    usable = df
    for c in covariates:
        usable = usable.where(finite(c).isNotNull())
    # One search over (covariate, value) finds the edges of all covariates.
    values = F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(covariates)])
    long = materialize(usable.select(F.explode(values).alias("x")).select("x.c", "x.v"))
    wanted = {f"e{n}_{i}": i / n for n in sorted(set(bins)) for i in range(n + 1)}
    found = {r["c"]: r for r in quantiles(long, "v", wanted, ["c"]).collect()}
    code, scale = F.lit(0).cast("bigint"), 1
    for k, (c, n) in enumerate(zip(covariates, bins, strict=True)):
        edges = sorted({found[k][f"e{n}_{i}"] for i in range(n + 1)}) if k in found else []
        code = code + _bin(c, edges) * scale
        scale *= n
    coded = usable.withColumn("_code", code)
    sizes = coded.groupBy("_code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= int(min_size))
    # At most the product of the bin counts.
    ids = sizes.select("_code", (F.row_number().over(Window.orderBy("_code")) - 1).alias(out))
    return coded.join(broadcast_if_small(ids), "_code").drop("_code")


def _bin(column: str, edges: Sequence[float]):
    """Number of edges not above the value, minus 1, within the bins the edges make."""
    last = max(len(edges) - 2, 0)
    v = F.col(column).cast("double")
    at = F.lit(0)
    # Edge i opens bin i; the first edge opens bin 0 and the last one closes the last bin.
    for i in range(1, last + 1):
        at = F.when(v >= F.lit(edges[i]), F.lit(i)).otherwise(at)
    return at.cast("bigint")


def gc_width_strata(
    regions: DataFrame,
    chunks: DataFrame,
    *,
    region: str = "region",
    gc_bins: int = DEFAULT_GC_BINS,
    width_bins: int = DEFAULT_WIDTH_BINS,
    min_size: int = MIN_STRATUM_SIZE,
    size: int = CHUNK,
) -> DataFrame:
    """Strata of regions crossed by G+C content and width."""
    rows = gc_content(regions, chunks, name=region, size=size).withColumn(
        "width", (F.col("end") - F.col("start")).cast("double")
    )
    # The content is computed once and read for the edges of both covariates.
    return covariate_strata(materialize(rows), ["gc", "width"], [gc_bins, width_bins], min_size=min_size)


def _one_pass(weights: DataFrame, scores: DataFrame, strata: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(kind, id, motif, ws, wss): weighted sums of scores, kind f for `factors`, kind g for strata with weight 1; those also of squares.

    A region is one row with its weights, its stratum and its scores, so no row is made for a (factor, region,
    motif). A task adds up one row of sums for each motif it meets and emits them, at the end or when they
    are SUMS_BYTES, so what is shuffled are rows of sums. Names of strata are fetched to the driver.
    """
    spark, groups = weights.sparkSession, sorted((r[0] for r in strata.select("stratum").distinct().collect()), key=str)
    width, n = len(factors) + 2 * len(groups), len(factors)
    if not width:
        return scores.select(F.lit("f").alias("kind"), F.lit("").alias("id"), "motif", F.lit(0.0).alias("ws"), F.lit(0.0).alias("wss")).where("false")
    places = spark.createDataFrame(list(zip(factors, range(n), strict=True)), "factor string, pos int")
    used = weights.where("weight <> 0").join(F.broadcast(places), "factor")
    per_region = used.groupBy("region").agg(F.collect_list("pos").alias("at"), F.collect_list("weight").alias("w"))
    kind = dict(strata.dtypes)["stratum"]
    numbers = spark.createDataFrame([(g, k) for k, g in enumerate(groups)], f"stratum {kind}, g int")
    members = strata.join(F.broadcast(numbers), strata["stratum"].eqNullSafe(numbers["stratum"])).select("region", "g")
    scored = scores.where("score IS NOT NULL AND motif IS NOT NULL").groupBy("region").agg(F.collect_list("motif").alias("motifs"), F.collect_list("score").alias("s"))
    joined = scored.join(members, "region").join(per_region, "region", "left").select("g", "at", "w", "motifs", "s")

    def add(batches):
        import numpy as np
        import pyarrow as pa

        known, sums, motif_type = {}, np.zeros((1024, width)), None

        def emit():
            names = pa.array(list(known), motif_type)
            for k in range(0, len(names), 10_000):
                part = names.slice(k, 10_000)
                flat = pa.array(sums[k : k + len(part)].reshape(-1))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([part, rows], names=["motif", "sums"])

        for batch in batches:
            motif_type = batch.column("motifs").type.value_type
            counts = batch.column("motifs").value_lengths().to_numpy()
            motifs = batch.column("motifs").flatten().dictionary_encode()
            code = np.array([known.setdefault(m, len(known)) for m in motifs.dictionary.to_pylist()], np.int64)[motifs.indices.to_numpy()]
            score = batch.column("s").flatten().to_numpy()
            row, group = np.repeat(np.arange(len(counts)), counts), batch.column("g").to_numpy()
            held = batch.column("at").value_lengths().fill_null(0).to_numpy()
            w = np.zeros((len(counts), n))
            np.add.at(w, (np.repeat(np.arange(len(counts)), held), batch.column("at").flatten().to_numpy()), batch.column("w").flatten().to_numpy())
            while len(known) > len(sums):
                sums = np.concatenate([sums, np.zeros_like(sums)])
            step = max(1, (16 << 20) // (8 * max(n, 1)))
            for k in range(0, len(row), step):
                order = k + np.argsort(code[k : k + step], kind="stable")
                of, x = code[order], score[order]
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                products = w[row[order]]
                products *= x[:, None]
                odd = ~np.isfinite(x)
                # A weight of 0 stands for none.
                products[odd] = np.where(w[row[order[odd]]] == 0, 0.0, products[odd])
                sums[of[first], :n] += np.add.reduceat(products, first, axis=0)
                at = n + 2 * group[row[order]]
                np.add.at(sums, (of, at), x)
                np.add.at(sums, (of, at + 1), x * x)
            if len(known) * width * 8 > SUMS_BYTES:
                yield from emit()
                known, sums = {}, np.zeros((1024, width))
        if known:
            yield from emit()

    partial = joined.mapInArrow(add, f"motif {dict(scores.dtypes)['motif']}, sums array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")
    rows = materialize(partial.groupBy("motif").agg(total))
    of_factors = rows.select("motif", F.posexplode(F.slice("sums", 1, n)).alias("pos", "ws")).join(F.broadcast(places), "pos")
    pair = F.transform(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda g: F.struct(F.element_at("sums", n + 1 + 2 * g).alias("ws"), F.element_at("sums", n + 2 + 2 * g).alias("wss")))
    of_strata = rows.select("motif", F.posexplode(pair).alias("g", "v")).join(F.broadcast(numbers), "g")
    return of_factors.select(F.lit("f").alias("kind"), F.col("factor").alias("id"), "motif", "ws", F.lit(0.0).alias("wss")).unionByName(
        of_strata.select(F.lit("g").alias("kind"), F.col("stratum").cast("string").alias("id"), "motif", "v.ws", "v.wss")
    )


def _places(names: DataFrame) -> DataFrame:
    """(pos, motif) with positions from 0 on, each once; anything else raises."""
    require_columns(names, ["pos", "motif"], "motif names")
    places = materialize(names.select(F.col("pos").cast("int").alias("pos"), F.col("motif").cast("string").alias("motif")))
    found = places.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("p"), F.count_distinct("motif").alias("m"),
        F.min("pos").alias("low"), F.max("pos").alias("high"),
    ).first()
    if found["n"] and (found["p"] != found["n"] or found["m"] != found["n"] or found["low"] != 0 or found["high"] != found["n"] - 1):
        raise ValueError(f"motif names must be distinct and take the positions 0 to n - 1, not {found.asDict()}")
    return places


def _one_pass_dense(weights: DataFrame, vectors: DataFrame, strata: DataFrame, places: DataFrame, block: int) -> DataFrame:
    """The same sums for scores stored as one array per region, by products of slabs.

    Arrays are cut into slabs of `block` motifs. Within a partition rows are sorted by slab, so a
    task holds the (ids x block) matrix of one slab at a time, multiplies batches of rows into it
    and emits it once: its memory does not depend on the number of motifs, and what is shuffled
    not on the number of regions. Partial matrices are summed as vectors per (id, slab); names
    come from `places` by a join, and arrays of another length than that table raise.
    """
    tagged = weights.select("region", F.concat(F.lit("f"), F.col("factor")).alias("id"), "weight")
    members = strata.select(
        "region", F.concat(F.lit("g"), F.col("stratum").cast("string")).alias("id"), F.lit(1.0).alias("weight")
    )
    per_region = tagged.unionByName(members).groupBy("region").agg(
        F.collect_list("id").alias("ids"), F.collect_list("weight").alias("ws")
    )

    def products(batches):
        import numpy as np
        import pyarrow as pa

        def emit():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(index), pa.string()),
                    pa.array([slab] * len(index), pa.int32()),
                    *[pa.array(list(sums[: len(index), k]), pa.list_(pa.float64())) for k in (0, 1)],
                ],
                names=["id", "slab", "ws", "wss"],
            )

        slab, index, sums = None, {}, None
        for batch in batches:
            slabs = batch.column("slab").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slabs)) + 1).tolist(), len(slabs)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                lengths = np.unique(piece.column("s").value_lengths().to_numpy())
                if slab != int(slabs[a]):
                    if index:
                        yield from emit()
                    slab, index, sums = int(slabs[a]), {}, np.zeros((0, 2, int(lengths[0])))
                if len(lengths) != 1 or lengths[0] != sums.shape[2]:
                    raise ValueError("score arrays differ in length")
                s = piece.column("s").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                ids = piece.column("ids").flatten().to_pylist()
                for name in ids:
                    index.setdefault(name, len(index))
                row = np.repeat(np.arange(b - a), piece.column("ids").value_lengths().to_numpy())
                w = np.zeros((b - a, len(index)))
                w[row, [index[name] for name in ids]] = piece.column("ws").flatten().to_numpy(zero_copy_only=False)
                sums = np.concatenate([sums, np.zeros((len(index) - len(sums), *sums.shape[1:]))])
                sums[:, 0] += w.T @ s
                sums[:, 1] += w.T @ (s * s)
        if index:
            yield from emit()

    joined = vectors.where(F.size("s") > 0).join(per_region, "region")
    starts = F.sequence(F.lit(0), F.floor((F.size("s") - 1) / block).cast("int"))
    cut = F.transform(starts, lambda b: F.slice("s", b * block + 1, block))
    slabs = joined.select("ids", "ws", F.posexplode(cut).alias("slab", "s")).sortWithinPartitions("slab")
    partial = slabs.select("slab", "s", "ids", "ws").mapInArrow(products, "id string, slab int, ws array<double>, wss array<double>")

    def total(column: str):
        return vector_to_array(Summarizer.sum(array_to_vector(column))).alias(column)

    pieces = partial.groupBy("id", "slab").agg(total("ws"), total("wss"))
    rows = pieces.select("id", "slab", F.posexplode(F.arrays_zip("ws", "wss")).alias("at", "v"))
    rows = rows.select("id", (F.col("slab") * block + F.col("at")).alias("pos"), "v.ws", "v.wss").join(places, "pos", "full")
    rows = materialize(rows)
    odd = rows.agg(F.count_if(F.col("motif").isNull()).alias("unnamed"), F.count_if(F.col("id").isNull()).alias("unscored"), F.count("id").alias("n")).first()
    if odd["n"] and (odd["unnamed"] or odd["unscored"]):
        raise ValueError(f"score arrays and motif names are not aligned: {odd.asDict()}")
    return rows.where("id IS NOT NULL").select(
        F.substring("id", 1, 1).alias("kind"), F.expr("substring(id, 2)").alias("id"), "motif", "ws", "wss"
    )


def motif_enrichment(
    weights: DataFrame,
    scores: DataFrame,
    strata: DataFrame,
    *,
    tf: DataFrame | None = None,
    motifs: Sequence[str] | DataFrame | None = None,
    block: int = BLOCK,
    check_invariance: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """Score every (factor, motif) pair, sorted by factor and falling score.

    `weights`: factor, region, weight (missing = 0). `strata`: region, stratum; only its
    regions count. `scores`: region, motif, score (missing = 0), or region and an array
    ``s`` with the names of its entries in `motifs`: a sequence, or a table of (pos, motif).
    Such arrays are worked on in slabs of `block` motifs. `tf`: motif, tf_annotation.

    Weights must be finite and non-negative; a factor with no weight left is dropped. The
    output has weighted_score for weights that sum to 1 per factor, nes against the
    within-stratum permutation null, nes_unstratified against the unrestricted one, and
    n_regions. Factor names are fetched to the driver.

    `check_invariance` lets a copy of the first factor with weights times a million ride the same
    pass; scores that differ raise. `observation` gets the counts of `enrichment_meta` from
    the job that first computes the result.
    """
    require_columns(weights, ["factor", "region", "weight"], "weights")
    require_columns(strata, ["region", "stratum"], "strata")
    require_columns(scores, ["region", "s"] if motifs is not None else ["region", "motif", "score"], "scores")
    if motifs is not None:
        if not isinstance(motifs, DataFrame):
            named = [(k, str(m)) for k, m in enumerate(motifs)]
            motifs = scores.sparkSession.createDataFrame(named, "pos int, motif string")
        places = _places(motifs)
    strata = materialize(strata.select("region", "stratum"))
    require_unique(strata, ["region"], "a region is in two strata")
    w = weights.select(F.col("factor").cast("string").alias("factor"), "region", F.col("weight").cast("double").alias("weight"))
    # Read by the checks, the weight moments and the pass over the scores.
    w = materialize(w.join(strata, "region").select("factor", "region", "stratum", "weight"))
    bad = w.agg(
        F.count_if(finite("weight").isNull()).alias("odd"),
        F.count_if(F.col("weight") < 0).alias("below"),
        F.min(F.when(F.col("weight") > 0, F.col("factor"))).alias("first"),
    ).first()
    if bad["odd"]:
        raise ValueError(f"non-finite weights: {bad['odd']}")
    if bad["below"]:
        raise ValueError(f"negative weights: {bad['below']}")

    first = bad["first"] if check_invariance else None
    if first is not None:
        twin = w.where(F.col("factor") == F.lit(first)).withColumns(
            {"factor": F.lit(_TWIN), "weight": F.col("weight") * _TWIN_SCALE}
        )
        w = w.unionByName(twin)

    sizes = strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_g"))
    by_stratum = (
        w.groupBy("factor", "stratum")
        .agg(F.sum("weight").alias("sw"), F.sum(F.col("weight") * F.col("weight")).alias("sw2"))
        .join(broadcast_if_small(sizes), "stratum")
    )
    by_stratum = broadcast_if_small(by_stratum)
    per_factor = by_stratum.groupBy("factor").agg(F.sum("sw").alias("w1"), F.sum("sw2").alias("w2"))
    per_factor = per_factor.where("w1 > 0")
    factors = sorted(r[0] for r in per_factor.select("factor").collect())
    n, n_strata = strata.agg(F.count(F.lit(1)), F.count_distinct("stratum")).first()

    sums = (
        _one_pass(w, scores.select("region", "motif", F.col("score").cast("double").alias("score")), strata, factors)
        if motifs is None
        else _one_pass_dense(w, scores.select("region", "s"), strata, places, block)
    )
    sums = broadcast_if_small(sums)
    t = sums.where("kind = 'f'").select(F.col("id").alias("factor"), "motif", F.col("ws").alias("t"))
    moments = sums.where("kind = 'g'").select(
        F.col("id").cast(dict(strata.dtypes)["stratum"]).alias("stratum"), "motif", F.col("ws").alias("ss"), F.col("wss").alias("ss2")
    )

    # (factor, stratum) is one row per factor and stratum, bounded by the bins.
    n_g = F.col("n_g")
    mean = F.col("sw") * F.col("ss") / n_g
    spread_w = F.col("sw2") - F.col("sw") * F.col("sw") / n_g
    spread_s = F.col("ss2") - F.col("ss") * F.col("ss") / n_g
    null = (
        moments.join(by_stratum, "stratum")
        .groupBy("factor", "motif")
        .agg(F.sum(mean).alias("e"), F.sum(spread_w * spread_s / F.greatest(n_g - 1, F.lit(1))).alias("var"))
    )
    per_motif = moments.groupBy("motif").agg(F.sum("ss").alias("s1"), F.sum("ss2").alias("s2"))

    if motifs is None:
        names = scores.select("motif").distinct()
    else:
        names = places.select("motif")
    grid = names.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    full = (
        grid.join(F.broadcast(per_factor), "factor")
        .join(per_motif, "motif", "left")
        .join(t, ["factor", "motif"], "left")
        .join(null, ["factor", "motif"], "left")
        .na.fill(0.0, ["t", "e", "var", "s1", "s2"])
    )

    def nes(expected, variance):
        sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
        return F.when(sd > 0, F.try_divide(F.col("t") - expected, sd)).otherwise(F.lit(0.0))

    flat_w = F.col("w2") - F.col("w1") * F.col("w1") / n
    flat_s = F.col("s2") - F.col("s1") * F.col("s1") / n
    flat = nes(F.col("w1") * F.col("s1") / n, flat_w * flat_s / F.lit(max(n - 1, 1)))
    rows = full.select(
        "factor",
        F.col("motif").alias("motif_id"),
        (F.col("t") / F.col("w1")).alias("weighted_score"),
        nes(F.col("e"), F.col("var")).alias("nes"),
        flat.alias("nes_unstratified"),
    )
    if first is not None:
        rows = _without_twin(materialize(rows), first)
    if tf is not None:
        rows = rows.join(tf.select(F.col("motif").alias("motif_id"), "tf_annotation"), "motif_id", "left")
    rows = rows.withColumn("n_regions", F.lit(n))
    order = ["factor", "motif_id", "weighted_score", "nes", "nes_unstratified"]
    order += ["tf_annotation"] if tf is not None else []
    rows = rows.select(*order, "n_regions").orderBy("factor", F.desc("nes"))
    if observation is None:
        return rows
    named = len([f for f in factors if f != _TWIN])
    return rows.observe(
        observation,
        F.count(F.lit(1)).alias("n_pairs"),
        F.max("n_regions").alias("n_regions"),
        F.max(F.lit(named)).alias("n_factors"),
        F.max(F.lit(n_strata)).alias("n_strata"),
    )


#: Name of the scaled copy of a factor; no factor is named by this control character alone.
_TWIN = "\x01"
_TWIN_SCALE = 1e6


def _without_twin(rows: DataFrame, factor: str) -> DataFrame:
    """`rows` without the scaled copy of `factor`; scores that differ from it raise."""
    pair = rows.where(F.col("factor").isin(factor, _TWIN)).groupBy("motif_id")
    gaps = [(F.max(c) - F.min(c)).alias(c) for c in ("nes", "nes_unstratified")]
    worst = pair.agg(*gaps).agg(F.max(F.greatest("nes", "nes_unstratified"))).first()[0]
    # No motif, no score to compare.
    if worst is not None and not worst < 1e-6:
        raise AssertionError(f"scores change with the scale of the weights: {worst}")
    return rows.where(F.col("factor") != _TWIN)


def enrichment_meta(observation: Observation) -> dict[str, int]:
    """Counts that describe a run, seen by an `Observation` that went with `motif_enrichment`.

    Waits until its result was computed; nothing is counted again.
    """
    seen = observation.get
    counts = {c: seen.get(c) or 0 for c in ("n_regions", "n_factors", "n_strata")}
    pairs = seen.get("n_pairs") or 0
    counts["n_motifs"] = pairs // counts["n_factors"] if counts["n_factors"] else 0
    return {c: counts[c] for c in ("n_regions", "n_factors", "n_motifs", "n_strata")}


def used_regions(scores: DataFrame, regions: DataFrame) -> DataFrame:
    """Score rows of the given regions; none left raises."""
    kept = scores.join(regions.select("region"), "region", "left_semi")
    require_rows(kept, "no score rows for the given regions")
    return kept

r"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles, put in a global order: rare tokens first,
frequent ones last. Of two sets of n tokens with similarity of at least 75 %, each misses at most
m = n - ceil(0.75 n) of its tokens in the other, so:

* Rare tokens are indexed alone, for a prefix of m + l tokens. Linked sets with at least l
  common rare tokens share l tokens of these prefixes, which leaves out pairs that share a line.
* If all common tokens are frequent, single tokens would bring together everything that holds the
  same passage. Frequent tokens are dealt to classes by hash, the prefix is extended until m + 1 of its tokens
  are not the only one of their class, and pairs of tokens of one class are indexed: after m
  misses two common tokens of one class remain, and both sets index that pair.
* Sets of few tokens have too few for pairs; they index single tokens of a plain prefix, rare ones first.

Sets that are equal are one node from the start. Rare entries meet packed by hash range, and
pairs come with their number of common tokens. Entries that many nodes share are never paired with each
other: each node is compared with a few of the entry and components form. Of components that
still share an entry all pairs of nodes that may link are compared, each once however many
entries it shares: first by bitmaps, which bound how much two sets have in common (a pair that
they rule out is no row), then on whole sets like all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import passing, shuffle_partitions, small, stored
from factorloom.llm.components import components
from factorloom.llm.text import NOT_SPACE, mix, shingle_rows, shingles, slices, word_hashes, words

WIDTH = 5

#: A token in more documents is frequent, unless there are more than FREQUENT_MOST of those;
#: then the bound is doubled until the list, which every task holds, is short enough.
FREQUENT = 16
FREQUENT_MOST = 1_000_000

#: Sets with fewer tokens than this index single tokens.
FEW = 16

#: Nodes of an entry that all others are compared with in a turn, and turns before all pairs left are compared.
CENTRES = 4
TURNS = 4

#: All pairs left are compared at once when they are at most so many times the entries: a turn reads
#: the entries about as often, and joins components anew.
AT_ONCE = 8

#: Entries that a task packs at once, and bytes of text that it turns into tokens at once.
_PACK = 1 << 19
_SLICE = 1 << 18
_ONE = np.uint64(1)

#: Longs of a bitmap of a set.
BITMAP = 16


def set_rows(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingles in order)."""
    for row, found in shingle_rows(column, width, _SLICE):
        yield row, np.unique(found)


def node_of(tokens: np.ndarray) -> int:
    """The node of a set: equal sets share it."""
    total = np.uint64(len(tokens))
    with np.errstate(over="ignore"):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mix(tokens + _ONE).sum(dtype=np.uint64)
        return int(mix(np.array([total ^ np.bitwise_xor.reduce(mix(tokens))]))[0].view(np.int64))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * BITMAP hash classes whether the set has an odd number of its tokens.

    Two sets differ in at least as many tokens as their bitmaps differ in bits.
    """
    kind = (mix(tokens ^ np.uint64(0x632BE59BD9B4E019)) % np.uint64(64 * BITMAP)).astype(np.int64)
    return np.packbits((np.bincount(kind, minlength=64 * BITMAP) & 1).astype(bool)).view(np.int64)


def _bits(df: DataFrame) -> int:
    """Bits of a token that name its hash range: several ranges a partition."""
    return max(4, int(np.ceil(np.log2(8 * shuffle_partitions(df.sparkSession)))))


def _packed(keys: np.ndarray, bits: int, *values: np.ndarray) -> Iterator[tuple]:
    """(range, 32 bits of each key below the range, values) as bytes, by range."""
    order = np.argsort(keys, kind="stable")
    short = keys[order] >> np.uint64(32 - bits)
    ranges = (short >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(ranges, np.arange((1 << bits) + 1))
    low = short.astype(np.uint32)
    ordered = [v[order] for v in values]
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[r], bounds[r + 1]
        yield (r, low[a:b].tobytes(), *[v[a:b].tobytes() for v in ordered])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def frequent_tokens(texts: DataFrame, width: int, bound: int, most: int) -> np.ndarray:
    """Sorted short keys of the tokens in more than `bound` documents, at most `most` of them.

    Counted over all documents: tasks send their tokens packed by hash range, and a range is
    counted in one piece of bounded size.
    """
    bits = _bits(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, tokens in set_rows(batch.column(1), width):
                held.append(tokens)
                size += len(tokens)
                if size >= _PACK:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        # A token of the pack is sent once, with the number of its documents.
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        r, low, n = zip(*_packed(tokens, bits, n.astype(np.int32)), strict=True)
        columns = [pa.array(r, pa.int32()), pa.array(low, pa.binary()), pa.array(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["range", "low", "n"])

    def count(found: pd.DataFrame) -> pd.DataFrame:
        low, of = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in found["low"]]), return_inverse=True)
        n = np.bincount(of, np.concatenate([np.frombuffer(b, np.int32) for b in found["n"]]), len(low)).astype(np.int64)
        keys = (low[n > bound].astype(np.int64)) | (int(found["range"].iloc[0]) << 32)
        return pd.DataFrame({"key": keys, "n": n[n > bound].astype(np.int64)})

    counts = stored(
        texts.mapInArrow(send, "range int, low binary, n binary").groupBy("range").applyInPandas(count, "key long, n long"), "frequent"
    )
    while counts.where(F.col("n") > bound).limit(most + 1).count() > most:
        bound *= 2
    keys = counts.where(F.col("n") > bound).select("key").toPandas()["key"].to_numpy()
    return np.sort(keys.astype(np.int64))


def _slices(column: pa.Array, width: int, frequent: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct tokens of a text, which of them are frequent) for texts with words."""
    for _, _, data, offsets in slices(column, _SLICE):
        data, starts, ends, rows = words(data, offsets, NOT_SPACE)
        values, at = shingles(word_hashes(data, starts, ends), rows, width)
        keys = (values >> np.uint64(32 - bits)).astype(np.int64)
        place = np.searchsorted(frequent, keys)
        often = np.zeros(len(keys), bool)
        if len(frequent):
            often = frequent[np.minimum(place, len(frequent) - 1)] == keys
        for i in range(len(offsets) - 1):
            if at[i] < at[i + 1]:
                tokens, first = np.unique(values[at[i] : at[i + 1]], return_index=True)
                yield tokens, often[at[i] : at[i + 1]][first]


def misses(n: int) -> int:
    """Most tokens of a set of n that are missing in a linked set."""
    return n - (3 * n + 3) // 4


def depth(n):
    """Common rare tokens by which a pair of sets is a candidate."""
    return n // 16 + (n < 16)


def rare_pairs(texts: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """(a, b) that may be linked by what their rare prefixes share, at least `depth` tokens, or
    any if both have fewer rare tokens than their prefix takes."""
    bits = _bits(texts)
    known = texts.sparkSession.sparkContext.broadcast(frequent)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _, _ in held])
        counts = [len(t) for t, _, _ in held]
        nodes = np.repeat(np.array([x for _, x, _ in held], np.int64), counts)
        sizes = np.repeat(np.array([x for _, _, x in held], np.int32), counts)
        r, low, node, size = zip(*_packed(tokens, bits, nodes, sizes), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(r, pa.int32()), *[pa.array(x, pa.binary()) for x in (low, node, size)]], names=["range", "low", "node", "size"]
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for tokens, often in _slices(batch.column(1), width, known.value, bits):
                n = len(tokens)
                if n < FEW:
                    continue
                rare = tokens[~often]
                prefix = misses(n) + depth(n)
                if len(rare):
                    # The sign says that the prefix takes all rare tokens.
                    held.append((rare[:prefix].copy(), node_of(tokens), -n if len(rare) < prefix else n))
                    size += min(len(rare), prefix)
                if size >= _PACK:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def meet(found: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(b, np.uint32) for b in found["low"]])
        node = np.concatenate([np.frombuffer(b, np.int64) for b in found["node"]])
        size = np.concatenate([np.frombuffer(b, np.int32) for b in found["size"]])
        order = np.lexsort((node, low))
        low, node, size = low[order], node[order], size[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        low, node, size = low[fresh], node[fresh], size[fresh]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, len(low)):
            same = np.flatnonzero(low[step:] == low[:-step])
            if not len(same):
                break
            x, y = np.abs(size[same]), np.abs(size[same + step])
            same = same[100 * np.minimum(x, y) >= 75 * np.maximum(x, y)]
            a.append(same)
            b.append(same + step)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = pd.DataFrame({"a": node[a], "b": node[b], "na": size[a], "nb": size[b]})
        return pairs.groupby(["a", "b", "na", "nb"], as_index=False).size().rename(columns={"size": "common"})

    met = (
        texts.mapInArrow(send, "range int, low binary, node binary, size binary")
        .groupBy("range")
        .applyInPandas(meet, "a long, b long, na int, nb int, common long")
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("common").alias("common"))
    )
    size = F.least(F.abs("na"), F.abs("nb"))
    wanted = F.floor(size / 16) + (size < 16).cast("int")
    return met.where((F.col("common") >= wanted) | ((F.col("na") < 0) & (F.col("nb") < 0))).select("a", "b")


def combinations(tokens: np.ndarray, missing: int, rare: int, scheme: int) -> np.ndarray:
    """Keys of token pairs of one class from the extended prefix of a set's frequent tokens."""
    classes = max(1, 3 * (1 << scheme) // 8)
    kind = mix(tokens ^ np.uint64(scheme + 1)) % np.uint64(classes)
    order = np.lexsort((tokens, kind))
    tokens, kind = tokens[order], kind[order]
    again = np.zeros(len(kind), bool)
    again[1:] = kind[1:] == kind[:-1]
    full = np.cumsum(again)
    stop = int(np.searchsorted(full, missing - rare + 1)) + 1
    tokens, kind = tokens[:stop], kind[:stop]
    found = []
    for step in range(1, len(tokens)):
        same = np.flatnonzero(kind[step:] == kind[:-step])
        if not len(same):
            break
        found.append(mix(tokens[same] * np.uint64(0x9E3779B97F4A7C15) + tokens[same + step] + np.uint64(scheme)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shared_entries(texts: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """(key, node, n, f): entries by which one match makes a candidate; f tokens of the node can match."""
    bits = _bits(texts)
    known = texts.sparkSession.sparkContext.broadcast(frequent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, sizes, often_of = [], [], [], []
            for tokens, often in _slices(batch.column(1), width, known.value, bits):
                n = len(tokens)
                m, rare = misses(n), int((~often).sum())
                found = []
                if 3 * n <= 4 * FEW:
                    ordered = np.concatenate([tokens[~often], tokens[often]])
                    found.append((mix(ordered[: m + 1] + np.uint64(7)), n))
                if n >= FEW and rare <= m:
                    c = n.bit_length() - 1
                    for scheme in [c] + [c + 1] * (4 * n >= 3 << (c + 1)):
                        found.append((combinations(tokens[often], m, rare, scheme), n - rare))
                if found:
                    node = node_of(tokens)
                    for key, f in found:
                        keys.append(key)
                        nodes.append(np.full(len(key), node, np.int64))
                        sizes.append(np.full(len(key), n, np.int32))
                        often_of.append(np.full(len(key), f, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(nodes)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(often_of)),
                    ],
                    names=["key", "node", "n", "f"],
                )

    return stored(texts.mapInArrow(send, "key long, node long, n int, f int").distinct(), "entries")


def _fits(na: str, nb: str, fa: str, fb: str):
    """Whether sizes, and the tokens that can be common, allow a link."""
    n = [F.col(c).cast("long") for c in (na, nb)]
    return (100 * F.least(*n) >= 75 * F.greatest(*n)) & (7 * F.least(fa, fb).cast("long") >= 3 * (n[0] + n[1]))


def _bitmaps_fit():
    """Whether bitmaps allow a link: linked sets differ in at most a seventh of their sizes' sum."""
    differ = [F.bit_count(F.col("bitmap_a")[i].bitwiseXOR(F.col("bitmap_b")[i])) for i in range(BITMAP)]
    return 7 * sum(differ[1:], differ[0]).cast("long") <= F.col("n_a").cast("long") + F.col("n_b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(entries: DataFrame, turn: int = 0, centres: int = 1) -> DataFrame:
    """Each node of an entry with `centres` of the entry's nodes, others each turn; pairs within a
    component (column `root`) are left out."""
    lows = [
        F.min(F.struct(F.xxhash64("node", F.lit(turn * CENTRES + i)).alias("order"), "node", "n", "f", "root")) for i in range(centres)
    ]
    first = entries.groupBy("key").agg(F.array(*lows).alias("lows"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    low = first.select("key", F.explode("lows").alias("low")).select("key", *[F.col(f"low.{c}").alias(f"{c}_a") for c in ("node", "n", "f", "root")])
    met = entries.join(low, "key").where((F.col("root") != F.col("root_a")) & _fits("n_a", "n", "f_a", "f"))
    return _ordered(met.select(F.col("node_a").alias("a"), F.col("node").alias("b")))


def open_entries(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of keys whose nodes are in different components, with their component as `root`."""
    rooted = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return stored(rooted.join(split, "key", "left_semi"), "open")


def root_pairs(left: DataFrame) -> DataFrame:
    """Distinct pairs of components that share an entry and whose sizes allow a link.

    Two components that are alike share many entries, and entries of like documents hold much the same
    components. So entries are merged into blocks by the smallest hash of their components before
    these are paired: a pair is made once a block, and pairs that share no entry may join them.
    """
    of_root = left.groupBy("key", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("f").alias("f"))
    least = of_root.groupBy("key").agg(F.min(F.xxhash64("root")).alias("block"))
    of_root = of_root.join(least, "key").groupBy("block", "root").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("f").alias("f"))
    a, b = (of_root.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("root", "low", "high", "f")]) for s in ("a", "b"))
    near = (100 * F.col("high_a").cast("long") >= 75 * F.col("low_b").cast("long")) & (
        100 * F.col("high_b").cast("long") >= 75 * F.col("low_a").cast("long")
    )
    common = 7 * F.least("f_a", "f_b").cast("long") >= 3 * (F.col("low_a").cast("long") + F.col("low_b"))
    met = a.join(b, "block").where((F.col("root_a") < F.col("root_b")) & near & common)
    return stored(met.select("root_a", "root_b").distinct(), "root_pairs")


def open_members(left: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, root, n, f, bitmap) once for each node of the open entries."""
    found = left.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.max("f").alias("f"))
    return stored(found.join(whole.select("node", "bitmap"), "node"), "members")


def by_size(met: DataFrame, members: DataFrame) -> DataFrame:
    """(root_a, root_b, k_a, k_b): the pairs of components with their numbers of nodes, the smaller component as a."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
    x, y = (sizes.select(F.col("root").alias(f"root_{s}"), F.struct("k", "root").alias(s)) for s in "ab")
    sides = met.join(x, "root_a").join(y, "root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(sides.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("root", "k") for s in "ab"]), "sized_pairs")


def count_open(sized: DataFrame) -> int:
    """How many pairs of nodes the pairs of components of `by_size` stand for."""
    return int(sized.agg(F.sum(F.col("k_a") * F.col("k_b"))).first()[0] or 0)


def open_pairs(sized: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of nodes of the paired components, each once, that sizes, frequent tokens and bitmaps allow.

    The smaller component's nodes are joined first. A pair that cannot link is compared, but makes no row.
    """
    a, b = (members.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "f", "bitmap")]) for s in "ab")
    one, other = sized.join(a, "root_a").alias("one"), b.alias("other")
    may = (F.col("one.root_b") == F.col("other.root_b")) & _fits("n_a", "n_b", "f_a", "f_b") & _bitmaps_fit()
    return one.join(other, may).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def whole_sets(nodes: DataFrame, texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, tokens, bitmap) of the wanted nodes, from one whole text each, written to the shared folder."""
    named = stored(rows.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "named")
    # A set that only rows with a null id hold is looked for among all of these.
    wanted = small(stored(named.select(F.col("doc_id").alias("wanted")).distinct(), "wanted"))
    chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, found, maps = [], [], []
            for _, tokens in set_rows(batch.column(1), width):
                if len(tokens):
                    node.append(node_of(tokens))
                    found.append(tokens.view(np.int64))
                    maps.append(bitmap(tokens))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, maps)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), *lists], names=["node", "tokens", "bitmap"])

    found = chosen.mapInArrow(sets, "node long, tokens array<long>, bitmap array<long>")
    return stored(found.join(small(named.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets have the wanted similarity, written."""
    a = whole.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    b = whole.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(a, "a").join(b, "b").where(100 * common >= 75 * (F.size("ta") + F.size("tb") - common))
    return stored(met.select("a", "b"), "links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Sets are of distinct `width`-word shingles of whole texts (A-Z lower-cased, words parted by
    white space); a text of fewer words is one shingle, and an empty or null text has none and is
    linked with nothing. Two rows link when 100 * common >= 75 * union. `component_id` is the
    smallest id reachable by links, the row's own included; null ids take part but are no
    smallest id. Rows that repeat an id are judged each by its text. Only the two named columns
    are read; an empty table gives an empty result.
    """
    with passing(docs.sparkSession):
        return _joined(_texts(docs, id_col, text_col), width)


def _joined(texts: DataFrame, width: int) -> DataFrame:
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, tokens in set_rows(batch.column(1), width):
                n[i] = len(tokens)
                node[i] = node_of(tokens) if len(tokens) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node)], names=["doc_id", "n", "node"])

    rows = stored(texts.mapInArrow(sets, f"doc_id {id_type}, n long, node long"), "rows", keep=True)
    named = rows.where("n > 0")
    frequent = frequent_tokens(texts, width, FREQUENT, FREQUENT_MOST)
    entries = shared_entries(texts, width, frequent).withColumn("root", F.col("node"))
    known = stored(_ordered(rare_pairs(texts, width, frequent).unionByName(star_pairs(entries))), "pairs")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    nodes = entries.join(shared, "key", "left_semi").select("node")
    whole = whole_sets(nodes.unionByName(known.select(F.col("a").alias("node"))).unionByName(known.select(F.col("b").alias("node"))), texts, named, width)
    links = verify(known, whole)
    roots = components(links)
    number, turn, last = entries.count(), 0, False
    while not last:
        # Stars with several centres join components while many pairs are left; then, or when
        # stars find nothing new, all pairs left are compared, each once.
        turn += 1
        left = open_entries(entries, roots)
        members = open_members(left, whole)
        sized = by_size(root_pairs(left), members)
        total = count_open(sized)
        if not total:
            break
        last = total <= AT_ONCE * number or turn > TURNS
        pairs = stored((open_pairs(sized, members) if last else star_pairs(left, turn, CENTRES)).join(known, ["a", "b"], "left_anti"), "pairs")
        found = verify(pairs, whole)
        if found.isEmpty():
            if not last:
                turn, known = TURNS, known.unionByName(pairs)
            continue
        links, known = links.unionByName(found), known.unionByName(pairs)
        roots = components(links)

    nodes = named.groupBy("node").agg(F.min("doc_id").alias("low"))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = stored(placed.join(lowest, "root").select("node", "component_id"), "of_node", keep=True)
    return rows.join(of_node, (rows["node"] == of_node["node"]) & (rows["n"] > 0), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )

"""Document fingerprints by winnowing, with SQL functions only.

A text's k-grams are its runs of `k` bytes (UTF-8), each hashed by its CRC-32. Of every window
of `window` successive k-grams the smallest hash is selected, of equal ones the rightmost, and
kept with its place. So two texts that share `window + k - 1` bytes in a row share a selected
hash, and no match of fewer than `k` bytes is ever reported.

Minima slide by doubling: minima of windows of 1, 2, 4, ... grams are the smaller of two minima
of half the length, so a window costs log2(window) steps. Texts are cut into pieces with the
overlap that windows need; a piece's arrays live only while it is worked on.

Each document is also compared with the next one and with an edited text made of both. Documents
go to segments of their order by one shuffle, which is the only one that carries texts; the first
document of each segment goes to the segment before it as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import shuffle_partitions, small, stored

#: Bytes of a k-gram and k-grams of a window.
K = 16
WINDOW = 16

#: Windows of a piece; a piece's place and a hash share a number.
PIECE = 512
_PLACES = 1024

#: Segments per shuffle partition, and rows looked at per bound between segments.
SEGMENTS = 4
_SAMPLE = 16

_LOW = (1 << 31) - 1
_ORDER = ("missing", "id", "digest")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often or deep inside a lambda it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _minima(codes: Column, count: Column, window: int) -> Column:
    """Minima of all windows of `count` codes; of one, if there are fewer codes than a window takes."""


    def doubled(step: int) -> Callable[[Column], Column]:
        def use(a: Column) -> Column:
            later = F.slice(a, F.lit(step + 1), F.greatest(F.size(a) - step, F.lit(0)))
            return F.zip_with(a, later, lambda x, y: F.least(x, y))

        return use

    span = 1
    while span < window:
        step = min(span, window - span)
        codes = bound(codes, doubled(step))
        span += step
    return F.slice(codes, F.lit(1), F.greatest(count - (window - 1), F.lit(1)))


def _piece_entries(piece: Column, start: Column, k: int, window: int) -> Column:
    count = F.greatest(F.octet_length(piece) - (k - 1), F.lit(1))
    # A larger place makes a smaller code, so the rightmost of equal hashes is the minimum.
    codes = F.transform(F.sequence(F.lit(1), count), lambda j: F.crc32(F.substring(piece, j, F.lit(k))) * _PLACES - j)
    chosen = F.array_distinct(_minima(codes, count, window))

    def entry(code: Column) -> Column:
        crc = F.shiftright(code, 10) + 1
        return F.shiftleft(crc, 31) + (start + crc * _PLACES - code - 1)

    return F.transform(chosen, entry)


def winnowed(data: Column, first: Column, k: int = K, window: int = WINDOW) -> Column:
    """Entries (hash * 2^31 + place, in order of places) that windows from place `first` on select.

    `data` is binary. Fewer bytes than `k` are one gram, fewer grams than a window are one window;
    no bytes have no entry.
    """

    def whole(b: Column) -> Column:
        last = F.greatest(F.octet_length(b) - (k + window - 2), F.lit(1)) - 1
        starts = F.filter(F.sequence(first, F.greatest(last, first), F.lit(PIECE)), lambda s: (F.octet_length(b) > 0) & (s <= last))
        pieces = F.transform(
            starts,
            lambda s: bound(F.substring(b, s + 1, F.lit(PIECE + window + k - 2)), lambda x: _piece_entries(x, s, k, window)),
        )
        return F.array_distinct(F.flatten(pieces))

    return bound(data, whole)


def hashes_of(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.shiftright(e, 31))


def spelled(entries: Column) -> Column:
    """hash:place of all entries, hashes in capital hex, comma-joined."""
    return F.array_join(
        F.transform(entries, lambda e: F.concat(F.hex(F.shiftright(e, 31)), F.lit(":"), e.bitwiseAND(_LOW).cast("string"))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Common share of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def segment_bounds(keys: DataFrame, segments: int) -> list[tuple]:
    """First keys of the segments of distinct `keys`, the smallest of all first; rows between bounds are about as many."""
    order = F.struct(*_ORDER)
    low, rows = keys.agg(F.min(order), F.count(F.lit(1))).first()
    if not rows:
        return []
    part = int(min(1.0, _SAMPLE * segments / rows) * (1 << 40))
    sample = keys.where(F.pmod(F.xxhash64(*_ORDER), F.lit(1 << 40)) < part).collect()
    step = max(1, len(sample) // segments)
    picked = sorted(tuple(r) for r in sample)[step::step]
    return [tuple(low), *[p for p in picked if p > tuple(low)]]


def segment_of(bounds: Column, count: int, key: Column) -> Column:
    """Place of the last of `count` sorted bounds that is at most `key`, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, count).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, s: F.when((at + s < count) & (F.get(bounds, at + s) <= key), at + s).otherwise(at)
    )


def distinct_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows once each, their keys, keys with `copies` of rows that repeat an id and a text, or None)."""
    keys = stored(rows.select(*_ORDER).groupBy(*_ORDER).agg(F.count(F.lit(1)).alias("copies")), "fingerprint_keys")
    again = keys.where("copies > 1")
    if again.isEmpty():
        return rows, keys, None
    again = small(stored(again, "fingerprint_copies"))
    repeated = rows.join(again, list(_ORDER), "left_semi").groupBy(*_ORDER).agg(F.first("text").alias("text"))
    once = rows.join(again, list(_ORDER), "left_anti").unionByName(repeated)
    return once, keys, again


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of
    the next document, or all it has. Order is by id (whole numbers), null ids last, rows of one id by the SHA-256 of
    their text; after the last row comes the first. Rows that repeat an id and a text are one
    document in that order and get the same result. A null text counts as empty; an empty text has an empty fingerprint, and
    two empty fingerprints are alike (1). Places count bytes. Only the two named columns are read; an
    empty table gives an empty result. Reads the texts twice: for the keys, and for the fingerprints.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).select(
        F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.sha2("text", 256).alias("digest"), "text"
    )
    once, keys, again = distinct_rows(rows)
    limits = segment_bounds(keys.select(*_ORDER), SEGMENTS * shuffle_partitions(docs.sparkSession))
    count = max(1, len(limits))
    known = json.dumps([dict(zip(_ORDER, b, strict=True)) for b in limits])
    bounds = F.from_json(F.lit(known), "array<struct<missing: boolean, id: bigint, digest: string>>")

    key = F.struct(*_ORDER)
    placed = once.withColumn("segment", segment_of(bounds, count, key))
    own = F.struct(F.col("segment").alias("segment"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("segment") - 1, F.lit(count)).alias("segment"), F.lit(True).alias("extra"))
    sent = F.when(F.get(bounds, F.col("segment")) == key, F.array(own, before)).otherwise(F.array(own))
    dealt = placed.select(*_ORDER, "text", F.explode(sent).alias("to")).select(*_ORDER, "text", "to.segment", "to.extra").repartition("segment")

    data = F.col("text").cast("binary")
    marked = dealt.withColumn("entries", winnowed(data, F.lit(0), k, window))
    order = Window.partitionBy("segment").orderBy("extra", *_ORDER)
    pairs = marked.withColumns({"next_text": F.lead("text").over(order), "next_entries": F.lead("entries").over(order)}).where("NOT extra")

    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    stays = F.left(F.col("text"), n - half)
    edited = pairs.select(
        *_ORDER,
        n.cast("long").alias("n_chars"),
        "entries",
        "next_entries",
        F.concat(stays, F.left(F.col("next_text"), half)).alias("edited"),
        # What windows within the part that stays select is selected again; all others start from `fresh`.
        F.greatest(F.octet_length(stays) - (k + window - 2), F.lit(0)).alias("fresh"),
    )
    place = lambda e: e.bitwiseAND(_LOW)
    later = winnowed(F.col("edited").cast("binary"), F.greatest(F.col("fresh") - (window - 1), F.lit(0)), k, window)
    changed = bound(
        F.struct(F.col("fresh").alias("fresh"), F.col("entries").alias("entries"), later.alias("later")),
        lambda x: F.concat(
            F.filter(x["entries"], lambda e: place(e) < x["fresh"]), F.filter(x["later"], lambda e: place(e) >= x["fresh"])
        ),
    )
    edited = edited.select(*_ORDER, "n_chars", "entries", "next_entries", F.sha2("edited", 256).alias("edited_sha256"), changed.alias("edited_entries"))
    found = edited.select(
        *_ORDER,
        F.when(~F.col("missing"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        spelled(F.col("entries")).alias("fingerprint"),
        spelled(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(hashes_of(F.col("entries")), hashes_of(F.col("edited_entries"))).alias("near_edited"),
        likeness(hashes_of(F.col("entries")), hashes_of(F.col("next_entries"))).alias("near_next"),
    )
    if again is not None:
        found = found.join(again, list(_ORDER), "left")
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1))))).drop("copies", "copy")
    return found.drop(*_ORDER)

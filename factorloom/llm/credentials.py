r"""Secret scan with linking of multipart credentials.

Three base kinds are reported wherever they match: assignments to a secret's name, access
identifiers and long hexadecimal runs. Weak candidates (an endpoint, a short access identifier,
a bare mixed string) are common in clean text; each has a scope, the reach in code points
around it, and is reported only if a complementary part lies within that scope: an endpoint
needs an identifier or a secret, an identifier needs a secret, a bare secret needs an
identifier or an endpoint. The intervals meet in an equi-join on (row, cell of the text); a
semi-join keeps each weak part once however many partners it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import stored

#: Most code points between two parts that belong together.
REACH = 200

#: The kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = re.compile(
    "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z]{3}[A-Z0-9]{9,}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{24,}(?![A-Za-z0-9+/])")
_ENDPOINT = re.compile(r"\b(?:https?|ftp|postgres|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+")

#: What may complete a weak part, by its kind.
COMPLEMENT = {
    "id": ("secret", "assign", "hex"),
    "secret": ("id", "access", "endpoint"),
    "endpoint": ("id", "secret", "access", "assign", "hex"),
}


def parts(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base and weak parts of a text; weak parts inside a base one are left out."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = sorted(x[1:] for x in found)
    weak = [("id", *m.span()) for m in _ID.finditer(text)]
    weak += [("secret", *m.span()) for m in _SECRET.finditer(text)]
    weak += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return found + _outside(weak, base)


def _outside(weak: list[tuple[str, int, int]], base: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that do not touch a base part."""
    kept, i, reach = [], 0, -1
    for kind, a, b in sorted(weak, key=lambda x: (x[1], x[2])):
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][1])
            i += 1
        if reach <= a:
            kept.append((kind, a, b))
    return kept


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


_PARTS = "kind string, start long, stop long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are in code points, end exclusive, of the whole match; `spans` lists base parts and the
    weak parts that found a complement within `reach`. Null texts count as empty: no span, and
    base_sha256 is that of the empty string. Rows are told apart by a number of their own, so
    repeated and null ids are fine; only the two named columns are read. An empty table gives
    an empty result. Writes the found parts once to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parts(t) if t else [] for t in batch.column(2).to_pylist()]
            base = [[p for p in f if p[0] in KINDS[:3]] for f in found]
            weak = [any(p[0] in COMPLEMENT for p in f) and len(f) > 1 for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            listed = [[dict(zip(("kind", "start", "stop"), p, strict=True)) for p in f] if w else None for f, w in zip(found, weak, strict=True)]
            joined = [_joined(b) for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *[pa.array([sum(p[0] == k for p in b) for b in base], pa.int64()) for k in KINDS[:3]],
                    pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array(joined, pa.string()),
                    pa.array(listed, kind),
                ],
                names=["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    id_type = numbered.schema["doc_id"].dataType.simpleString()
    found = stored(
        numbered.mapInArrow(
            run,
            f"row long, doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<{_PARTS.replace(' ', ':').replace(',:', ',')}>>",
        ),
        "parts",
    )
    linked = link(found.where("parts IS NOT NULL").select("row", F.explode("parts").alias("p")).select("row", "p.*"), reach)
    listed = linked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("weak"))
    order = F.array(*[F.lit(k) for k in KINDS])
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    added = F.transform(F.coalesce("weak", F.array().cast(f"array<struct<{_PARTS.replace(' ', ':').replace(',:', ',')}>>")), lambda p: F.concat_ws(":", p["kind"], p["start"], p["stop"]))

    def key(s):
        at = F.split(s, ":")
        return F.struct(at[1].cast("long").alias("a"), F.array_position(order, at[0]).alias("k"), at[2].cast("long").alias("b"), s.alias("s"))

    spans = F.array_join(F.transform(F.array_sort(F.transform(F.concat(base, added), key)), lambda x: x["s"]), ",")
    joined = found.drop("parts").join(listed, "row", "left")
    return joined.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.when(F.col("weak").isNull(), F.col("base")).otherwise(spans).alias("spans"),
        F.coalesce(F.size("weak"), F.lit(0)).cast("long").alias("n_linked"),
    ).withColumn("n_linked", F.when(F.col("n_linked") < 0, 0).otherwise(F.col("n_linked")))


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts (row, kind, start, stop) with a complement in the same row within `reach`.

    A part's scope covers the cells of `reach` code points from the one before its start to the
    one after its end, so every partner within reach shares the cell of its own start with it.
    """
    cell = F.floor(F.col("start") / reach)
    partners = found.select(
        F.col("row").alias("p_row"), F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"),
        F.explode(F.sequence(cell, F.floor(F.col("stop") / reach))).alias("p_cell"),
    ).distinct()
    weak = found.where(F.col("kind").isin(*COMPLEMENT)).withColumn(
        "cell", F.explode(F.sequence(cell - 1, F.floor(F.col("stop") / reach) + 1))
    )
    fits = F.lit(False)
    for kind, others in COMPLEMENT.items():
        fits = fits | ((F.col("kind") == kind) & F.col("p_kind").isin(*others))
    near = (F.col("p_start") - F.col("stop") <= reach) & (F.col("start") - F.col("p_stop") <= reach)
    met = weak.join(partners, (F.col("row") == F.col("p_row")) & (F.col("cell") == F.col("p_cell")) & fits & near, "left_semi")
    return met.select("row", "kind", "start", "stop").distinct()

"""Token ids as Arrow files of equal-length sequences.

Documents are encoded in ascending id order, each followed by the end id, and the ids of a
shard are packed without gaps into sequences of `length`. A shard is an Arrow file in the
random-access format whose record batches have fixed-size-list columns:

* ``ids``: the token ids (16 bits if the vocabulary allows),
* ``valid``: false for the padding that fills the last sequence of a shard,
* ``ends``: true for the end id of a document.

All batches but the last have the same number of sequences, so sequence i is row i % rows of
batch i // rows, a view into the mapped file without a copy. A second Arrow file beside it
lists the shard's document ids in order. Shard files are written under a name of the task
attempt and renamed when whole, so a lost executor leaves no half file under a final name.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import scratch_path, shuffle_partitions, stored
from factorloom.llm.text import slices

END_ID = 2
LENGTH = 2048
BATCH_ROWS = 256

#: Bytes of text that a task encodes at once (a longer single text is encoded alone).
_BYTES_AT_ONCE = 8 << 20

#: Words whose ids a worker keeps between slices; beyond it they are forgotten and learned anew.
_KEPT_WORDS = 300_000

MANIFEST = "part int, file string, docs long, tokens long, sequences long"


#: Lower-casing maps each of these letters to one letter, in any place of a word.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_PROBES = ["a", "Zürich", "garçon", "ÀÖØöøÿ", "thbleou", "x" * 40, "straße", "Don", "s"]


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(vocabulary)


class Encoder:
    """Ids of whole texts, equal to those of the library for the texts as they are.

    If the pre-tokenizer drops white space and parts letters from marks, no token reaches over
    a blank or from a letter to a mark: the ids of a text are those of its pieces in order,
    and each distinct piece of a slice of texts is encoded once. If besides every token that
    ends a word is marked, pieces of plain letters are encoded some dozens in a text and parted
    at the marks. Both are found out by trial on the vocabulary; if a trial fails, texts are
    encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.full = Tokenizer.from_file(vocabulary)
        self.dtype = np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32
        self.words: dict[str, bytes] = {}
        self.plain = Tokenizer.from_file(vocabulary)
        self.plain.normalizer = normalizers.Sequence([])
        names = self.full.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(names.values()) + 1 + len(self.full.get_added_tokens_decoder()), bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.by_piece, self.by_word = True, bool(self.closes.any())
        self.by_piece = all(self._agrees(w + t + u) for w in _PROBES for t in ("", ".", ",;", "?!", " \n\n ") for u in ("", " a", "b:"))
        if not self.by_piece and self.by_word:
            self.by_word, self.by_piece = False, True
            self.by_piece = all(self._agrees(w + t) for w in _PROBES for t in ("", ".", " \n\n b"))

    def _agrees(self, text: str) -> bool:
        return next(self(pa.array([text]))).tolist() == self.full.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encode lower-cased words of plain letters, some dozens in a text."""
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        encoded = self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.dtype)
            stops = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(stops) != len(group):
                for word in group:
                    self.words[word] = np.array(self.full.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
                continue
            raw, size, first = ids.tobytes(), ids.itemsize, 0
            for word, stop in zip(group, stops, strict=True):
                self.words[word] = raw[first * size : stop * size]
                first = stop

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, first id of each piece, number of ids of each piece)."""
        if len(self.words) > _KEPT_WORDS:
            self.words.clear()
        plain = _PLAIN.fullmatch if self.by_word else lambda p: None
        lowered = [p.lower() if plain(p) else None for p in pieces]
        self._learn(list({w for w in lowered if w is not None}.difference(self.words)))
        other = [p for p, w in zip(pieces, lowered, strict=True) if w is None]
        rest = iter(self.full.encode_batch_fast(other, add_special_tokens=False))
        known = self.words
        found = [known[w] if w is not None else np.array(next(rest).ids, self.dtype).tobytes() for w in lowered]
        length = np.fromiter(map(len, found), np.int32, len(found)) // np.dtype(self.dtype).itemsize
        return np.frombuffer(b"".join(found), self.dtype), np.cumsum(length, dtype=np.int32) - length, length

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_piece:
            for e in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, dtype=self.dtype)
            return
        parted = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), f"([{_LETTERS}])([.,;:!?])", r"\1 \2")
        lists = pc.split_pattern(parted, " ")
        encoded = lists.flatten().dictionary_encode()
        ids, start, length = self._pieces(encoded.dictionary.to_pylist())
        piece = encoded.indices.to_numpy()
        number = length[piece]
        after = np.cumsum(number)
        shift = (start[piece] - after + number).astype(np.int32)
        flat = ids[np.repeat(shift, number) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)]
        bounds = np.concatenate([[0], after])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        for i in range(len(texts)):
            yield flat[bounds[i] : bounds[i + 1]]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    found, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return (pafs.LocalFileSystem(use_mmap=True), inner) if isinstance(found, pafs.LocalFileSystem) else (found, inner)


def _schema(dtype, length: int) -> pa.Schema:
    kinds = (("ids", pa.from_numpy_dtype(dtype)), ("valid", pa.bool_()), ("ends", pa.bool_()))
    return pa.schema([(name, pa.list_(kind, length)) for name, kind in kinds])


_INDEX = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])


class _Packer:
    """Fills sequences and writes a batch whenever `rows` of them are full."""

    def __init__(self, writer, schema: pa.Schema, dtype, length: int, rows: int):
        self.writer, self.schema, self.length = writer, schema, length
        self.ids = np.zeros(length * rows, dtype)
        self.ends = np.zeros(length * rows, bool)
        self.used, self.sequences = 0, 0

    def add(self, ids: np.ndarray, end: bool) -> None:
        while len(ids):
            part = ids[: len(self.ids) - self.used]
            self.ids[self.used : self.used + len(part)] = part
            self.used += len(part)
            ids = ids[len(part) :]
            if end and not len(ids):
                self.ends[self.used - 1] = True
            if self.used == len(self.ids):
                self.flush()

    def flush(self) -> None:
        rows = -(-self.used // self.length)
        if not rows:
            return
        size = rows * self.length
        self.ids[self.used : size] = 0
        columns = (self.ids[:size], np.arange(size) < self.used, self.ends[:size])
        self.writer.write_batch(
            pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns], schema=self.schema
            )
        )
        self.sequences += rows
        self.used = 0
        self.ends[:] = False


def write_sequences(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_id: int = END_ID,
    length: int = LENGTH,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """Write `docs` as shards below the shared folder `path`; returns the manifest, one row a shard.

    Null texts count as empty and give the end id alone; null ids come first; rows that repeat
    an id follow each other by text. Only the two named columns are read. An empty table gives
    no shard and an empty manifest. `path` may be a local path that all machines share or any
    location that Arrow's file systems open. Runs the write.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, root = _filesystem(path)
        files.create_dir(root, recursive=True)
        final = [f"{root}/shard-{part:06d}{kind}.arrow" for kind in ("", "-docs")]
        encode = encoder(vocabulary)
        schema = _schema(encode.dtype, length)
        opened = None
        end = np.array([end_id], encode.dtype)
        n_docs = n_tokens = 0
        for batch in batches:
            for first, stop, _, _ in slices(batch.column(1), _BYTES_AT_ONCE):
                some = batch.slice(first, stop - first)
                if opened is None:
                    temp = [f"{root}/.{attempt}-{part:06d}{kind}" for kind in ("", "-docs")]
                    streams = [files.open_output_stream(t) for t in temp]
                    opened = [pa.ipc.new_file(streams[0], schema), pa.ipc.new_file(streams[1], _INDEX)]
                    packer = _Packer(opened[0], schema, encode.dtype, length, rows)
                lengths = []
                for ids in encode(some.column(1)):
                    packer.add(ids, False)
                    packer.add(end, True)
                    lengths.append(len(ids) + 1)
                opened[1].write_batch(
                    pa.record_batch([some.column(0).cast(pa.int64()), pa.array(lengths, pa.int64())], schema=_INDEX)
                )
                n_docs, n_tokens = n_docs + len(lengths), n_tokens + sum(lengths)
        if opened is None:
            return
        packer.flush()
        for writer, stream, a, b in zip(opened, streams, temp, final, strict=True):
            writer.close()
            stream.close()
            files.move(a, b)
        row = {"part": [part], "file": [final[0].rpartition("/")[2]], "docs": [n_docs], "tokens": [n_tokens], "sequences": [packer.sequences]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), *[(c, pa.int64()) for c in ("docs", "tokens", "sequences")]]))

    ordered = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


class Shard:
    """Random access to the sequences of one shard: ``shard[i]`` is (ids, valid, ends), views of the file."""

    def __init__(self, path: str, file: str):
        files, root = _filesystem(path)
        self.reader = pa.ipc.open_file(files.open_input_file(f"{root}/{file}"))
        self.docs = pa.ipc.open_file(files.open_input_file(f"{root}/{file.removesuffix('.arrow')}-docs.arrow"))
        self.rows = self.reader.get_batch(0).num_rows

    def __getitem__(self, i: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        batch = self.reader.get_batch(i // self.rows)
        return tuple(batch.column(c)[i % self.rows].values for c in range(3))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of each batch without the padding."""
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            ids = batch.column(0).values.to_numpy()
            valid, ends = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (1, 2))
            yield ids[valid], ends[valid]


def read_documents(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, file.

    `start` counts the ids of all documents before it over all shards. Each task reads whole
    shards one batch at a time; only the manifest (one row a shard) is summed in one place.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            shard = Shard(path, row["file"])
            found = (d for i in range(shard.docs.num_record_batches) for d in shard.docs.get_batch(i).column(0).to_pylist())
            start, n, crc, out = row["before"], 0, 0, []
            for ids, ends in shard.batches():
                raw = memoryview(ids.astype("<u4").tobytes())
                last = 0
                for stop in np.flatnonzero(ends) + 1:
                    crc = zlib.crc32(raw[4 * last : 4 * int(stop)], crc)
                    n += int(stop) - last
                    out.append((next(found), start, n, crc, row["file"]))
                    start, n, crc, last = start + n, 0, 0, int(stop)
                crc = zlib.crc32(raw[4 * last :], crc)
                n += len(ids) - last
                yield _documents(out)
                out = []

    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    spread = placed.repartition(shuffle_partitions(manifest.sparkSession), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())]
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


def tokenized(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write `docs` to a fresh folder below the shared one and read the documents back."""
    path = scratch_path(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, path, vocabulary, **options), path)

"""Repeated lines are dropped by a sharded minimal perfect hash: documents probe compact arrays, lines are never joined.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; it is named by 128 bits of BLAKE2. One exchange of
partial (hash, documents, largest id) rows counts every key of at least `min_chars` code points. The keys found in at least
`min_docs` documents are dealt by hash into shards of about `SHARD_KEYS`. For each shard a task builds a minimal perfect hash by levels of bit
arrays (a key stays on the first level where it is alone in its cell; its index is the number of set bits before it), and in the order of
that index three arrays: 64-bit fingerprints, document counts and largest ids. A key that is in no array is found out by its
fingerprint: cell and fingerprint agree by chance once in 2**64 probes. Keys below `min_docs` need no place, as all their lines stay.

The size of the index is known before it is sent. Up to `BROADCAST_BYTES` it is broadcast. A larger one is written one shard a file to the
shared folder and given to `SparkContext.addFile`, so that Spark brings it to every executor, also to one that replaces a lost one;
a Python worker then holds at most `CACHE_BYTES` of shards and visits them in order, once per run of documents. Those files must stay for as long as the session
lives. Both ways give the same rows. The documents themselves are read twice and never shuffled.

Defined results: a row is a document; a null text is empty; an empty text is one empty line; a null key counts as the smallest long; rows
that share the largest id holding a line all keep it; a line's copies within one document share its fate; texts of any
length are read whole; an empty table gives an empty result. Only the key (a whole number) and the text are read; other columns, whatever their names, play no
part. Texts are handled as bytes, so malformed UTF-8 survives.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefusion.llm.storage import shared_folder, stored
from framefusion.llm.text_hash import mix

SPACES = b" \t\n\v\f\r"
GAMMA = 2.0
SHARD_KEYS, BROADCAST_BYTES, CACHE_BYTES = 1 << 20, 64 << 20, 256 << 20
FLUSH_ROWS, RUN_BYTES = 1 << 19, 8 << 20
# Bytes of a key in the index: fingerprint, count, id, and six bits of bit arrays with their ranks.
KEY_BYTES = 8 + 4 + 8 + 1
NO_KEY = -(1 << 63)

_CONTINUATION = bytes(range(0x80, 0xC0))
_STEP = 0xD1B54A32D192ED03
_PAIR = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None if the key has fewer than `min_chars` code points."""
    key = line.strip(SPACES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.translate(None, _CONTINUATION)) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _cells(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64(level * _STEP % 2 ** 64)
    return (mix(h1.view(np.uint64) + mix(h2.view(np.uint64) ^ seed)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Distinct keys to 0..n-1: bit arrays of all levels, one after the other, and the set bits before each word."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            size = -(-int(GAMMA * len(h1) + 1) // 64) * 64
            cells = _cells(h1, h2, len(sizes), size)
            alone = np.bincount(cells, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[cells]
            h1, h2 = h1[left], h2[left]
        return cls.of(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @classmethod
    def of(cls, sizes: np.ndarray, words: np.ndarray) -> PerfectHash:
        ranks = np.zeros(len(words) + 1, np.int32)
        np.cumsum(np.bitwise_count(words), out=ranks[1:])
        return cls(sizes, words, ranks)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each key; some index or -1 for a key that was not there at the building."""
        out = np.full(len(h1), -1, np.int64)
        left, start = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            cells = start + _cells(h1[left], h2[left], level, size)
            word, bit = self.words[cells >> 6], (cells & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[cells >> 6] + before)[hit]
            left = left[~hit]
            if not len(left):
                break
            start += int(size)
        return out


@dataclass
class Shard:
    """The arrays of one shard in the order of its perfect hash."""

    hash: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        at = {k: np.frombuffer(row[k], kind) for k, kind in
              (("sizes", "<i8"), ("words", "<u8"), ("fingerprints", "<i8"), ("counts", "<i4"), ("last", "<i8"))}
        return cls(PerfectHash.of(at["sizes"], at["words"]), at["fingerprints"], at["counts"], at["last"])

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.hash.words, self.hash.ranks, self.fingerprints, self.counts, self.last))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest id) of every key; 0 documents for a key that is not in the shard."""
        at = self.hash.places(h1, h2)
        there = at >= 0
        there[there] = self.fingerprints[at[there]] == h2[there]
        counts, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        counts[there], last[there] = self.counts[at[there]], self.last[at[there]]
        return counts, last


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """As Spark's pmod(h1, shards)."""
    return np.mod(h1, np.int64(shards))


def _picked(docs: DataFrame, key: str, text: str) -> DataFrame:
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"the key {key} must be a whole number")
    return docs.select(F.coalesce(docs[f"`{key}`"].cast("long"), F.lit(NO_KEY)).alias("id"), docs[f"`{text}`"].cast("string").alias("text"))


def line_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(h1, h2, docs, last): the keys found in at least `min_docs` documents, with the largest id that holds each."""

    def combined(hashes: list[bytes], ids: list[int]) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(hashes), _PAIR)
        order = np.argsort(pairs, order=("h1", "h2"))
        pairs, held = pairs[order], np.array(ids, np.int64)[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs["h1"][first]), pa.array(pairs["h2"][first]), pa.array(np.diff(np.append(first, len(pairs)))),
             pa.array(np.maximum.reduceat(held, first))], ["h1", "h2", "docs", "last"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[bytes] = []
        ids: list[int] = []
        for batch in batches:
            for number, cell in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                mine = {line_key(line, min_chars) for line in (cell.as_py() or b"").split(b"\n")} - {None}
                hashes += mine
                ids += [number] * len(mine)
                if len(hashes) > FLUSH_ROWS:
                    yield combined(hashes, ids)
                    hashes, ids = [], []
        if hashes:
            yield combined(hashes, ids)

    partial = _picked(docs, key, text).mapInArrow(count, "h1 long, h2 long, docs long, last long")
    return partial.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")).where(F.col("docs") >= min_docs)


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its number, keys, and the arrays as bytes."""

    def build(number: tuple, rows: pa.Table) -> pa.Table:
        h1, h2, docs, last = (rows[c].to_numpy() for c in ("h1", "h2", "docs", "last"))
        found = PerfectHash.build(h1, h2)
        order = np.argsort(found.places(h1, h2))
        cells = {"sizes": found.sizes, "words": found.words, "fingerprints": h2[order],
                 "counts": np.minimum(docs, 2 ** 31 - 1).astype(np.int32)[order], "last": last[order]}
        return pa.table({"shard": pa.array([number[0].as_py()], pa.int64()), "keys": pa.array([len(h1)], pa.int64()),
                         **{k: pa.array([v.tobytes()], pa.binary()) for k, v in cells.items()}})

    dealt = counts.withColumn("shard", F.pmod("h1", F.lit(shards)))
    arrays = ", ".join(f"{c} binary" for c in ("sizes", "words", "fingerprints", "counts", "last"))
    return dealt.groupBy("shard").applyInArrow(build, f"shard long, keys long, {arrays}")


_held: OrderedDict[tuple[str, int], Shard] = OrderedDict()


@dataclass
class LineIndex:
    """An index as the workers see it: the rows of all shards in a broadcast, or a file of each shard by its name."""

    name: str
    shards: int
    sent: object = None
    files: dict[int, str] | None = None

    def shard(self, number: int) -> Shard | None:
        """A shard, kept by the worker while all it keeps is within CACHE_BYTES."""
        at = (self.name, number)
        if at not in _held:
            if self.files is None:
                row = self.sent.value.get(number)
            else:
                name = self.files.get(number)
                row = pq.read_table(SparkFiles.get(name), partitioning=None).to_pylist()[0] if name else None
            if row is None:
                return None
            _held[at] = Shard.of(row)
            while len(_held) > 1 and sum(s.size for s in _held.values()) > CACHE_BYTES:
                _held.popitem(last=False)
        _held.move_to_end(at)
        return _held[at]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        if not self.shards or not len(h1):
            return counts, last
        numbers = _shard_of(h1, self.shards)
        order = np.argsort(numbers, kind="stable")
        first = np.flatnonzero(np.append(True, numbers[order][1:] != numbers[order][:-1]))
        for some in np.split(order, first[1:]):
            if (shard := self.shard(int(numbers[some[0]]))) is not None:
                counts[some], last[some] = shard.find(h1[some], h2[some])
        return counts, last


def line_index(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> LineIndex:
    """Count the lines of all documents and build the index of those that repeat."""
    spark = docs.sparkSession
    counts = stored(line_counts(docs, key, text, min_docs, min_chars), "line-counts")
    keys = counts.count()
    shards = -(-keys // SHARD_KEYS)
    if not shards:
        return LineIndex("none", 0)
    if keys * KEY_BYTES <= BROADCAST_BYTES:
        built = stored(build_shards(counts, shards), "line-index")
        rows = {row["shard"]: row for row in built.toArrow().to_pylist()}
        return LineIndex(built.inputFiles()[0], shards, sent=spark.sparkContext.broadcast(rows))
    path = f"{shared_folder(spark).rstrip('/')}/framefusion/line-index-{hashlib.sha256(repr(counts.inputFiles()).encode()).hexdigest()[:32]}"
    built = build_shards(counts, shards)
    built.write.option("maxRecordsPerFile", 1).parquet(path)
    files = {}
    for number, name in spark.read.schema(built.schema).parquet(path).select("shard", F.input_file_name()).collect():
        spark.sparkContext.addFile(name)
        files[number] = name.rsplit("/", 1)[1]
    return LineIndex(path, shards, files=files)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of about RUN_BYTES at a time."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for number, cell in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            ids.append(number)
            texts.append(cell.as_py() or b"")
            size += len(texts[-1])
            if size > RUN_BYTES or len(ids) >= 10_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _probe(index: LineIndex, min_docs: int, min_chars: int) -> Callable:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            lines = [text.split(b"\n") for text in texts]
            hashes, where = [], []
            for at, mine in enumerate(lines):
                for k, line in enumerate(mine):
                    h = line_key(line, min_chars)
                    if h is not None:
                        hashes.append(h)
                        where.append((at, k))
            pairs = np.frombuffer(b"".join(hashes), _PAIR)
            counts, last = index.find(np.ascontiguousarray(pairs["h1"]), np.ascontiguousarray(pairs["h2"]))
            own = np.array(ids, np.int64)[[at for at, _ in where]] if where else np.zeros(0, np.int64)
            gone: dict[int, set[int]] = {}
            for i in np.flatnonzero((counts >= min_docs) & (last != own)):
                at, k = where[i]
                gone.setdefault(at, set()).add(k)
            kept = [b"\n".join([line for k, line in enumerate(mine) if k not in gone[at]]) if at in gone else texts[at]
                    for at, mine in enumerate(lines)]
            raw = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(x) for x in lines], pa.int64()),
                 pa.array([len(gone.get(at, ())) for at in range(len(lines))], pa.int64()),
                 pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2])], ["id", "n_lines", "n_dropped", "kept"])

    return probe


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """One row per document: the key, `n_lines` before dropping, `n_dropped`, and the lines that stay as `kept`."""
    index = line_index(docs, key, text, min_docs, min_chars)
    out = _picked(docs, key, text).mapInArrow(_probe(index, min_docs, min_chars), "id long, n_lines long, n_dropped long, kept string")
    kind = docs.schema[key].dataType.simpleString()
    return out.select(F.when(F.col("id") != NO_KEY, F.col("id")).cast(kind).alias(key), "n_lines", "n_dropped", "kept")

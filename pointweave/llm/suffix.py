"""Removal of repeated byte strings by sparse, distributed prefix doubling.

Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id goes. Strings are judged on
the input and never cross documents.

Ranking all positions at doubling offsets would shuffle a (position, rank) pair of 16 bytes or more for every text byte
and round. Here the positions are sampled without loss first: each 50-byte window keeps the position of its least 20-byte
hash (a minimizer), so equal windows keep equal positions, about one in 16. Their rank pairs are then shuffled in sorted
blocks and reranked over growing lengths, and a rank that has become unique leaves:

1. length 20: the anchors' prefixes, with (2.) the length that spans all windows of the anchor (up to 80 bytes). An anchor
   whose prefix is unique is done. If a smaller document holds the whole span, all its windows are removed.
3. length 50, the threshold: windows of anchors whose prefix is shared but whose spans differ (passage borders), one copy
   of each distinct span.

Documents lie in chunks of about ``CHUNK_BYTES`` in a table bucketed by chunk, so no round shuffles text. What a chunk
asks is combined within the chunk first: copies inside one chunk cost one entry.

Null text counts as empty. A row without doc_id is no smaller than any other and nothing is removed from others for it.
Rows that share a doc_id do not remove each other's bytes. Other columns do not matter. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches, materialize, scratch_dir, trim
from pointweave.llm.wordhash import mix, powers, slices

SPAN, K = 50, 20
W = SPAN - K + 1
CHUNK_BYTES = 2 << 20
#: Bytes whose hashes are held at a time.
SEGMENT = 1 << 18
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 50_000
#: Text bytes whose anchors one reranking task gets.
RANGE_BYTES, LEAST_RANGES = 4 << 20, 64

_U = np.uint64
_AT = _U((1 << 28) - 1)
_NO_ID = np.iinfo(np.int64).max


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns as compressed byte planes."""
    return zstandard.ZstdCompressor(1).compress(b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n_columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").reshape(-1) for c in raw]


# Chunks


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)
    ids, sizes, data, held = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        nonlocal k, held
        row = [(part << 32) + k, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), squeeze.compress(b"".join(data))]
        k, held = k + 1, 0
        for x in (ids, sizes, data):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["chunk", "ids", "sizes", "data"])

    for batch in batches:
        keys = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, own, bounds in slices(batch.column(1)):
            ids.append(keys[lo : lo + len(bounds) - 1])
            sizes.append(np.diff(bounds))
            data.append(own.tobytes())
            held += len(own) + 8 * len(bounds)
            if held >= CHUNK_BYTES:
                yield chunk()
    if ids:
        yield chunk()


class Chunk:
    """Documents of a chunk and their anchors."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        self.raw = zstandard.ZstdDecompressor().decompress(data)
        self.data = np.frombuffer(self.raw, np.uint8)
        parts = [self._anchors(lo, min(lo + SEGMENT, len(self.data))) for lo in range(0, len(self.data), SEGMENT)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, _U)] * 2
        self.lo, self.hi, self.prefix, self.span = cols  # first and last window start, ranks
        self.doc = self.ids[np.searchsorted(self.bounds, self.lo, "right") - 1] if len(self.lo) else np.zeros(0, np.int64)
        self.order = np.lexsort((self.doc, self.span, self.prefix))
        p, s = self.prefix[self.order], self.span[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])) if len(p) else np.zeros(0, np.int64)
        #: of every anchor: its entry, that is its distinct (prefix, span), in sorted order
        self.entry = np.zeros(len(p), np.int64)
        if len(p):
            self.entry[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(p))))

    def _sums(self, lo: int, hi: int) -> np.ndarray:
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum((self.data[lo:hi].astype(_U) + _U(1)) * powers("up", hi - lo + 1)[: hi - lo], out=total[1:])
        return total

    def _anchors(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Anchors of the windows that start in [lo, hi): their window starts' range, prefix rank and span rank."""
        end = min(hi + SPAN - 1, len(self.data))
        n = end - lo
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
        if n < SPAN:
            return none
        a, b = self.bounds[:-1], self.bounds[1:] - SPAN + 1
        a, b = np.maximum(a, lo)[b > a], np.minimum(b, hi)[b > a]
        a, b = a[b > a] - lo, b[b > a] - lo
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]))
        if not len(starts):
            return none
        total, down = self._sums(lo, end), powers("down", n + 1)
        h = mix((total[K:] - total[:-K]) * down[: n - K + 1])
        key = (h & ~_AT) | np.arange(len(h), dtype=_U)
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: len(key) - (W - 16)], key[W - 16 :])
        at = (key[starts] & _AT).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        p, q, at = starts[first], starts[last], at[first]
        span = (total[q + SPAN] - total[p]) * down[p]
        span = mix(span + mix((q - p).astype(_U) * _U(64) + (at - p).astype(_U)))
        return p + lo, q + lo, h[at], span

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries: prefix rank, span rank, least doc_id."""
        rows = self.order[self.first]
        return self.prefix[rows], self.span[rows], self.doc[rows]

    def windows(self, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, ranks at length 50 and doc_ids of the least document's anchors of the open entries."""
        least = self.doc[self.order[self.first]] if len(self.first) else self.doc
        own = np.flatnonzero(is_open[self.entry] & (self.doc == least[self.entry])) if len(self.entry) else np.zeros(0, np.int64)
        counts = self.hi[own] - self.lo[own] + 1
        start = np.repeat(self.lo[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rank = np.zeros(len(start), _U)
        for lo in range(0, len(self.data), SEGMENT):
            here = (start >= lo) & (start < lo + SEGMENT)
            if here.any():
                total = self._sums(lo, min(lo + SEGMENT + SPAN, len(self.data)))
                p = start[here] - lo
                rank[here] = mix((total[p + SPAN] - total[p]) * powers("down", len(total))[p])
        return start, rank, np.repeat(self.doc[own], counts)


def _window_entries(rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by (rank, doc), and the first of each distinct pair in it."""
    order = np.lexsort((doc, rank))
    r, d = rank[order], doc[order]
    return order, np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])])) if len(r) else np.zeros(0, np.int64)


# Rounds

_BLOCKS = "range int, chunk long, blob binary"
_ANSWERS = "chunk long, round int, range int, blob binary"


def _cut(rank: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of each range in sorted ranks."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], _U)
    return np.concatenate([[0], np.searchsorted(rank, edges), [len(rank)]])


def _blocks(chunk: int, ranges: int, rank: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    cut = _cut(rank, ranges)
    own = [r for r in range(ranges) if cut[r + 1] > cut[r]]
    blobs = [pack(*(c[cut[r] : cut[r + 1]] for c in (rank, *columns))) for r in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([chunk] * len(own), pa.int64()), pa.array(blobs, pa.binary())], ["range", "chunk", "blob"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            trim()


def _ask_anchors(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            prefix, span, doc = Chunk(row["ids"], row["sizes"], row["data"]).asked()
            yield _blocks(row["chunk"], ranges, prefix, span & _U((1 << 48) - 1), doc.view(_U))

    return run


def _answer(pdf: pd.DataFrame, n: int, round_: int, rerank) -> pd.DataFrame:
    parts = [unpack(b, n) for b in pdf["blob"]]
    sizes = [len(p[0]) for p in parts]
    out = rerank(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    rows = [(c, round_, r, zstandard.ZstdCompressor(1).compress(x.tobytes())) for c, r, x in zip(pdf["chunk"], pdf["range"], np.split(out, np.cumsum(sizes)[:-1]), strict=True) if x.any()]
    del parts, out
    trim()
    return pd.DataFrame(rows, columns=["chunk", "round", "range", "blob"])


def _rerank_anchors(prefix: np.ndarray, span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per entry: 1 if a smaller document holds its span, 2 if its windows have to be ranked one by one."""
    doc = doc.view(np.int64)
    order = np.lexsort((doc, span, prefix))
    p, s, d = prefix[order], span[order], doc[order]
    new_p = np.concatenate([[True], p[1:] != p[:-1]])
    new_s = new_p | np.concatenate([[True], s[1:] != s[:-1]])
    at_s, at_p = np.flatnonzero(new_s), np.flatnonzero(new_p)
    least = np.repeat(d[at_s], np.diff(np.append(at_s, len(d))))
    rep = d[at_s]  # least document of each distinct span
    group = np.cumsum(new_p[at_s]) - 1  # prefix of each span
    begin = np.flatnonzero(new_p[at_s])
    mixed = np.maximum.reduceat(rep, begin) > np.minimum.reduceat(rep, begin)
    is_open = np.repeat(mixed[group], np.diff(np.append(at_s, len(d)))) & (d == least)
    out = np.zeros(len(d), np.uint8)
    out[order] = (least < d) + 2 * is_open
    assert len(at_p) == len(begin)
    return out


def _rerank_windows(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per entry: 1 if a smaller document holds the window."""
    doc = doc.view(np.int64)
    order = np.lexsort((doc, rank))
    r, d = rank[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    out = np.zeros(len(d), np.uint8)
    out[order] = np.repeat(d[first], np.diff(np.append(first, len(d)))) < d
    return out


def _told(answers: list | None, round_: int, rank: np.ndarray, ranges: int) -> np.ndarray:
    """The answers to sorted entries, range by range."""
    out, cut = np.zeros(len(rank), np.uint8), _cut(rank, ranges)
    for a in answers or []:
        if a["round"] == round_:
            out[cut[a["range"]] : cut[a["range"] + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(a["blob"]), np.uint8)
    return out


def _ask_windows(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row["ids"], row["sizes"], row["data"])
            told = _told(row["answers"], 1, chunk.asked()[0], ranges)
            _, rank, doc = chunk.windows((told & 2) > 0)
            if len(rank):
                order, first = _window_entries(rank, doc)
                own = order[first]
                yield _blocks(row["chunk"], ranges, rank[own], doc[own].view(_U))

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row["ids"], row["sizes"], row["data"])
            prefix, _, least = chunk.asked()
            told = _told(row["answers"], 1, prefix, ranges)
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            if len(chunk.entry):
                whole = ((told & 1) > 0)[chunk.entry] | (chunk.doc > least[chunk.entry])
                np.add.at(edge, chunk.lo[whole], 1)
                np.add.at(edge, chunk.hi[whole] + SPAN, -1)
            start, rank, doc = chunk.windows((told & 2) > 0)
            if len(rank):
                order, first = _window_entries(rank, doc)
                gone = np.zeros(len(rank), bool)
                gone[order] = np.repeat(_told(row["answers"], 2, rank[order[first]], ranges) > 0, np.diff(np.append(first, len(rank))))
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, start[gone] + SPAN, -1)
            removed = np.cumsum(edge[:-1]) > 0
            out: list[list] = [[], [], [], [], []]
            for i, key in enumerate(chunk.ids):
                a, b = chunk.bounds[i], chunk.bounds[i + 1]
                own = removed[a:b]
                n = int(own.sum())
                kept = chunk.data[a:b][~own].tobytes() if n else chunk.raw[a:b]
                spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                for c, x in zip(out, (None if key == _NO_ID else int(key), int(b - a), n, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with their answers; only the answers are shuffled, as chunks lie in buckets."""
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("round", "range", "blob")).alias("answers"))
    return chunks.join(told.hint("shuffle_merge"), "chunk", "left").select("chunk", "ids", "sizes", "data", "answers")


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = df.sparkSession
    lean_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    buckets = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
    name = f"chunks_{uuid.uuid4().hex}"
    made = docs.mapInArrow(_chunks, "chunk long, ids binary, sizes binary, data binary")
    made.write.bucketBy(buckets, "chunk").format("parquet").option("compression", "none").option("path", f"{scratch_dir(spark)}/pointweave/{name}").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan holds the bucketed files, which stay

    asked = chunks.mapInArrow(_ask_anchors(ranges), _BLOCKS)
    first = materialize(asked.groupBy("range").applyInPandas(lambda pdf: _answer(pdf, 3, 1, _rerank_anchors), _ANSWERS), "answers")
    asked = _with_answers(chunks, first).mapInArrow(_ask_windows(ranges), _BLOCKS)
    second = materialize(asked.groupBy("range").applyInPandas(lambda pdf: _answer(pdf, 2, 2, _rerank_windows), _ANSWERS), "answers")
    return _with_answers(chunks, first.unionAll(second)).mapInArrow(_remove(ranges), _RESULT)

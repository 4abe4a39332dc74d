"""Best-fit packing of token pieces into sequences of bounded length.

The lengths' histogram (at most ``capacity`` rows) is all that reaches the driver. There a configuration linear program
is solved: a configuration is a multiset of lengths that fits one sequence, and every length must be covered as often as
it occurs. Multiplicative weights price the lengths (covered lengths get cheaper), an unbounded-knapsack dynamic program
finds the best configuration at these prices, and its use is rounded down to whole sequences. Rounds go on until
configurations hold ``COVERED`` of all tokens; what is left is placed by best fit, decreasing, first into the room that
the configurations have, in batches of equal bins.

The plan then goes back to the pieces: each piece is numbered among the pieces of its length (local number plus the
count in earlier partitions, so a very common length needs no single task) and looks its place up.

Null text is an empty document: one piece that holds the end id alone. Very long texts are cut into pieces, never
shortened. Repeated rows are packed as often as they occur; pieces of equal length may change places. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches, materialize, small

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a worker keeps at a time.
CACHED_WORDS = 1_400_000
#: Classes of lengths for pricing, the weights' rate, the most of a length that one step covers, and the share of the
#: tokens that configurations hold.
CLASSES, ETA, STEP, COVERED = 64, 4.0, 0.25, 0.97

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


class WordTokens:
    """Token ids of a text, by word: the tokenizer's rules never join text over ASCII white space.

    Words are folded to ASCII lower case first where that cannot change their ids: not where a special token's string or
    a combining mark may stand (some lower-case letters compose with marks that their capitals do not compose with).
    """

    SPECIAL, MARK = b"<|", "<|startoftext|>"
    WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(self.MARK)
        self.known: dict[bytes, bytes] = {}

    def words(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode().translate(self.WHITE)
        plain = self.SPECIAL not in raw and b"\xcc" not in raw and b"\xcd" not in raw
        return (raw.lower() if plain else raw).split(b" ")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, docs: list[list[bytes]]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list(set().union(*docs).difference(self.known))
        alone = [w for w in new if self.SPECIAL in w]
        self.known.update(zip(alone, (x.tobytes() for x in self._encode([w.decode() for w in alone])), strict=True))
        new = [w for w in new if self.SPECIAL not in w] if alone else new
        for i in range(0, len(new), 500):  # many words in one call, parted by a special token
            part = new[i : i + 500]
            (ids,) = self._encode([self.MARK.join(w.decode() for w in part) + self.MARK])
            raw, lo = ids.tobytes(), 0
            for w, end in zip(part, (4 * np.flatnonzero(ids == self.mark)).tolist(), strict=True):
                self.known[w] = raw[lo:end]
                lo = end + 4

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


@functools.cache
def shared_tokens(path: str) -> WordTokens:
    """One tokenizer, with its known words, for all tasks of a worker."""
    return WordTokens(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = shared_tokens(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                docs = [tokens.words(t) for t in texts.slice(lo, 256).to_pylist()]
                tokens.learn(docs)
                cols: list[list] = [[] for _ in range(7)]
                for key, words in zip(keys.slice(lo, 256).to_pylist(), docs, strict=True):
                    ids = tokens.ids(words) + END_ID.to_bytes(4, "little")
                    for k in range(0, len(ids), 4 * capacity):
                        own = ids[k : k + 4 * capacity]
                        n = len(own) // 4
                        for c, x in zip(cols, (key, k // (4 * capacity), k // 4, n, zlib.crc32(own), part, seen[n]), strict=True):
                            c.append(x)
                        seen[n] += 1
                types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> list[int]:
    """Unbounded knapsack: the multiset of items (their numbers) of greatest price that fits."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    least = int(sizes.min())
    order = np.argsort(sizes, kind="stable")
    prices, sizes = prices[order], sizes[order]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if c >= least:
            k = upto[c]
            total = best[c - sizes[:k]]
            total += prices[:k]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], took[c] = total[i], i
    out, c = [], capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out.append(int(order[took[c]]))
            c -= int(sizes[took[c]])
    return out


def cover(counts: np.ndarray, capacity: int, share: float = COVERED) -> dict[tuple, int]:
    """Configurations and how often each is used: whole sequences that hold ``share`` of the tokens or more.

    The covering program min sum(x), sum of x over configurations times their pieces >= counts, by multiplicative weights:
    a length's price is its size times exp(-ETA * the covered part of its class). Lengths are rounded up to classes of
    capacity / CLASSES tokens for pricing; in the best configuration each class then stands for its length with most pieces
    left, and the last one for the longest length with pieces left that still fits, so little of the sequence stays empty.
    A step uses the configuration as often as it covers no more than STEP of any length, rounded down to whole sequences
    (one at least). Every round covers some piece, so the rounds end.
    """
    left, used = counts.astype(np.int64).copy(), defaultdict(int)
    width = -(-capacity // CLASSES)
    lengths = np.arange(len(counts))
    of = -(-lengths // width)
    total = np.bincount(of, counts)
    tokens, goal = int((lengths * left).sum()), (1 - share) * float((lengths * counts).sum())
    while tokens > goal:
        own = np.bincount(of, left)
        open_ = np.flatnonzero(own)
        prices = open_ * np.exp(-ETA * (1 - own[open_] / total[open_]))
        config, room = Counter(), capacity
        for k in sorted((int(open_[i]) for i in best_configuration(prices, open_, capacity // width)), reverse=True):
            s = max(1, (k - 1) * width + 1)
            rest = left[s : k * width + 1] - [config[x] for x in range(s, min(k * width, capacity) + 1)]
            i = int(rest.argmax())
            if rest[i] > 0 and s + i <= room:
                config[s + i] += 1
                room -= s + i
        if config:  # the last length gives way to the longest that fits
            last = min(config)
            config[last] -= 1
            room += last
            config += Counter()
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])[::-1]
            s = next((int(x) for x in fits[: len(config) + 1] if left[x] > config[int(x)]), 0)
            if not s:
                break
            config[s] += 1
            room -= s
        times = min(max(1, int(counts[s] * STEP) // a) if left[s] >= a else 0 for s, a in config.items())
        times = min(times, *(int(left[s]) // a for s, a in config.items())) if times else 1
        used[tuple(sorted(config.items(), reverse=True))] += times
        for s, a in config.items():
            left[s] -= a * times
            tokens -= a * times * s
    return dict(used)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, first offset); one per length and group."""
    left = counts.astype(np.int64).copy()
    groups: list[tuple[dict[int, int], int]] = []  # lengths of a sequence, number of such sequences
    for config, n in cover(left, capacity).items():
        groups.append((dict(config), n))
        for s, a in config:
            left[s] -= a * n
    room: dict[int, list[int]] = defaultdict(list)  # free tokens -> groups
    for g, (config, _) in enumerate(groups):
        room[capacity - sum(s * a for s, a in config.items())].append(g)
    free = np.zeros(capacity + 1, bool)
    free[[r for r in room if room[r]]] = True
    for s in range(capacity, 0, -1):
        while left[s] > 0:
            fits = np.flatnonzero(free[s:])
            if len(fits):
                r = s + int(fits[0])
                g = room[r].pop()
                free[r] = bool(room[r])
                config, n = groups[g]
                take = int(min(n, left[s]))
                if take < n:
                    groups[g] = (config, n - take)
                    room[r].append(g)
                    free[r] = True
                    groups.append(({**config, s: config.get(s, 0) + 1}, take))
                    g = len(groups) - 1
                else:
                    groups[g] = ({**config, s: config.get(s, 0) + 1}, n)
                left[s] -= take
            else:
                per = int(min(capacity // s, left[s]))
                take = int(left[s] // per)
                groups.append(({s: per}, take))
                g, r = len(groups) - 1, capacity - s * per
                left[s] -= take * per
            r = capacity - sum(x * a for x, a in groups[g][0].items())
            room[r].append(g)
            free[r] = True
    runs, next_rank, sequence = [], Counter(), 0
    for config, n in groups:
        offset = 0
        for s, a in sorted(config.items(), reverse=True):
            runs.append((s, next_rank[s], a * n, sequence, a, offset))
            next_rank[s] += a * n
            offset += a * s
        sequence += n
    return runs


def _placer(runs: list[tuple]):
    """Looks places up by length and rank."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {int(s): i for s, i in zip(*np.unique(table[:, 0], return_index=True), strict=True)}
        ends = {int(s): i for s, i in zip(*np.unique(table[::-1, 0], return_index=True), strict=True)}
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for s in np.unique(length):
                lo, hi = starts[int(s)], len(table) - ends[int(s)]
                own = length == s
                at[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
            row = table[at]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 4], row[:, 5] + (k % row[:, 4]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    lean_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(tokenizer_path, capacity), PIECE_SCHEMA), "pieces")
    parts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(small(before, 40, parts.count()), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placer(plan(counts, capacity)), schema)

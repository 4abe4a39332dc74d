"""Language identification by prediction by partial matching.

Per language, a variable-order byte context tree with frozen statistics: a context of up to ``ORDER`` bytes that was seen
predicts a seen byte with count / (total + distinct), and escapes with distinct / (total + distinct) to the next shorter
context; below order 0 all 256 bytes are alike. The exact code length of a whole text under each tree is summed, and the
shortest wins. ``score`` is the winner's posterior under equal priors, from the difference of code lengths per byte
(times ``SHARPNESS``), so it does not saturate with length alone.

Trees learn from at most ``SAMPLE_DOCS`` documents a language and ``SAMPLE_BYTES`` bytes each language, whole documents
chosen by hash among rows with text and language (one document at least, however long); each tree keeps its
``MOST_CONTEXTS`` most frequent contexts of the highest order. Of more than ``MOST_LANGUAGES`` languages the rarer ones are
not learned and never predicted: this bounds the labelled rows, and with them the tables, which grow with the square of the
languages. Texts are scored whole, whatever their length; of languages with equal code lengths the first by name wins.

Null text, or text without a letter: ``und``, score 0. If nothing can be learned, every text is ``und``. Rows that share a
doc_id are predicted row by row. Other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches
from pointweave.llm.wordhash import slices

ORDER = 3
SAMPLE_DOCS, SAMPLE_BYTES = 600, 3 << 20
MOST_CONTEXTS = 6000
MOST_LANGUAGES = 200
SHARPNESS = 50.0


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


class Trees:
    """Code lengths in bits, as dense tables: by last two bytes for all contexts, by last three for the kept ones."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        counted = {lang: self._count(own) for lang, own in texts.items()}
        kept = set()
        for c in counted.values():
            totals = {}
            context, _, n = c[3]
            for k, x in zip(*self._totals(context, n), strict=True):
                totals[int(k)] = int(x)
            kept |= set(sorted(totals, key=lambda k: (-totals[k], k))[:MOST_CONTEXTS])
        self.kept = np.array(sorted(kept), np.int64)
        pairs = sorted({int(k) for c in counted.values() for k in np.unique(c[2][0])})
        self.pairs = np.array(pairs, np.int64)
        #: row of every pair of bytes; the last row is for pairs that no language knows
        self.pair_row = np.full(1 << 16, len(pairs), np.int32)
        self.pair_row[self.pairs] = np.arange(len(pairs))
        self.low = np.zeros((len(pairs) + 1, 256, len(self.languages)), np.float32)
        self.high = np.zeros((len(self.kept), 256, len(self.languages)), np.float32)
        for i, lang in enumerate(self.languages):
            self._fill(i, counted[lang])

    @staticmethod
    def _count(texts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By order: contexts, next bytes and counts. A text starts with line ends as its context."""
        lead = b"\n" * ORDER
        data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8).astype(np.int64)
        real = np.ones(len(data), bool)
        at = np.cumsum([0] + [len(t) + ORDER for t in texts])[:-1]
        for k in range(ORDER):
            real[at + k] = False
        where = np.flatnonzero(real)
        out = {}
        for order in range(ORDER + 1):
            context = np.zeros(len(where), np.int64)
            for k in range(order, 0, -1):
                context = context * 256 + data[where - k]
            key, n = np.unique(context * 256 + data[where], return_counts=True)
            out[order] = (key // 256, key % 256, n)
        return out

    @staticmethod
    def _totals(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        return context[first], np.add.reduceat(n, first) if len(first) else n

    def _step(self, counted: tuple, contexts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths of all bytes after the contexts, from those after their shorter contexts."""
        context, byte, n = counted
        known, total = self._totals(context, n)
        out = shorter.copy()
        if not len(known):
            return out
        distinct = np.diff(np.append(np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])), len(context)))
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        seen = known[at] == contexts
        all_ = (total + distinct)[at].astype(np.float64)
        out[seen] += np.log2(all_[seen] / distinct[at][seen])[:, None]
        row = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1) if len(contexts) else np.zeros(0, np.int64)
        own = contexts[row] == context if len(contexts) else np.zeros(len(context), bool)
        r = row[own]
        out[r, byte[own]] = np.log2(all_[r] / n[own])
        return out

    def _fill(self, i: int, counted: dict) -> None:
        none = np.full((1, 256), 8.0)
        zero = self._step(counted[0], np.zeros(1, np.int64), none)
        one = self._step(counted[1], np.arange(256, dtype=np.int64), np.repeat(zero, 256, axis=0))
        two = self._step(counted[2], self.pairs, one[self.pairs & 255])
        self.low[:-1, :, i] = two
        self.low[-1, :, i] = np.nan  # unknown pair: by last byte alone
        self.one = getattr(self, "one", np.zeros((256, 256, len(self.languages)), np.float32))
        self.one[:, :, i] = one
        if len(self.kept):
            at = np.minimum(np.searchsorted(self.pairs, self.kept & 0xFFFF), len(self.pairs) - 1)
            self.high[:, :, i] = self._step(counted[3], self.kept, two[at])

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        rows = len(bounds) - 1
        if not len(data):
            return np.zeros((rows, len(self.languages)))
        lead = ORDER * (np.arange(rows) + 1)
        padded = np.full(len(data) + ORDER * rows, 10, np.int64)
        where = np.arange(len(data)) + np.repeat(lead, np.diff(bounds))
        padded[where] = data
        b, p1, p2, p3 = (padded[where - k] for k in range(4))
        pair = p2 << 8 | p1
        row = self.pair_row[pair]
        bits = self.low[row, b]
        lost = row == len(self.pairs)
        if lost.any():
            bits[lost] = self.one[p1[lost], b[lost]]
        if len(self.kept):
            three = p3 << 16 | pair
            at = np.minimum(np.searchsorted(self.kept, three), len(self.kept) - 1)
            own = self.kept[at] == three
            bits[own] = self.high[at[own], b[own]]
        total = np.zeros((rows, len(self.languages)))
        some = np.flatnonzero(np.diff(bounds))
        total[some] = np.add.reduceat(bits.astype(np.float64), bounds[some], axis=0)
        return total


def learn(df: DataFrame, text: str, lang: str, key: str) -> Trees | None:
    """Trees from a bounded sample of whole documents that are not held out."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("doc_id")).where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.octet_length("text")).alias("size"))
    known = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not known:
        return None
    share = F.lit(0.0)
    for r in known:
        docs = min(SAMPLE_DOCS, SAMPLE_BYTES / max(r["size"], 1.0))
        share = F.when(F.col("lang") == r["lang"], max(docs, 20.0) / r["n"]).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    texts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for r in sorted(picked.toLocalIterator(), key=lambda r: r["h"]):
        own = r["text"].encode()
        if r["lang"] not in texts or size[r["lang"]] + len(own) <= 2 * SAMPLE_BYTES:
            texts.setdefault(r["lang"], []).append(own)
            size[r["lang"]] = size.get(r["lang"], 0) + len(own)
    return Trees(texts) if texts else None


_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for lo, data, bounds in slices(batch.column(2)) if trees else ():
                bits = trees.code_lengths(data, bounds)
                size = np.maximum(np.diff(bounds), 1)
                for k in range(len(size)):
                    gain = 2.0 ** (-SHARPNESS * (bits[k] - bits[k].min()) / math.sqrt(size[k]) / 8)
                    names.append(trees.languages[int(bits[k].argmin())])
                    scores.append(float(1 / gain.sum()))
            letters = batch.column(3).to_numpy(zero_copy_only=False) if trees else np.zeros(batch.num_rows, bool)
            names = [n if ok else "und" for n, ok in zip(names or ["und"] * batch.num_rows, letters, strict=True)]
            scores = [s if ok else 0.0 for s, ok in zip(scores or [0.0] * batch.num_rows, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Learned from the rows that are not held out."""
    lean_batches(df.sparkSession)
    trees = learn(df, text, lang, key)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), F.col(text).alias("text"), letter.alias("letter"))
    return own.mapInArrow(_predict(trees), _OUT)

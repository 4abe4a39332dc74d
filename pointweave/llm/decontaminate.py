"""Benchmark decontamination by spaced seeds.

A word is a run of letters and digits, A-Z folded. Fixed masks over word positions make seeds: a mask's hash takes the
words under its ones and ignores the rest, so a substituted word breaks only the seeds that look at it. Hashes of the
training text are looked up among those of the benchmark; every hit fixes an alignment (document position minus item
position), and the whole item is compared along it. A document leaks an item when one alignment has half of the item's words
in place (and no fewer than ``WEIGHT``), or when a passage does: half of the item's words, or 20 of them, that lie within
twice as many words of the document, in alignments that differ by little, each with four in place within eight. Words that
meet here and there by chance are no passage.

The masks are complete for that half: however the replaced words lie, an alignment that has so many words in place holds
some mask, so no such alignment is missed. For the 20 words that suffice in an item of over 40, this holds only from half
of the item on; below that an alignment has to hold four words within eight to be looked at.

Items of 4 to 6 words, which the least of ``WEIGHT`` words asks for whole, are held by whole-item comparison; shorter
ones name no passage and match nothing. Null text has no words. Repeated items each report; repeated documents each
report. Very long texts are compared whole. Ties need no rule: every pair of a document and an item is judged alone. The
benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each a separate pass over the documents, so
what is broadcast is bounded. Empty tables give an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches
from pointweave.llm.wordhash import mix, non_letters, slices, words

#: Masks of weight 4 and span 8 at most, the fewest found that every alignment with half of the words holds.
MASKS = (
    "1111", "11101", "111001", "1110001", "11100001", "11011", "110101", "1101001", "110011", "1100101", "1100011", "10111", "101101", "1011001", "101011", "1010101",
    "1010011", "10100011", "100111", "1001101", "1001011", "10010011", "1000111", "10001011",
)
SPAN = 8
#: Alignments that a passage with inserted or lost words may take differ by this at most.
BAND = 16
WEIGHT = 7
SHORT = (4, 5, 6)
SHARE, ENOUGH = 0.5, 20
BLOCK_BYTES = 2 << 20
#: Words compared at a time.
COMPARED = 1 << 20

HITS = "doc_id long, item_id long, n_matched int, n_item_words int, first_word int"
_STEP = np.uint64(0x9FB21C651E98DF25)


def _joined(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a run of seeds' words and one word more."""
    h = (h + w) * _STEP
    return h ^ (h >> np.uint64(32))


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(k for k, bit in enumerate(mask) if bit == "1")[1:]


#: Starts of masks by length, and the masks: what begins alike is hashed once.
_TREE = sorted({_offsets(m)[:k] for m in MASKS for k in range(4)})


def _sieve(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Bitmap over the top bits of hashes, at least 32 places a hash."""
    bits = max(16, int(len(hashes) * 32 - 1).bit_length())
    seen, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    seen[(hashes >> shift).astype(np.int64)] = True
    return seen, shift


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        parts, sizes, gap = [], [], non_letters()
        for _, data, bounds in slices(pa.array([t for _, t in items], pa.large_string())):
            h, at = words(data, bounds, gap)
            parts.append(h)
            sizes.append(np.diff(at))
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        item = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(self.words)) - self.starts[item]
        size = self.sizes[item]
        used = (size >= WEIGHT) | (np.isin(size, SHORT) & (place == 0))
        self.tables: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        hashes = {(): (np.flatnonzero(used), mix(self.words[used]))}
        for at in _TREE:
            if at:
                start, h = hashes[at[:-1]]
                inside = place[start] + at[-1] < size[start]
                start, h = start[inside], h[inside]
                hashes[at] = start, _joined(h, self.words[start + at[-1]])
            start, h = hashes[at]
            if len(at) == 3:
                order = np.argsort(h, kind="stable")
                self.tables[at] = h[order], start[order].astype(np.int32)
            else:
                self.tables[at] = np.unique(h), start[:0]
        self.item, self.place = item.astype(np.int32), place.astype(np.int32)
        self.sieves: dict[tuple[int, ...], tuple[np.ndarray, np.uint64]] = {}  # made where they are used

    def _hits(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, document position minus item position) of alignments that hold some mask, in order."""
        found: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        row_end, rows, own, shifts = at[1:], [], [], []
        for key in _TREE:
            if key:
                p, h = found[key[:-1]]
                inside = p + key[-1] < len(w)
                p, h = p[inside], h[inside]
                h = _joined(h, w[p + key[-1]])
            else:
                p, h = np.arange(len(w)), mix(w)
            hashes, starts = self.tables[key]
            if key not in self.sieves:
                self.sieves[key] = _sieve(hashes)
            seen, shift = self.sieves[key]
            some = seen[(h >> shift).astype(np.int64)]
            p, h = p[some], h[some]
            if len(key) < 3:
                found[key] = p, h
                continue
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            r = np.searchsorted(at, p, "right") - 1
            real = (hi > lo) & (p + key[-1] < row_end[r])
            p, lo, n, r = p[real], lo[real], (hi - lo)[real], r[real]
            start = starts[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            rows.append(np.repeat(r, n))
            own.append(self.item[start].astype(np.int64))
            shifts.append(np.repeat(p - at[r], n) - self.place[start])
        row, item, shift = (np.concatenate(x).astype(np.int64) for x in (rows, own, shifts))
        order = np.lexsort((shift, item, row))
        row, item, shift = row[order], item[order], shift[order]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0)
        return row[new], item[new], shift[new]

    def leaks(self, w: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, matched words, item words, first word) of rows whose words are w[at[k]:at[k+1]]."""
        if not len(self.words) or not len(w):
            return
        at = np.asarray(at, np.int64)
        row, item, shift = self._hits(w, at)
        if not len(row):
            return
        pair = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0)])
        ends = np.r_[pair[1:], len(row)]
        upto = np.cumsum(self.sizes[item])
        lo = 0
        while lo < len(pair):
            before = upto[pair[lo] - 1] if pair[lo] else 0
            hi = max(lo + 1, int(np.searchsorted(upto[ends - 1], before + COMPARED, "right")))
            part = slice(pair[lo], ends[hi - 1])
            yield from self._compared(w, at, row[part], item[part], shift[part])
            lo = hi

    def _compared(self, w: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        size = self.sizes[item]
        line = np.repeat(np.arange(len(row)), size)
        j = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        p = shift[line] + j + at[row[line]]
        inside = (p >= at[row[line]]) & (p < at[row[line] + 1])
        line, j, p = line[inside], j[inside], p[inside]
        same = w[p] == self.words[self.starts[item[line]] + j]
        line, j, p = line[same], j[same], p[same]
        whole = (size >= WEIGHT) | (np.bincount(line, minlength=len(row)) == size)  # short items count whole only
        line, j, p = line[whole[line]], j[whole[line]], p[whole[line]]
        need = np.maximum(SHARE * size, np.minimum(WEIGHT, size))
        big = (np.bincount(line, minlength=len(row)) >= need)[line]
        near = np.zeros(len(line), bool)  # four in place within eight
        if len(line) > 3:
            run = np.flatnonzero((line[3:] == line[:-3]) & (j[3:] - j[:-3] < SPAN))
            for k in range(4):
                near[run + k] = True
        first_line = np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0)]
        pair, of = np.cumsum(first_line) - 1, np.flatnonzero(first_line)
        least, width = np.minimum(need[of], ENOUGH), np.minimum(2 * size[of], 2 * ENOUGH)
        counted = big | self._local(np.flatnonzero(near), pair[line], shift[line], j, p, least, width)
        line, j, p = line[counted], j[counted], p[counted]
        row, item, size = row[of], item[of], size[of]
        base = np.cumsum(size) - size
        hit = np.zeros(int(size.sum()), bool)
        hit[base[pair[line]] + j] = True
        n = np.add.reduceat(hit, base, dtype=np.int64)
        first = np.full(len(row), np.iinfo(np.int64).max)
        np.minimum.at(first, pair[line], p - at[row[pair[line]]])
        for k in np.flatnonzero(n):
            yield int(row[k]), int(item[k]), int(n[k]), int(size[k]), int(first[k])

    @staticmethod
    def _local(own: np.ndarray, pair: np.ndarray, shift: np.ndarray, j: np.ndarray, p: np.ndarray, least: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Matches of pairs that have ``least`` different item words within ``width`` document words and a band of shifts."""
        out = np.zeros(len(j), bool)
        match = np.concatenate([own, own])  # bands overlap by half
        band = np.concatenate([shift[own] // BAND, shift[own] // BAND - 1])
        order = np.lexsort((p[match], band, pair[match]))
        match, band = match[order], band[order]
        of = pair[match]
        begin = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(band) != 0)][: len(of)])
        ends = np.r_[begin[1:], len(of)]
        for a, b in zip(begin, ends, strict=True):
            if b - a < least[of[a]]:
                continue
            words_, places, held, lo = j[match[a:b]].tolist(), p[match[a:b]].tolist(), Counter(), 0
            for hi, word in enumerate(words_):
                held[word] += 1
                while places[hi] - places[lo] >= width[of[a]]:
                    held[words_[lo]] -= 1
                    if not held[words_[lo]]:
                        del held[words_[lo]]
                    lo += 1
                if len(held) >= least[of[a]]:
                    out[match[a + lo : a + hi + 1]] = True
        return out


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Index]:
    own = benchmark.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        rows = own.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).orderBy("k", "t").collect()  # one block at a time
        if rows:
            yield Index([(r.k, r.t) for r in rows])


def _finder(index: Index):
    gap = non_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), [[] for _ in range(5)]
            for lo, data, bounds in slices(batch.column(1)):
                for r, i, n, size, first in index.leaks(*words(data, bounds, gap)):
                    for c, x in zip(out, (keys[lo + r].as_py(), index.ids[i], n, size, first), strict=True):
                        c.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "item_id", "n_matched", "n_item_words", "first_word"])

    return run


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per document and item it leaks."""
    lean_batches(df.sparkSession)
    docs, out = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), None
    for index in _blocks(benchmark, item_key, item_text):
        part = docs.mapInArrow(_finder(index), HITS)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else df.sparkSession.createDataFrame([], HITS)


def _clean(index: Index):
    gap = non_letters()

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        ok = np.ones(len(texts), bool)
        for lo, data, bounds in slices(pa.array(texts, pa.large_string())):
            ok[[lo + r for r, *_ in index.leaks(*words(data, bounds, gap))]] = False
        return pd.Series(ok)

    return clean


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Rows that leak no item, with the input's columns."""
    for index in _blocks(benchmark, item_key, item_text):
        df = df.where(_clean(index)(F.col(text)))
    return df

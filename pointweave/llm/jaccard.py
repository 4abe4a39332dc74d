"""Exact Jaccard join of word shingles through a token-group matrix, and the components of its links.

A document's set holds its distinct 5-word shingles (A-Z folded, words split at ASCII white space; fewer words: the whole
sequence as one shingle; no words: empty, linked with nothing). Sets are joined, not documents: documents of one set
share a node, so copies cost nothing. Two sets link when 100 * intersection >= 75 * union.

1. *Groups.* Sets that agree on a pair of min-hashes are held against the least set of their bucket (a star, so a
   bucket of any size costs as many comparisons as it has members). Verified links join sets into groups.
2. *Token-group matrix.* Tokens have one order: the many by hash, then those that were seen to repeat, the most frequent
   last. Linked sets share a token among their first n - ceil(0.75 n) + 1 in any fixed order, so only these are held. A
   token's row lists the sets that hold it; equal rows count once; sets query the larger groups of their rows that have
   a member of a fitting size.
3. *Crowds.* Sets of which three quarters or more are frequent tokens would make long rows. What two of them share is
   known without their texts: a rare token (then step 2 finds them) or only frequent ones, so sets with the same frequent
   tokens (a profile) stand behind the smallest of them, and profiles are joined by their own rows: first against the
   row's center, then what is still apart. A set joins when the best overlap of its profile reaches its size.
4. *Open.* A group's member sets are united; a query whose overlap with the union is under 0.75 n is refused without
   looking further, else the members are compared one by one until one links (the group is connected already).

Steps 2 to 4 miss nothing that step 1 left over, so the result is exact (up to 64-bit token and 128-bit set hashes).
Which tokens are listed as frequent changes the work, never the result; the list is cut at ``LISTED`` of them.

Null text has no words; a row without doc_id is linked with nothing. Rows that share a doc_id are separate documents. Very
long texts are taken whole. Links are symmetric, so ties need no rule; of equal sets the least doc_id names the node.
Other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches, materialize, small, trim
from pointweave.llm.graph import components
from pointweave.llm.suffix import pack, unpack
from pointweave.llm.wordhash import mix, slices, white_space, words

N = 5
PERCENT = 75
HASHES, BANDS = 12, 6
#: Frequent tokens that the order knows, and the repeats that a token needs for the list.
LISTED, REPEATS = 1 << 20, 3
#: Tokens that a task remembers while it looks for repeats.
REMEMBERED_BITS = 21
#: Entries that one block holds, and that one task of the matrix gets.
BLOCK_ENTRIES, RANGE_ENTRIES, LEAST_RANGES = 1 << 18, 1 << 19, 16
#: Bits kept of a token in the matrix; tokens that meet by chance only cost a comparison.
TOKEN_BITS = 40
#: A set holds an n-th part of its tokens more than it needs to share one with a partner; it then shares so many more.
MORE = 8
#: Centers of a row of profiles, beside its smallest.
CENTERS = 8
#: Sets opened by one task.
GROUP_SETS = 256
#: Routed texts that one call of a kernel gets, on average.
BUCKET_ROWS = 250

_U = np.uint64
_A, _B = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of the runs of N words at every position."""
    total = np.full(max(len(w) - N + 1, 0), N, _U)
    for k in range(N):
        total = (total ^ w[k : k + len(total)]) * _U(0x9FB21C651E98DF25)
        total ^= total >> _U(29)
    return mix(total)


def _short(w: np.ndarray) -> np.ndarray:
    total = np.array([len(w)], _U)
    for x in w:
        total = (total ^ x) * _U(0xC2B2AE3D27D4EB4F)
        total ^= total >> _U(31)
    return mix(total)


def flat_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, bounds of each row's tokens) of consecutive rows; a row's tokens are sorted and distinct."""
    gap = white_space()
    for lo, data, bounds in slices(column):
        w, at = words(data, bounds, gap)
        every, held = np.zeros(len(w), _U), np.zeros(len(w), bool)
        run = shingles(w)
        every[: len(run)] = run
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= N:
                every[a : b - N + 1].sort()
                held[a : b - N + 1] = True
            elif b > a:
                every[a], held[a] = _short(w[a:b])[0], True
        starts = at[:-1][at[1:] > at[:-1]]
        again = np.zeros(len(w), bool)
        again[1:] = every[1:] == every[:-1]
        again[starts] = False
        held &= ~again
        yield lo, every[held], np.concatenate([[0], np.cumsum(held)])[at]


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    for _, tokens, at in flat_sets(column):
        yield from (tokens[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[at[1:]] - total[at[:-1]]


def names(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit names of the sets, two columns."""
    n = np.diff(at).astype(_U)
    return np.stack([mix(_sums(mix(tokens ^ _A), at) + n), mix(_sums(mix(tokens + _B), at) ^ n)], axis=1)


def _binary(name: np.ndarray) -> list[bytes]:
    raw = name.astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _node(tokens: np.ndarray) -> bytes:
    return _binary(names(tokens, np.array([0, len(tokens)])))[0]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def least_shared(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n shares with any partner, at least."""
    return (PERCENT * n + 99) // 100


class Repeats:
    """Tokens seen again among the last few million; what it reports was seen twice, what lies further apart it may miss."""

    def __init__(self, bits: int = REMEMBERED_BITS):
        self.shift, self.last, self.found = _U(64 - bits), np.zeros(1 << bits, _U), []

    def see(self, tokens: np.ndarray) -> None:
        if not len(tokens):
            return
        slot = (mix(tokens) >> self.shift).astype(np.int64)
        self.found.append(tokens[self.last[slot] == tokens])
        at = np.zeros(len(self.last), np.int32)
        at[slot] = np.arange(len(tokens))
        later = at[slot]
        self.found.append(tokens[(later != np.arange(len(tokens))) & (tokens[later] == tokens)])
        self.last[slot] = tokens

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        token, n = np.unique(np.concatenate([*self.found, np.zeros(0, _U)]), return_counts=True)
        return token, n.astype(_U)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("repeats", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: set size, the set's name and its min-hash pairs. A task's last row (n null) has its repeated tokens."""
    salts = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    repeats, known = Repeats(), set()
    for batch in batches:
        keys = batch.column(0)
        for lo, tokens, at in flat_sets(batch.column(1)):
            n = np.diff(at)
            key = keys.slice(lo, len(n))
            some = (n > 0) & key.is_valid().to_numpy(zero_copy_only=False)
            spread, full = mix(tokens), np.flatnonzero(n)
            bands = np.zeros((len(full), BANDS), _U)
            if len(full):
                low = [np.minimum.reduceat(spread * s, at[:-1][full]) for s in salts]
                for b in range(BANDS):
                    bands[:, b] = mix(low[2 * b] * _U(0xD6E8FEB86659FD93) + low[2 * b + 1] + _U(b))
            node = [x if ok else None for x, ok in zip(_binary(names(tokens, at)), some.tolist(), strict=True)]
            first = np.zeros(len(n), bool)
            for i in np.flatnonzero(some).tolist():
                if node[i] not in known:
                    known.add(node[i])
                    first[i] = True
            if len(known) > 1 << 17:
                known.clear()
            repeats.see(tokens[np.repeat(first, n)])
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(node, pa.binary()), lists, pa.nulls(len(n), pa.binary())], schema=_SKETCH)
        trim()
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, pack(*repeats.counts())), _SKETCH.types, strict=True)], schema=_SKETCH)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in unpack(blob, 2)], ["token", "n"])


def frequent(sketches: DataFrame) -> np.ndarray:
    """Tokens that repeat, the most frequent last; at most ``LISTED``."""
    seen = sketches.where("n is null").select("repeats").mapInArrow(_unpacked, "token long, n long")
    seen = seen.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= REPEATS)
    listed = seen.orderBy(F.desc("n"), "token").limit(LISTED).toArrow()  # 16 MB at most
    return listed.column("token").to_numpy()[::-1].astype(np.int64).view(_U)


class Order:
    """Place of the frequent tokens in the order."""

    def __init__(self, listed: np.ndarray):
        self.place = np.argsort(listed, kind="stable")
        self.tokens = listed[self.place]
        self.sieve = np.zeros(1 << 24, bool)
        self.sieve[(self.tokens >> _U(40)).astype(np.int64)] = True

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """-1 where a token is not listed."""
        out = np.full(len(tokens), -1, np.int64)
        may = np.flatnonzero(self.sieve[(tokens >> _U(40)).astype(np.int64)])
        if len(may):
            at = np.minimum(np.searchsorted(self.tokens, tokens[may]), len(self.tokens) - 1)
            real = self.tokens[at] == tokens[may]
            out[may[real]] = self.place[at[real]]
        return out


_HELD = pa.schema([("range", pa.int32()), ("held", pa.binary()), ("blob", pa.binary()), ("node", pa.binary()), ("n", pa.int64()), ("profile", pa.binary()), ("places", pa.list_(pa.int32()))])
_HELD_SQL = "range int, held binary, blob binary, node binary, n long, profile binary, places array<int>"


def _block(ranges: int, token: np.ndarray, owner: np.ndarray, node: np.ndarray, n: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Sorted entries by range, with the sets that hold them."""
    token = mix(token) >> _U(64 - TOKEN_BITS)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    cut = np.concatenate([[0], np.searchsorted(token, np.array([(i << TOKEN_BITS) // ranges for i in range(1, ranges)], _U)), [len(token)]])
    out = []
    for r in np.flatnonzero(np.diff(cut)).tolist():
        own, local = np.unique(owner[cut[r] : cut[r + 1]], return_inverse=True)
        out.append((r, pack(node[own], n[own].astype(_U), more[own].astype(_U)), pack(np.diff(token[cut[r] : cut[r + 1]], prepend=_U(0)), local.astype(_U))))
    none = [pa.nulls(len(out), t) for t in _HELD.types[3:]]
    return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in out], _HELD.types[k]) for k in range(3)), *none], schema=_HELD)


def _prefixes(ranges: int, listed: Broadcast):
    """Entries of each set's first tokens that are not listed, in blocks; and the sets whose first tokens reach the list,
    with all their listed tokens in order (the profile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, waiting, held, base, known = Order(listed.value), [], 0, 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal held, base
            out = _block(ranges, *(np.concatenate(c) for c in zip(*waiting, strict=True)))
            waiting.clear()
            known.clear()
            held = base = 0
            return out

        for batch in batches:
            for _, tokens, at in flat_sets(batch.column(0)):
                name = names(tokens, at)
                node, first = _binary(name), np.zeros(len(at) - 1, bool)
                for i in np.flatnonzero(np.diff(at)).tolist():
                    if node[i] not in known:  # documents of one set count once
                        known.add(node[i])
                        first[i] = True
                tokens = tokens[np.repeat(first, np.diff(at))]
                name, n = name[first], np.diff(at)[first]
                if not len(n):
                    continue
                own = np.repeat(np.arange(len(n)), n)
                place = order.places(tokens)
                rare = place < 0
                ends = np.cumsum(n)
                before = np.concatenate([[0], np.cumsum(rare)])
                n_rare = before[ends] - before[ends - n]
                most = n - least_shared(n) + 1
                more = np.clip(np.minimum(n // MORE, n_rare - most), 0, None)
                took = rare & (before[:-1] - before[ends - n][own] < (most + more)[own])
                waiting.append((tokens[took], own[took] + base, name[:, 0], n, more))
                base, held = base + len(n), held + int(took.sum())
                crowded = np.flatnonzero(n_rare < most)
                if len(crowded):
                    mine = [np.sort(place[e - k : e][~rare[e - k : e]]) for e, k in zip(ends[crowded].tolist(), n[crowded].tolist(), strict=True)]
                    profile = [_node(p.astype(_U)) for p in mine]
                    cols = (pa.array(_binary(name[crowded]), pa.binary()), pa.array(n[crowded], pa.int64()), pa.array(profile, pa.binary()), pa.array(mine, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(crowded), t) for t in _HELD.types[:3]), *cols], schema=_HELD)
                if held >= BLOCK_ENTRIES:
                    yield flush()
            trim()
        if waiting:
            yield flush()

    return run


_ROWS = "row long, tokens long, node array<long>, n array<long>, more array<long>"


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of tokens that several sets hold: short names, sizes and surplus tokens of these sets; equal rows once, with the
    number of their tokens."""
    token, owner, held, base = [], [], [], 0
    for own, blob in zip(pdf["held"], pdf["blob"], strict=True):
        t, o = unpack(blob, 2)
        token.append(np.cumsum(t, dtype=_U))
        owner.append(o.astype(np.int64) + base)
        held.append(unpack(own, 3))
        base += len(held[-1][0])
    token, owner = np.concatenate(token), np.concatenate(owner)
    node, n, more = (np.concatenate(c) for c in zip(*held, strict=True))
    node, at, again = np.unique(node, return_index=True, return_inverse=True)  # a set may come from several blocks
    n, more, owner = n[at].view(np.int64), more[at].view(np.int64), again[owner]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    token, owner = token[same], owner[same]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
    ends = np.append(begin[1:], len(token))
    sign = mix(_sums(mix(node[owner]), np.append(begin, len(token)))).view(np.int64)
    sign, once, count = np.unique(sign, return_index=True, return_counts=True)
    several = (ends - begin)[once] > 1
    sign, once, count = sign[several], once[several], count[several]
    lists = [pd.Series([c[owner[a:b]] for a, b in zip(begin[once], ends[once], strict=True)], dtype=object) for c in (node.view(np.int64), n, more)]
    out = pd.DataFrame({"row": sign, "tokens": count, "node": lists[0], "n": lists[1], "more": lists[2]})
    del token, owner, order, held, lists
    trim()
    return out


_EDGES = "a binary, b binary"


def _by_task(kernel):
    """Run a kernel(queries, members) for each task of a bucket of tasks; each set is made once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        once = pdf.drop_duplicates("node")
        made = {}
        for node, tokens in zip(once["node"], sets(pa.array(once["text"], pa.large_string())), strict=True):
            made[bytes(node)] = tokens if _node(tokens) == bytes(node) else None
        rest = pdf[[made[bytes(x)] is None for x in pdf["node"]]]  # rows that share a doc_id may have other texts
        for node, tokens in zip(rest["node"], sets(pa.array(rest["text"], pa.large_string())), strict=True):
            if made[bytes(node)] is None and _node(tokens) == bytes(node):
                made[bytes(node)] = tokens
        tasks: dict[int, tuple[dict, dict]] = {}
        for node, task, role in zip(pdf["node"], pdf["task"], pdf["role"], strict=True):
            if made[bytes(node)] is not None:
                tasks.setdefault(task, ({}, {}))[role][bytes(node)] = made[bytes(node)]
        found = [edge for queries, members in tasks.values() for edge in kernel(queries, members)]
        del made, tasks
        trim()
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _against_union(queries: dict, members: dict) -> Iterator[tuple[bytes, bytes]]:
    """Queries against a group: its token union first, its members one by one only if that does not refuse."""
    if not members:
        return
    union = np.unique(np.concatenate(list(members.values())))
    for q, tokens in queries.items():
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        if 100 * int((union[at] == tokens).sum()) >= PERCENT * len(tokens):
            link = next((m for m, own in members.items() if m != q and linked(tokens, own)), None)
            if link is not None:
                yield q, link


def _against_star(members: dict, center: dict) -> Iterator[tuple[bytes, bytes]]:
    """Every member against the bucket's least set."""
    for c, t in center.items():
        yield from ((m, c) for m, own in members.items() if m != c and linked(own, t))


def _route(docs: DataFrame, nodes: DataFrame, routes: DataFrame, kernel) -> DataFrame:
    """Bring the texts of routed sets (node, task, role) to their tasks and run the kernel there."""
    routes = routes.groupBy("node").agg(F.collect_set(F.struct("task", "role")).alias("to")).join(nodes.select("node", "doc_id"), "node")
    routes = materialize(routes, "routes")
    stats = routes.agg(F.count(F.lit(1)), F.sum(F.size("to"))).first()
    own = docs.join(small(routes, 1, rows=64 * (stats[0] or 0) + 24 * (stats[1] or 0)), "doc_id")
    own = own.select("node", "text", F.explode("to").alias("to")).select("node", "text", "to.task", "to.role")
    buckets = max(32, (stats[1] or 0) // BUCKET_ROWS)
    return own.groupBy(F.pmod("task", F.lit(buckets))).applyInPandas(_by_task(kernel), _EDGES)


def _salted(key, node, count):
    """Tasks of a group of so many sets: one for each GROUP_SETS of them."""
    return F.xxhash64(key, F.pmod(F.xxhash64(node), F.ceil(count / GROUP_SETS)))


def _stars(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between sets that agree on a pair of min-hashes and the least set that does."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("count")).where("count > 1")
    member = banded.join(materialize(buckets, "buckets"), "band").where("node != center").select("node", "center", "count")
    member = member.groupBy("node", "center").agg(F.max("count").alias("count"))
    member = materialize(member.select("node", "center", _salted("center", "node", F.col("count")).alias("task")), "members")
    routes = member.select("node", "task", F.lit(0).alias("role")).unionAll(member.select(F.col("center").alias("node"), "task", F.lit(1).alias("role")).distinct())
    return materialize(_route(docs, nodes, routes, _against_star), "links")


def _enough(shared, n, m):
    """Whether sets of n and m tokens link if they share so many: shared / (n + m - shared) >= 3 / 4."""
    return 7 * shared >= 3 * (n + m)


def _crowds(crowd: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups that are joined by what profiles share, and edges between them. crowd: node, n, profile, places."""
    by_profile = crowd.groupBy("profile").agg(F.min(F.struct("n", "node")).alias("least"), F.max("n").alias("widest"), F.count(F.lit(1)).alias("count"), F.first("places").alias("places"))
    size = F.size("places")
    left = (F.col("count") > 1) & ~_enough(size, F.col("widest"), F.col("least.n"))
    by_profile = by_profile.select("profile", F.col("least.n").alias("m"), F.col("least.node").alias("rep"), size.alias("c"), "places", left.alias("left"))
    profiles = materialize(by_profile, "profiles")
    count, places = profiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    known = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not count:
        return groups, known
    behind = crowd.select("node", "n", "profile").join(small(profiles.select("profile", "m", "rep", "c"), 64, count), "profile").where("node != rep")
    behind = materialize(behind, "behind")
    edges = behind.where(_enough(F.col("c"), F.col("n"), F.col("m"))).select(F.col("node").alias("a"), F.col("rep").alias("b"))

    least = F.floor((PERCENT * F.col("m") + 99) / 100).cast("int")
    first = profiles.select("profile", "m", "c", "rep", "left", F.slice("places", 1, F.col("c") - least + 1).alias("early"))
    held = small(profiles.select("profile", "places"), 1, 64 * count + 4 * places)
    others = small(profiles.select(F.col("profile").alias("other"), F.col("places").alias("others")), 1, 64 * count + 4 * places)

    def overlaps(pairs: DataFrame) -> DataFrame:
        """pairs (profile, other, ...) with what they share."""
        both = pairs.join(held, "profile").join(others, "other")
        return both.withColumn("shared", F.size(F.array_intersect("places", "others"))).drop("places", "others")

    def rooted(roots: DataFrame) -> DataFrame:
        """First places with the root of their profile's smallest set."""
        own = first.join(roots, F.col("rep") == F.col("node"), "left").select("profile", "m", "c", "rep", "left", F.coalesce("root", "rep").alias("root"), "early")
        return materialize(own, "rooted")

    # a row's smallest profile and some more are its centers: entries apart from a center are held against it
    may = _enough(F.least("c", "d"), F.col("m"), F.col("k"))
    entries = rooted(groups).select("profile", "m", "c", "rep", "root", F.explode("early").alias("place"))
    entries = materialize(entries, "entries")
    by = F.when(F.col("salt") < CENTERS, F.xxhash64("profile")).otherwise(F.col("m"))
    salted = entries.withColumn("salt", F.explode(F.array(F.pmod(F.xxhash64("profile"), F.lit(CENTERS)), F.lit(CENTERS))))
    centers = salted.groupBy("place", "salt").agg(F.min(F.struct(by.alias("by"), "profile", "m", "c", "rep", "root")).alias("to"))
    centers = centers.select("place", F.col("to.profile").alias("other"), F.col("to.m").alias("k"), F.col("to.c").alias("d"), F.col("to.rep").alias("center"), F.col("to.root").alias("other_root")).distinct()
    star = entries.join(small(materialize(centers, "centers"), 96), "place").where((F.col("root") != F.col("other_root")) & may)
    star = overlaps(materialize(star.select("profile", "other", "m", "k", "rep", "center").distinct(), "star"))
    star = star.where(_enough(F.col("shared"), F.col("m"), F.col("k"))).select(F.col("rep").alias("a"), F.col("center").alias("b"))
    groups = materialize(components(known.unionAll(edges).unionAll(star)), "groups")

    # rows of one root ask nothing, but for profiles with sets that are too large for the smallest of them; a pair meets in
    # the first place that both have
    entries = rooted(groups).select("*", F.explode("early").alias("place"))
    mixed = entries.groupBy("place").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.max("left").alias("any")).where("first != last or any").select("place")
    entries = materialize(entries.join(small(mixed, 16, places), "place"), "entries")
    others_ = entries.select("place", F.col("profile").alias("other"), F.col("m").alias("k"), F.col("c").alias("d"), F.col("root").alias("other_root"), F.col("rep").alias("other_rep"), F.col("early").alias("other_early"))
    asks = ((F.col("root") != F.col("other_root")) & (F.col("rep") < F.col("other_rep"))) | (F.col("left") & (F.col("k") < F.col("m")))
    meets = F.get(F.array_intersect("early", "other_early"), F.lit(0)) == F.col("place")
    apart = entries.join(others_, "place").where((F.col("profile") != F.col("other")) & may & asks & meets)
    pairs = overlaps(materialize(apart.select("profile", "other", "m", "k", "rep", "other_rep", "left"), "apart"))
    pairs = materialize(pairs, "overlaps")
    edges = pairs.where(_enough(F.col("shared"), F.col("m"), F.col("k"))).select(F.col("rep").alias("a"), F.col("other_rep").alias("b"))
    reach = pairs.where("left").groupBy("profile").agg(F.max(F.struct((7 * F.col("shared") - 3 * F.col("k")).alias("reach"), "other_rep")).alias("best"))
    late = behind.join(reach, "profile").where(3 * F.col("n") <= F.col("best.reach")).select(F.col("node").alias("a"), F.col("best.other_rep").alias("b"))
    return groups, groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(materialize(edges.unionAll(late), "links"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Returns (doc_id, n, node) per row, and edges (a, b) that connect what links connect."""
    spark = docs.sparkSession
    lean_batches(spark)
    sketches = materialize(docs.mapInArrow(_sketch, "doc_id long, n long, node binary, bands array<long>, repeats binary"), "sketches")
    per_doc = sketches.where("n is not null").select("doc_id", "n", "node")
    total = per_doc.agg(F.sum("n")).first()[0] or 0
    listed = spark.sparkContext.broadcast(frequent(sketches))  # 8 MB at most
    least = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(least, "nodes")

    ranges = max(LEAST_RANGES, total // 4 // RANGE_ENTRIES)
    held = materialize(docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(ranges, listed), _HELD_SQL), "prefixes")
    rows = held.where("range is not null").select("range", "held", "blob").groupBy("range").applyInPandas(_matrix, _ROWS)
    rows = materialize(rows.groupBy("row").agg(F.sum("tokens").alias("tokens"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("more").alias("more")), "rows")
    crowd = held.where("range is null").groupBy("node").agg(F.first("n").alias("n"), F.first("profile").alias("profile"), F.first("places").alias("places"))
    crowd = materialize(crowd, "crowd")

    groups = materialize(components(_stars(docs, nodes)), "groups")
    groups, near = _crowds(crowd, groups)

    # rows by group: sets query the larger groups of their rows
    short = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    root = F.conv(F.hex(F.substring("root", 1, 8)), 16, -10).cast("long")
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").select(short.alias("s"), root.alias("root"), "size").dropDuplicates(["s"])
    entry = rows.select("row", "tokens", F.explode(F.arrays_zip("node", "n", "more")).alias("e")).select("row", "tokens", F.col("e.node").alias("s"), "e.n", "e.more")
    entry = entry.join(small(materialize(sized, "grouped"), 48), "s", "left").select("row", "tokens", "s", "n", "more", F.coalesce("root", "s").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    entry = materialize(entry, "row-entries")
    held_by = entry.groupBy("row", F.col("root").alias("group")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("size").alias("of"), F.min("more").alias("least"))
    fits = (100 * F.col("n") >= PERCENT * F.col("lo")) & (PERCENT * F.col("n") <= 100 * F.col("hi"))
    larger = (F.col("of") > F.col("size")) | ((F.col("of") == F.col("size")) & (F.col("group") > F.col("root")))
    pair = entry.join(held_by, "row").where(larger & fits).groupBy("s", "group").agg(F.sum("tokens").alias("shared"), F.min(F.least("more", "least")).alias("more"))
    # the bound: what a query and a group share of their first tokens
    pair = materialize(pair.where(F.col("shared") > F.col("more")).select("s", F.col("group").alias("of")), "pairs")
    named = nodes.select(short.alias("s"), "node")
    pair = pair.join(named, "s").select("node", F.col("of").alias("s"))
    pair = materialize(pair.join(named.withColumnRenamed("node", "group"), "s").select("node", "group"), "queries")

    wanted = pair.select(F.col("group").alias("root")).distinct()
    in_groups = groups.join(wanted, "root", "left_semi").select("node", "root")
    alone = wanted.join(groups.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), "root")
    members = in_groups.unionAll(alone)
    counts = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP_SETS).alias("parts"))
    members = members.join(counts, "root").select("node", F.xxhash64("root", F.pmod(F.xxhash64("node"), "parts")).alias("task"), F.lit(1).alias("role"))
    queries = pair.join(counts.withColumnRenamed("root", "group"), "group").select("node", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = queries.select("node", F.xxhash64("group", F.col("part").cast("long")).alias("task"), F.lit(0).alias("role"))
    far = _route(docs, nodes, members.unionAll(queries), _against_union)
    return per_doc, near.unionAll(materialize(far, "links"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    per_doc, edges = links(docs)
    found = components(edges)
    classes = per_doc.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = materialize(classes, "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select(F.col("node").alias("_node"), "component_id")
    out = per_doc.join(named, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component stays, the least doc_id; rows keep their columns. Of rows that share a doc_id
    only the component's decides: they stay or go together."""
    gone = near_duplicates(df, text, key).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "gone")
    rows = df.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"))
    return rows.join(small(gone, 16), F.col("key") == F.col("_gone"), "left_anti").select("row.*")

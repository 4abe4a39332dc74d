import zlib
from collections import defaultdict

import numpy as np
import pytest

from pointweave.llm import packing as p

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part int, local long, length string"


def check_plan(counts, capacity):
    used, rooms = defaultdict(int), defaultdict(list)
    for s, first, n, sequence, per, offset in p.plan(counts, capacity):
        assert first == used[s]
        used[s] += n
        for k in range(n):
            rooms[sequence + k // per].append((offset + k % per * s, s))
    assert {s: n for s, n in used.items() if n} == {s: int(n) for s, n in enumerate(counts) if n}
    for pieces in rooms.values():
        at = 0
        for offset, s in sorted(pieces):
            assert offset == at
            at += s
        assert at <= capacity
    return len(rooms)


def test_plan_is_whole_and_near_the_lower_bound():
    rng = np.random.default_rng(3)
    for sizes in ([5], [64] * 9, [1] * 200, list(rng.integers(1, 65, 3000)), [33] * 50, [40, 24] * 30, []):
        counts = np.bincount(np.array(sizes, int), minlength=65)
        bins = check_plan(counts, 64)
        floor = max(-(-sum(sizes) // 64), sum(s > 32 for s in sizes))
        assert bins <= floor * 1.03 + 1


def test_configurations_hold_nearly_all_tokens():
    """Sparse and dense histograms at the full capacity: the program itself places the tokens, and wastes little room."""
    rng = np.random.default_rng(4)
    for pieces, times in ((300, 1), (10000, 1), (10000, 40)):
        sizes = np.clip(rng.lognormal(6.3, 1.2, pieces).astype(int), 1, p.CAPACITY)
        counts = np.bincount(sizes, minlength=p.CAPACITY + 1) * times
        tokens = int((counts * np.arange(len(counts))).sum())
        used = p.cover(counts, p.CAPACITY)
        held = np.zeros_like(counts)
        for config, n in used.items():
            assert n > 0 and sum(s * a for s, a in config) <= p.CAPACITY
            for s, a in config:
                held[s] += a * n
        assert (held <= counts).all() and (held * np.arange(len(counts))).sum() >= 0.9 * tokens
        assert check_plan(counts, p.CAPACITY) <= -(-tokens // p.CAPACITY) * 1.001 + 1


def test_best_configuration_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = rng.choice(np.arange(1, 15), rng.integers(1, 6), replace=False)
        prices, capacity = rng.random(len(sizes)) * sizes, int(rng.integers(1, 30))
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - s] + x for s, x in zip(sizes, prices, strict=True) if s <= c)])
        got = p.best_configuration(prices, sizes, capacity)
        assert sum(sizes[i] for i in got) <= capacity and abs(sum(prices[i] for i in got) - best[capacity]) < 1e-9


def test_pieces_equal_brute_force(spark):
    texts = [None, "", " ", "Hello  World\n it's 42  é́ <|endoftext|>x don't y \x1c z", "word " * 9000, "a b c", "a b c", "ÅNGSTRÖM ﬁ İ Σς", "x" * 5000, "́ e ́", "H\u0331A T\u0308 W\u030a", "<|STARTOFTEXT|> A<|startoftext|>B <|EndOfText|>", "A<|b"]
    rows = [(i // 2, t, 1, 2, "clash") for i, t in enumerate(texts * 3)]
    got = p.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    t = tokenizers.Tokenizer.from_file(PATH)
    want = []
    for key, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(key, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for k in range(0, len(ids), 4096) for own in [ids[k : k + 4096]]]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for pieces in rooms.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(rooms) == max(-(-sum(w[3] for w in want) // 4096), 6)


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0

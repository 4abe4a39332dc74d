import hashlib
import random

from pointweave.llm import suffix as x

SCHEMA = "doc_id long, text string, chunk string, ids int"


def brute(rows):
    least = {}
    for key, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            if key is not None:
                s = b[i : i + 50]
                least[s] = min(least.get(s, key), key)
    out = []
    for key, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least.get(b[i : i + 50], 1 << 63) < (1 << 63 if key is None else key):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passages = [prose(n) for n in (49, 50, 51, 60, 80, 81, 200, 1000)]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 5000, "ab" * 3000, "ab" * 60]
    for _ in range(60):
        texts.append("".join(rng.choice([prose(rng.randint(0, 90)), rng.choice(passages)]) for _ in range(rng.randint(1, 8))))
    texts += [t for t in texts if rng.random() < 0.3]
    for p in passages:  # pieces of passages, cut anywhere
        for _ in range(4):
            i = rng.randrange(len(p))
            texts.append(prose(20) + p[i : i + rng.randint(45, 120)] + prose(20))
    rng.shuffle(texts)
    keys = list(range(len(texts)))
    rng.shuffle(keys)
    rows = [(k, t, "clash", 1) for k, t in zip(keys, texts)]
    return rows + [(None, passages[-1] + "tail", "", 0), (rows[3][0], rows[3][1], "", 0), (rows[5][0], passages[-1], "", 0)]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = x.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_segments_equal_brute_force(monkeypatch):
    """Anchors of a chunk do not depend on how it is cut into segments, as far as results go."""
    rows = [r for r in corpus(3) if r[0] is not None]
    monkeypatch.setattr(x, "SEGMENT", 97)
    text = [(r[1] or "").encode() for r in rows]
    import numpy as np
    import zstandard

    c = x.Chunk(np.array([r[0] for r in rows], "<i8").tobytes(), np.array([len(t) for t in text], "<i8").tobytes(), zstandard.ZstdCompressor().compress(b"".join(text)))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(c.lo, c.hi)])
    want = [i for a, b in zip(c.bounds[:-1], c.bounds[1:]) for i in range(a, b - 49)]
    assert sorted(starts) == want  # every window belongs to exactly one anchor
    s, rank, _ = c.windows(np.ones(len(c.first), bool))
    by = {}
    for p, r in zip(s, rank):
        by.setdefault(int(r), set()).add(c.raw[p : p + 50])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set().union(*by.values()))


def test_empty_table(spark):
    assert x.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0

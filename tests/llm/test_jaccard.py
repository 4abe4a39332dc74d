import random
import re

import numpy as np

from pointweave.llm import jaccard as j

SCHEMA = "doc_id long, text string, node string, n int, _gone long"


def brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def corpus(seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d", "A b C d", "a b c d e", "a b c d e f"]
    passage = [word() for _ in range(30)]
    for size in (6, 9, 20, 60, 200):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, 2, size // 50, size // 25, size // 12):
                w = list(base)
                for _ in range(changes):
                    w[rng.randrange(len(w))] = word()
                texts.append("\n".join(w))
            texts.append(" ".join(base + passage))
            texts.append(" ".join(base[: int(size * 0.8)]))
            texts.append(" ".join(passage + base))
    chain = [word() for _ in range(100)]  # neighbours link, ends do not
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 4)]
    texts += [" ".join(passage + [word()]) for _ in range(40)] + ["x " * 30000, "long " + " ".join(map(str, range(20000)))]
    rng.shuffle(texts)
    return [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_matrix_alone_finds_every_link(spark, monkeypatch):
    """Without the min-hash groups the token-group matrix still has to find all."""
    monkeypatch.setattr(j, "_against_star", lambda members, center: ())
    rows = corpus(12)
    got = j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_linked_sets_share_an_early_token():
    """Whatever the order, and 7 * shared >= 3 * (n + m) says the same as the similarity."""
    rng = np.random.default_rng(3)
    for n in (*range(1, 90), 150, 400, 1000, 4000):
        for _ in range(6):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, max(len(x) // 7, 0) + 2))
            y = np.union1d(x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, len(x) // 7 + 1)), dtype=np.uint64))
            both = len(np.intersect1d(x, y))
            assert j.linked(x, y) == bool(j._enough(both, len(x), len(y))) or not len(y)
            if len(y) and j.linked(x, y):
                key = rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
                first = [s[np.argsort(s * key[0])][: len(s) - int(j.least_shared(np.int64(len(s)))) + 1] for s in (x, y)]
                assert len(np.intersect1d(*first))


def crowded(seed=21):
    """Texts of common passages with own tails of every length, so that some link only to a smaller text or another profile."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passages = [[word() for _ in range(n)] for n in (12, 30, 64)]
    texts = []
    for p in passages:
        texts += [" ".join(p + [word() for _ in range(k)]) for k in (*range(len(p) // 2), *range(len(p) // 3))]
        for _ in range(25):
            w = list(p)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w + [word() for _ in range(rng.randrange(len(p) // 4))]))
            lo = rng.randrange(len(p) // 4)
            texts.append(" ".join(p[lo:] + [word() for _ in range(rng.randrange(len(p) // 4))]))
        texts += [" ".join(p + q[: rng.randrange(len(q))]) for q in passages for _ in range(6)]
    rng.shuffle(texts)
    return [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]


def test_crowds(spark, monkeypatch):
    """Sets of frequent tokens, with and without the min-hash groups, with a long and a short list."""
    for seed, least, listed, stars in ((21, 2, 1 << 20, True), (22, 1, 1 << 20, False), (23, 6, 1 << 20, False), (24, 2, 40, False), (25, 10**9, 1 << 20, False)):
        with monkeypatch.context() as m:
            if not stars:
                m.setattr(j, "_against_star", lambda members, center: ())
            m.setattr(j, "REPEATS", least)
            m.setattr(j, "LISTED", listed)
            rows = crowded(seed)
            got = j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
            assert sorted(map(tuple, got)) == brute(rows)


def test_profiles_alone_find_every_link(spark, monkeypatch):
    """Without the first comparison with a row's center the rest still has to find all."""
    monkeypatch.setattr(j, "_against_star", lambda members, center: ())
    monkeypatch.setattr(j, "REPEATS", 1)
    rows = crowded(26) + [(1000 + i, t, *rest) for i, t, *rest in corpus(27)]
    got = j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeats_report_only_what_repeats():
    rng = np.random.default_rng(5)
    once, often = rng.integers(0, 1 << 63, 20000, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    seen = j.Repeats(12)
    for part in np.array_split(once, 40):
        seen.see(np.concatenate([part, often]))
    tokens, n = seen.counts()
    assert set(tokens.tolist()) <= set(often.tolist()) and n.max() <= 40
    assert len(tokens) > 40


def test_one_of_each_stays(spark):
    rows = corpus(13)
    df = spark.createDataFrame(rows, SCHEMA)
    out = j.keep_one(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {d for d, _, c in brute(rows) if d == c}


def test_empty_and_repeated(spark):
    assert j.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert j.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", "", 1, 1), (1, "a b c d e f", "", 1, 1)] + [(1, "a b c d e f", "", 1, 1)] + [(2, "a b c d e f", "", 1, 1), (3, None, "", 1, 1), (3, None, "", 1, 1)]
    assert sorted(map(tuple, j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (None, 2, None)]


def test_rows_that_share_a_doc_id(spark):
    long = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(5, long, "", 1, 1), (5, other, "", 1, 1), (7, long + " x", "", 1, 1), (6, other + " y", "", 1, 1)]
    assert sorted(map(tuple, j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == [(5, 96, 5), (5, 96, 5), (6, 97, 5), (7, 97, 5)]

import random
import re

from pointweave.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string, item_id long, n string", "item_id long, text string, doc_id string"


def norm(t):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]


def brute(text, item):
    """The item's words in place on alignments where some mask agrees: all, where they suffice; else those of a passage."""
    a, b = norm(text), norm(item)
    need = max(d.SHARE * len(b), min(d.WEIGHT, len(b)))
    masks = d.MASKS if len(b) >= 7 else ["1" * len(b)] if len(b) in d.SHORT else []
    same, near = set(), set()
    for shift in range(-len(b), len(a)):
        on = [j for j in range(len(b)) if 0 <= j + shift < len(a) and a[j + shift] == b[j]]
        hit = any(all(m[k] == "0" or j + k in on for k in range(len(m))) and j + shift >= 0 and j + shift + len(m) <= len(a) for m in masks for j in range(len(b) - len(m) + 1))
        if hit and len(on) >= need:
            same |= set(on)
        if hit and len(b) >= 7:
            near |= {(shift, j) for k in range(len(b)) for j in on if k <= j < k + 8 and sum(k <= x < k + 8 for x in on) >= 4}
    least, width = min(need, d.ENOUGH), min(2 * len(b), 2 * d.ENOUGH)
    for band in {s // d.BAND - o for s, _ in near for o in (0, 1)}:
        own = [(s + j, j) for s, j in near if d.BAND * band <= s < d.BAND * (band + 2)]
        for p, _ in own:
            inside = {j for q, j in own if p <= q < p + width}
            same |= inside if len(inside) >= least else set()
    return len(same)


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (40, 15, 8, 7, 6, 5, 4, 3, 1, 60)] + [None, "", "same item twice over and over again", "same item twice over and over again"]
    docs = [None, "", " "]
    for item in items:
        w = (item or "").split()
        for rate in (0, 0.1, 0.2, 0.5):
            around = [word() for _ in range(50)]
            mutated = [word() if rng.random() < rate else x.upper() + "," * (rng.random() < 0.2) for x in w]
            docs += [" ".join(around + mutated + around), " ".join(mutated)]
        docs += [" ".join(w[: len(w) // 3]), " ".join([word() for _ in range(9)] + w[: len(w) // 2] + ["extra"] + w[len(w) // 2 :])]
    docs += [" ".join(word() for _ in range(300)) for _ in range(20)] + [" ".join(word() for _ in range(30000)) + " " + items[0]]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id): r.n_matched for r in d.leaks(df, bench).collect()}
    want = {(i, j): n for i, t in enumerate(docs[:-1]) for j, item in enumerate(items) if (n := brute(t, item))}
    assert {k: v for k, v in got.items() if k[0] < len(docs) - 1} == want
    assert (len(docs) - 1, 0) in got
    kept = d.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {k for k, _ in got}


def test_planted_passages_and_chance(spark):
    """Truth by construction: a shared phrase amid words of one frequency table is no leak, 25 words of a long item are."""
    rng = random.Random(9)
    vocabulary, weights = [f"w{k}" for k in range(3000)], [1 / (k + 2) for k in range(3000)]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    item, short = prose(1400), [f"q{k}" for k in range(24)]
    clean = [prose(700) + item[100:107] + prose(700) for _ in range(20)] + [prose(2000) for _ in range(20)]
    leaky = [prose(700) + item[k : k + 25] + prose(300) for k in range(0, 1300, 130)]
    changed = [x if k % 4 else "z" for k, x in enumerate(short)]
    leaky += [prose(300) + changed + prose(100), prose(50) + short[:12] + ["extra"] + short[12:] + prose(50)]
    df = spark.createDataFrame([(i, " ".join(t), 0, "x") for i, t in enumerate(clean + leaky)], DOCS)
    bench = spark.createDataFrame([(0, " ".join(item), "y"), (1, " ".join(short), "y")], ITEMS)
    assert {r.doc_id for r in d.leaks(df, bench).collect()} == set(range(len(clean), len(clean) + len(leaky)))


def test_empty_tables(spark):
    df, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a b", 0, "")], DOCS)
    assert d.leaks(df, bench).count() == 0 and d.leaks(full, bench).count() == 0 and d.drop_leaks(full, bench).count() == 1

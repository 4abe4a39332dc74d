import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from pointweave.llm import ppm

SCHEMA = "doc_id long, text string, lang string, letter string, held_out int"
SYLLABLES = {"en": "the and ing er on th re", "de": "der sch ein ung en ich ü", "fr": "le que eau ou é ment ai"}


def corpus(n=200):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang if i % 10 else None, "clash", 1))
    return rows


def brute(texts, text):
    """Bits of a text under one language's trees, byte by byte with dictionaries."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        b = b"\n\n\n" + t
        for i in range(3, len(b)):
            for k in range(4):
                counts[k][b[i - k : i]][b[i]] += 1
    b, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(b)):
        for k in range(3, -1, -1):
            own = counts[k].get(b[i - k : i])
            if own:
                total = sum(own.values()) + len(own)
                if b[i] in own:
                    bits += math.log2(total / own[b[i]])
                    break
                bits += math.log2(total / len(own))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force():
    rows = corpus(40)
    texts = defaultdict(list)
    for _, t, lang, *_ in rows:
        texts[lang or "en"].append(t.encode())
    trees = ppm.Trees(texts)
    probes = ["the ding", "", "x", "schön é", "\x00\xff unseen ☃ bytes", rows[0][1]]
    data = [p.encode() for p in probes]
    bits = trees.code_lengths(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]))
    for i, lang in enumerate(trees.languages):
        for k, d in enumerate(data):
            assert math.isclose(bits[k, i], brute(texts[lang], d), rel_tol=1e-4, abs_tol=1e-3)


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(300) + [(1000, None, "en", "", 0), (1001, "", "de", "", 0), (1002, "123 !? 5", "fr", "", 0), (1003, "der schein " * 20000, "de", "", 0), (1003, "le que eau ou", None, "", 0)]
    got = ppm.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[1:3] for r in rows}
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id < 1000:
            lang = truth[r.doc_id][1]
            total += bool(lang and r.held_out)
            right += bool(lang and r.held_out and lang == r.lang_pred)
    assert total > 30 and right >= 0.98 * total
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert sorted(r.lang_pred for r in got if r.doc_id == 1003) == ["de", "fr"]


def test_nothing_to_learn(spark):
    assert ppm.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    got = ppm.identify(spark.createDataFrame([(1, "abc", None, "", 0)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]

import functools
import random
import re

import pytest

from pointweave.llm import unigram as u

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, known int"


def brute(text, scores):
    """Best segmentation of each word by plain recursion over its ends."""

    def of(word):
        full = u.MARK + word

        @functools.cache
        def best(end):
            if not end:
                return 0.0, 0
            width = len(full[end - 1].encode())
            options = [(best(end - 1)[0] + u.BYTE_SCORE * width, -best(end - 1)[1] - width)]
            for begin in range(max(0, end - 40), end):
                if full[begin:end] in scores:
                    options.append((best(begin)[0] + scores[full[begin:end]], -best(begin)[1] - 1))
            s, n = max(options)
            return s, -n

        for end in range(0, len(full), 200):
            best(end)
        return best(len(full))[1]

    return sum(of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "hello", "hello helper help held", "international internationalisation", "漢字 \U0001f600x", "a" * 600, "word " * 20000, "café naïve \u0001"]
    texts += [" ".join("".join(rng.choices("aeioutrnsl", k=rng.randint(1, 12))) for _ in range(50)) for _ in range(20)]
    rows = [(i // 2, t, "clash", 1) for i, t in enumerate(texts * 2)]
    got = u.token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    scores = u.vocabulary(PATH)
    assert len(scores) > 30_000
    assert sorted(map(tuple, got)) == sorted((k, brute(t, scores)) for k, t, *_ in rows)


def test_each_prefix_is_scored_once(monkeypatch):
    scored = []
    step = u.TrieCounter.step
    monkeypatch.setattr(u.TrieCounter, "step", lambda self, full, end, *a: (scored.append(full[:end]), step(self, full, end, *a)))
    t = u.TrieCounter({u.MARK: -1.0, "ab": -1.0, "a": -2.0, "b": -2.0, "c": -2.0})
    t.learn(["abab", "ababc", "abac"])
    words = {u.MARK + w for w in ("abab", "ababc", "abac")}
    assert sorted(scored) == sorted({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert t.known == {"abab": 3, "ababc": 4, "abac": 4}


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(u, "KEPT_WORDS", 2)
    t = u.TrieCounter(u.vocabulary(PATH))
    assert t.totals(["hello world again and", "again"]) == t.totals(["hello world again and", "again"])


def test_empty_table(spark):
    assert u.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0

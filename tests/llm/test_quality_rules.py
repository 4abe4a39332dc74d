import re
from collections import Counter

from pointweave.llm import quality_rules as q

SCHEMA = "doc_id long, text string, source string, _q string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def cases():
    base = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", base, base + " " + base, "a b c d e f g h " * 30, "é ü 漢字 \U0001f600 #|%", "x\ny\nx\n \nx", "same line here\n" * 50, "w " * 20000, base + "\x0b\x0c\r" + base[:60], "a b c " * 9]
    return [(i, t, None if i % 3 == 0 else f"h{i % 2}", "clash", "clash") for i, t in enumerate(texts + texts)]


def test_measures_equal_brute_force(spark):
    rows = cases()
    got = {r["doc_id"]: r for r in q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert not (r.base_failed and r.kept)


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"word{i} ###" for i in range(60))
    rows = [(i, good, "clean") for i in range(400)] + [(1000, noisy, "clean")]
    rows += [(2000 + i, noisy, "bad") for i in range(400)] + [(3000, good, "bad")]
    rows += [(4000 + i, noisy if i < 40 else good, "mixed") for i in range(400)]
    kept = {r.doc_id for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert {i for i in range(400)} <= kept and 1000 in kept  # one soft failure on a trusted host is forgiven
    assert not kept & {2000 + i for i in range(400)} and 3000 not in kept
    assert kept & set(range(4000, 4400)) == set(range(4040, 4400))


def test_keep_good_returns_the_columns_it_got(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    out = q.keep_good(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in q.quality_rules(df).where("kept").collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert q.quality_rules(df).count() == 0 and q.keep_good(df).count() == 0

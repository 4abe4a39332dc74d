import math
import random

from pointweave.llm import quality_model as q

SCHEMA, LABELS = "doc_id long, text string, source string, lang string, host string, evidence int", "doc_id long, quality int, text string"


def corpus(n=600):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghilmnoprst", k=rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        bad = rng.random() < (0.6 if i % 5 == 0 else 0.1)
        kind = rng.randrange(3)
        text = " ".join(words) if not bad else " ".join(w + "###" for w in words) if kind == 0 else " ".join(words[:8] * 20) if kind == 1 else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, f"host{i % 5}", "en" if i % 2 else "de", "clash", 1))
        if i % 3 == 0:
            labels.append((i, int(not bad), ""))
    return rows, labels, [r[0] for r in rows]


def truth(text):
    return not ("###" in text or "!!" in text or len(set(text.split())) < 10)


def test_held_out_accuracy_and_rates(spark):
    rows, labels, _ = corpus()
    got = {r.doc_id: r for r in q.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    unseen = [r for r in rows if r[0] % 3]
    assert sum(got[r[0]].kept == truth(r[1]) for r in unseen) >= 0.97 * len(unseen)
    assert all(got[r[0]].kept for r in rows if truth(r[1]) and r[0] % 3 == 0)
    assert got[0].host_rate < got[1].host_rate  # the noisy host


def test_shrinkage(spark):
    places = spark.createDataFrame([("big", 1000.0, 100.0), ("tiny", 1.0, 0.0)], "host string, n double, good double")
    rate = {r.host: r.rate for r in q._shrunk(places, q.F.lit(0.9), 20.0).collect()}
    assert abs(rate["big"] - 118 / 1020) < 1e-9 and abs(rate["tiny"] - 18 / 21) < 1e-9


def test_posteriors_equal_brute_force(spark):
    rows, labels, _ = corpus(240)
    rows += [(1000, "one lone page with a few words", "host9", "xx", "", 1)]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in q.classify(df, marks).collect()}
    prior = q.train(df.select("doc_id", "text"), marks.select("doc_id", q.F.col("quality").alias("good"))).prior
    own = {r[0]: 1 / (1 + math.exp(-(got[r[0]].evidence + prior))) for r in rows}
    place = {r[0]: (r[2], r[3]) for r in rows}

    def totals(key):
        out = {}
        for i, x in own.items():
            n, good = out.get(key(i), (0, 0.0))
            out[key(i)] = n + 1, good + x
        return out

    def strength(places):
        n, good = sum(a for a, _ in places), sum(b for _, b in places)
        m = min(max(good / n, 1e-3), 1 - 1e-3)
        spread = sum(b * b / a for a, b in places) / n - m * m - m * (1 - m) * (len(places) - 1) / n
        return min(max(m * (1 - m) / max(spread, 1e-7) - 1, 5.0), 5000.0)

    hosts, paths = totals(lambda i: place[i][0]), totals(lambda i: place[i])
    by_host, by_path, overall = strength(hosts.values()), strength(paths.values()), sum(own.values()) / len(own)
    for i, x in own.items():
        n, good = hosts[place[i][0]]
        host_rate = (good + by_host * overall) / (n + by_host)
        n, good = paths[place[i]]
        rate = min(max((good - x + by_path * host_rate) / (n - 1 + by_path), q.RATE_BOUNDS[0]), q.RATE_BOUNDS[1])
        score = 1 / (1 + math.exp(-(got[i].evidence + math.log(rate / (1 - rate)))))
        assert math.isclose(got[i].host_rate, host_rate, rel_tol=1e-9) and math.isclose(got[i].path_rate, (good + by_path * host_rate) / (n + by_path), rel_tol=1e-9)
        assert math.isclose(got[i].score, score, rel_tol=1e-9) and got[i].kept == (score >= q.THRESHOLD)


def test_edge_cases(spark):
    rows, labels, _ = corpus(120)
    odd = [(900, None, None, None, None, 1), (901, "", "host1", None, "", 1), (902, "x " * 50000, None, "en", "", 1), (902, "same id again with other words here", "new", "en", "", 1)]
    labelled = labels + [(900, 1, ""), (None, 1, ""), (3, None, ""), (labels[0][0], labels[0][1], "again")]
    got = q.classify(spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(labelled, LABELS)).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], SCHEMA)
    assert q.classify(none, spark.createDataFrame(labels, LABELS)).count() == 0
    assert all(r.kept for r in q.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect())

import random

import corpus_pipeline as c
from tests.llm.test_decontaminate import brute as leak
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_quality_rules import brute as rules
from tests.llm.test_secrets import brute as secrets


def tables(spark, path):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghilmnoprst", k=rng.randint(3, 8)))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    texts = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(body))
        if i % 6 == 0:
            texts += [" ".join(body), " ".join(body[:-1] + [word()])]
        if i % 10 == 3:
            texts.append(" ".join(body[:20]) + " " + items[i % 5] + " " + " ".join(body[20:]))
        if i % 10 == 7:
            texts.append(" ".join(body[5:]) + " password=hunter2hunter2 " + word())
        if i % 10 == 9:
            texts.append(" ".join(body[:10]))
    texts += [None, "", "### " * 50]
    rng.shuffle(texts)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_each_stage_on_its_input(spark, tmp_path):
    sf = str(tmp_path)
    items = tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, []
    for _, stage in c.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        ids.append((before, {r.doc_id for r in docs.collect()}))
    (all_, good), (b2, one), (b3, clean), (b4, safe) = ids
    assert good == {k for k, t in all_.items() if not rules(t)[-1]}
    assert one == {d for d, _, least in groups(list(b2.items())) if d == least}
    assert clean == {k for k, t in b3.items() if not any(leak(t, i) for i in items)}
    assert safe == {k for k, t in b4.items() if not secrets(t)[0]}
    assert len(all_) > len(good) > len(one) > len(clean) > len(safe) > 60
    packed = c.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == safe


def test_edge_cases(spark, tmp_path):
    """Null source and doc_id, repeated rows, a very long text, clashing columns, an empty benchmark, an empty table."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefghilmnoprst", k=5)) for _ in range(n))
    lone, twice, long = say(60), say(60), say(30000)
    rows = [(1, lone, None), (2, twice, "a"), (2, twice, "a"), (3, long, "a"), (None, say(70), "a"), (4, None, None), (5, "", "a"), (6, "few words", "a"), (7, twice, "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, _kept int, row long, sequence_id string"
    full = [(d, t, "en", s, len(t or ""), "clash", 1, 2, "x") for d, t, s in rows]
    for name, own in (("full", full), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in c.STAGES[:-1]:
            kept = stage(spark, docs, sf)
            assert kept.columns == docs.columns
        packed = c.run(spark, sf).collect()
        assert sorted({r.doc_id for r in packed}, key=str) == ([1, 2, 3, None] if own else [])
        assert sum(r.length for r in packed if r.doc_id == 3) > 30000 or not own
        assert sum(r.doc_id == 2 for r in packed) == (2 if own else 0)

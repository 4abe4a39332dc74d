import hashlib
import random
import re
import string

from pointweave.llm import secrets as s

SCHEMA = "doc_id long, text string, _base string, row int"
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(text):
    text, out = text or "", []
    for i, (rx, group, least) in enumerate(((ASSIGN, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))):
        out += [(m.start(), i, m.end()) for m in rx.finditer(text) if len(m.group(group)) >= least]
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)), [sum(k == i for _, k, _ in out) for i in range(3)]


def cases():
    rng = random.Random(7)
    prose = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(300))
    token = lambda n, a: "".join(rng.choices(a, k=n))
    return [
        None, "", prose, "password=abcde", "PassWord = 'abcdef' passwd:\"x1y2z3\" secret  :  tok.en-1/2_3", "token=token: abcdefg", "api_key==abc123 APIKEY: q", "é漢\U0001f600 token: \"abcdef\"é AKIA" + "Z" * 16,
        "AKIAAKIA" + "B" * 9, "x" + "AKIA" + "0" * 20 + "y", "deadbeef" * 3, "deadbeef" * 2 + "deadbee", "password=" + "deadbeef" * 4, prose + " " + token(48, string.ascii_letters + string.digits) + " " + prose,
        "id " + token(40, string.ascii_letters + string.digits + "+/") + "==", "see averylongcompoundwordwithoutanyspacesinsideit now", "under_score_names_in_code_are_long_too", "-" * 80, "=" * 50, "1" * 40, "token=" + "a1" * 5000, ("secret: abcdef " * 3000),
        "tokenpasswordsecret=abcdefg", "Kpassword ſecret=abcdef", "AKIA" + "7" * 15, "ff" * 2000,
    ]


def test_patterns_equal_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(cases() * 2)]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        digest, counts = brute(text)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == counts, text
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), text
        assert set(digest.split(",")) - {""} <= set(r.spans.split(","))
        assert r.n_random == r.spans.count("random:")


def test_battery_finds_random_tokens_and_leaves_words(spark):
    rng = random.Random(1)
    alphabet = string.ascii_letters + string.digits + "+/"
    planted = [("key " + "".join(rng.choices(alphabet, k=44)) + " end") for _ in range(200)]
    words = ["".join(rng.choices(["the", "inter", "na", "tion", "al", "ing", "re", "Con"], k=12)) + " and more" for _ in range(400)]
    got = s.scan(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(planted + words)], SCHEMA)).collect()
    found = {r.doc_id for r in got if r.n_random}
    assert len(found & set(range(200))) >= 190 and not found - set(range(200))


def test_drop_leaky_and_empty(spark):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(cases())], SCHEMA)
    out = s.drop_leaky(df)
    assert out.columns == df.columns
    clean = {r.doc_id for r in s.scan(df).where("spans = ''").collect()}
    assert {r.doc_id for r in out.collect()} == clean and {0, 1, 2} <= clean
    none = spark.createDataFrame([], SCHEMA)
    assert s.scan(none).count() == 0 and s.drop_leaky(none).count() == 0

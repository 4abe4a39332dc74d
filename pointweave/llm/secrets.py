"""Secret scan (DataFrame functions only): three fixed patterns, and a randomness test battery.

Patterns give the kinds ``assign``, ``access`` and ``hex``. The battery adds ``random`` spans: every maximal run of 20 or
more token characters that no pattern span touches is a candidate. Its encoding is inferred from its characters
(hex, base 32, base 36, base 64) and fixes the alphabet for three tests of the hypothesis "uniform random":

* chi-squared uniformity of the alphabet (Wilson-Hilferty z);
* Wald-Wolfowitz runs above and below the alphabet's middle;
* lag-1 serial correlation of the alphabet positions.

A candidate that passes all three still has to be unlikely as ordinary text: the likelihood ratio of the uniform
alphabet against a fixed model of prose is an e-value, so exp(-ratio) bounds its p-value, and it falls with length.
Benjamini-Hochberg runs per length band over the whole table's candidates (counted in a histogram of bounded size).

Null text counts as empty: no spans, and the digest of the empty string. Repeated rows are scanned row by row; other
columns do not matter. Positions are code points, end exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import let, materialize

#: The patterns, by kind in listed order, and the group whose length counts with its least length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PATTERNS = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Prose model: share of each character class, spread evenly over the class.
PROSE = {"lower": (0.90, 26), "upper": (0.06, 26), "digit": (0.03, 10), "other": (0.01, 4)}
#: Two-sided limit of each test's z value, and the false-discovery rate.
Z_LIMIT, FDR = 3.3, 1e-3
BANDS = (20, 32, 64, 128)

_SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches whose group is long enough. Positions are sums over gaps and matches."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["whole"])
        span = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        kept = F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(stop.cast("int").alias("at"), kept.alias("out"))

    zipped = let(whole, lambda w: F.arrays_zip(w.alias("whole"), F.slice(gaps, F.lit(1), F.size(w)).alias("gap"), value.alias("value")))
    none = F.array().cast(_SPAN)
    done = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), place, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), done).otherwise(none)


def _count(token: Column, characters: str) -> Column:
    return F.length(token) - F.length(F.translate(token, characters, ""))


_LOWER, _UPPER, _DIGIT, _OTHER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"


def _encoding(token: Column) -> Column:
    return F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[0-9a-z]+$"), "base36").otherwise("base64")


def _pick(encoding: Column, values: dict) -> Column:
    out = F.lit(values["base64"])
    for k in ("base36", "base32", "hex"):
        out = F.when(encoding == k, F.lit(values[k])).otherwise(out)
    return out


def _evidence(token: Column) -> Column:
    """Log likelihood ratio of the uniform alphabet against prose; exp(-evidence) bounds the p-value as prose."""
    t = F.rtrim(token, F.lit("="))

    def body(t: Column) -> Column:
        base = _pick(_encoding(t), {k: -math.log(len(v)) for k, v in ALPHABETS.items()})
        classes = zip((_LOWER, _UPPER, _DIGIT, _OTHER), PROSE.values(), strict=True)
        return sum((_count(t, chars) * (base - math.log(share / n)) for chars, (share, n) in classes), F.lit(0.0))

    return let(t, body)


def _passes_battery(token: Column) -> Column:
    """Whether none of the three tests rejects uniform randomness over the inferred alphabet."""

    def body(t: Column) -> Column:
        e = _encoding(t)
        folded = F.when(e == "hex", F.lower(t)).otherwise(F.translate(t, "-_", "+/"))
        alphabet, size = _pick(e, ALPHABETS), _pick(e, {k: float(len(v)) for k, v in ALPHABETS.items()})
        positions = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(F.struct(positions.alias("v"), size.alias("a")), tests)

    def tests(s: Column) -> Column:
        v, a, n = s["v"], s["a"], F.size(s["v"]).cast("double")
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
        squares = total(F.transform(F.array_distinct(v), lambda d: F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), F.lit(2.0))))
        df, chi = a - 1, F.greatest(squares * a / n - n, F.lit(0.0))
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = total(F.transform(v, lambda x: F.when(x >= a / 2, 1.0).otherwise(0.0)))
        changes = total(F.transform(v, lambda x, i: F.when((i > 0) & ((x >= a / 2) != (F.get(v, i - 1) >= a / 2)), 1.0).otherwise(0.0)))
        expected = 1 + 2 * high * (n - high) / n
        variance = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(variance > 0, (changes + 1 - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(99.0)
        mean = total(v) / n
        below = total(F.transform(v, lambda x: F.pow(x - mean, F.lit(2.0))))
        above = total(F.transform(v, lambda x, i: F.when(i > 0, (x - mean) * (F.get(v, i - 1) - mean)).otherwise(0.0)))
        z_serial = F.when(below > 0, above / F.greatest(below, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(99.0)
        return (z_chi < Z_LIMIT) & (F.abs(z_runs) < Z_LIMIT) & (F.abs(z_serial) < Z_LIMIT)

    t = F.rtrim(token, F.lit("="))
    return (F.length(t) >= 16) & let(t, body)


def _candidates(base: Column, text: Column) -> Column:
    """Token runs that no pattern span touches."""
    runs = _spans(text, CANDIDATE, 0, 20, KINDS.index("random"))
    return let(base, lambda own: F.filter(runs, lambda r: ~F.exists(own, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))))


def _band(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS[1:], 1):
        out = F.when(length >= least, i).otherwise(out)
    return out


def thresholds(df: DataFrame, text: str) -> dict[int, float]:
    """Least evidence per length band under Benjamini-Hochberg; from a histogram of at most 4 x 1601 rows."""
    return _limits(df.select(F.explode(_scan(F.col(text))["candidates"]).alias("c")).select("c.value"))


def _limits(tokens: DataFrame) -> dict[int, float]:
    bins = tokens.select(_band(F.length("value")).alias("band"), F.least(F.floor(4 * F.greatest(_evidence(F.col("value")), F.lit(0.0))), F.lit(1600)).alias("bin"))
    found: dict[int, float] = {}
    rows = bins.groupBy("band", "bin").count().collect()
    for band in range(len(BANDS)):
        own = sorted(((r["bin"], r["count"]) for r in rows if r["band"] == band), reverse=True)
        m, k = sum(n for _, n in own), 0
        for b, n in own:
            k += n
            if -b / 4 <= math.log(FDR * k / m):
                found[band] = b / 4
    return found


def _scan(text: Column) -> Column:
    """Struct of the pattern spans and the candidates of a whole text."""

    def from_text(t: Column) -> Column:
        base = F.array_sort(F.concat(*[_spans(t, *PATTERNS[k], i) for i, k in enumerate(KINDS[:3])]))
        return let(base, lambda b: F.struct(b.alias("base"), _candidates(b, t).alias("candidates")))

    return let(F.coalesce(text, F.lit("")), from_text)


def _random(candidates: Column, limits: dict[int, float]) -> Column:
    """The candidates that pass the battery and the false-discovery control."""

    def chosen(c: Column) -> Column:
        least = F.lit(float("inf"))
        for band, value in limits.items():
            least = F.when(_band(F.length(c["value"])) == band, value).otherwise(least)
        return F.when(_evidence(c["value"]) >= least, _passes_battery(c["value"])).otherwise(False)

    return F.filter(candidates, chosen)


def _digest(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _by_place(spans: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return keyed


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, the count of each kind, the digest of the pattern spans, and all spans as text."""
    found = materialize(df.select(F.col(key).alias("doc_id"), _scan(F.col(text)).alias("s")), "spans")  # texts are read once
    limits = _limits(found.select(F.explode("s.candidates").alias("c")).select("c.value"))
    found = found.select("doc_id", F.col("s.base").alias("base"), _random(F.col("s.candidates"), limits).alias("more"))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    every = _digest(_by_place(F.concat("base", "more")))
    return found.select("doc_id", *counts, F.sha2(_digest(_by_place(F.col("base"))), 256).alias("base_sha256"), every.alias("spans"), F.size("more").cast("long").alias("n_random"))


def drop_leaky(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows without any secret, with the input's columns."""
    limits = thresholds(df, text)
    clean = let(_scan(F.col(text)), lambda s: F.when(F.size(s["base"]) == 0, F.size(_random(s["candidates"], limits)) == 0).otherwise(False))
    return df.select(F.struct("*").alias("row"), clean.alias("clean")).where("clean").select("row.*")

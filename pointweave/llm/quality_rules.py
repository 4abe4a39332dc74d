"""Host-level quality rules (DataFrame functions only).

Every document is held against text rules. Failures are counted by host (the ``source`` column), each host's failure
rate is shrunk with a beta prior fitted to all hosts by the method of moments, and the host's verdict is joined back:

* ``blocked`` (shrunk rate >= 0.8): every document goes;
* ``watched``: a document that fails any soft rule goes;
* ``trusted`` (shrunk rate < 0.02): one soft failure is forgiven, two are not.

A document that fails a base rule always goes. Null text counts as empty (0 words: fails). A null host is a host of
its own. Repeated doc_ids are judged row by row. Further input columns are ignored (``quality_rules``) or returned
untouched (``keep_good``). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import WORD_GAP, let, materialize, small

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8
SOFT_SYMBOLS_PER_WORD = 0.25
SOFT_DUP_LINES = 0.3
SOFT_WORD_CHARS = (2.0, 14.0)
BLOCKED, TRUSTED = 0.8, 0.02

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more; windows holds one hash per window, by first word."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        kept = F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    def width(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(let(pairs, repeated), width)


def measures(text: Column) -> Column:
    """The rule measures of a whole text as one struct. Arrays are bound, so that no rewrite repeats them by element."""

    def windows(h: Column) -> Column:
        n = F.size(h)
        return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def from_text(t: Column) -> Column:
        words = F.transform(F.filter(F.split(t, WORD_GAP, -1), lambda w: w != ""), lambda w: F.xxhash64(w))
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(words, lambda h: let(lines, lambda x: let(windows(h), lambda v: out(t, h, x, v))))

    def out(t: Column, h: Column, lines: Column, v: Column) -> Column:
        repeats = F.when(F.size(F.array_distinct(v)) < F.size(v), _covered(v)).otherwise(0)
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeats.cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return let(F.coalesce(text, F.lit("")), from_text)


def _base(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def _soft(q: Column) -> Column:
    """How many soft rules fail."""
    chars = q["word_chars"] / F.greatest(q["n_words"], F.lit(1))
    rules = [q["n_symbols"] > SOFT_SYMBOLS_PER_WORD * q["n_words"], q["n_dup_lines"] > SOFT_DUP_LINES * q["n_lines"], ~chars.between(*SOFT_WORD_CHARS)]
    return sum((F.when(r, 1).otherwise(0) for r in rules), F.lit(0))


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate. Counts are combined before the shuffle."""
    failed = (_base(F.col("_q")) | (_soft(F.col("_q")) > 0)).cast("long")
    hosts = materialize(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed")), "hosts")
    t = hosts.agg(F.sum("n"), F.sum("failed"), F.count(F.lit(1)), F.sum(F.col("failed") * F.col("failed") / F.col("n"))).first()
    n, f, k, sq = (float(x or 0) for x in t)
    m = min(max(f / n if n else 0.0, 1e-6), 1 - 1e-6)
    spread = max((sq / n - m * m if n else 0.0) - m * (1 - m) * k / max(n, 1.0), 1e-9)
    strength = min(max(m * (1 - m) / spread - 1, 2.0), 1e4)
    return hosts.withColumn("rate", (F.col("failed") + m * strength) / (F.col("n") + strength))


def _judged(measured: DataFrame, hosts: DataFrame) -> DataFrame:
    """Appends the verdict to rows with host and _q."""
    hosts = small(hosts.select(F.col("host").alias("_host"), F.col("rate").alias("_rate")), 64)
    out = measured.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    soft, rate = _soft(F.col("_q")), F.col("_rate")
    verdict = F.when(rate >= BLOCKED, False).when(rate < TRUSTED, soft < 2).otherwise(soft == 0)
    failed = _base(F.col("_q"))
    return out.withColumn("_failed", failed).withColumn("_kept", F.when(failed, False).otherwise(F.coalesce(verdict, soft == 0)))


def quality_rules(df: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, measures, base_failed, kept, host_rate."""
    measured = materialize(df.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), measures(F.col(text)).alias("_q")), "measures")
    out = _judged(measured, host_rates(measured))
    return out.select("doc_id", *[F.col("_q")[m].alias(m) for m in _MEASURES], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rate").alias("host_rate"))


def keep_good(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows whose verdict is kept, with the input's columns, whatever these are called."""
    rows = df.select(F.struct("*").alias("row"), F.col(host).alias("host"), measures(F.col(text)).alias("_q"))
    return _judged(rows, host_rates(rows)).where("_kept").select("row.*")

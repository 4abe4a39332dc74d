"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over text measures (trained on at most ``SAMPLE`` labelled documents, whole texts) gives each
document's evidence: its log odds less the sample's. Evidence meets a prior that is learned by place: a host (``source``)
has a rate of good documents that is shrunk toward the global one, and each path of the host (host and ``lang``) a rate that
is shrunk toward the host's. Sparse places stay near their parents; shrinkage strengths come from the spread of
rates between places (method of moments). Rates are grouped sums of the documents' own posteriors under the global prior, so
unlabelled documents count too, and they are combined before the shuffle.

``score`` is the posterior that a document is good; it is kept at ``score >= THRESHOLD``. Null text has no words and
is judged by that. A null host or path is a place of its own. Repeated doc_ids are judged row by row. Without labels of both
kinds the evidence is 0 and everything is kept. Other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches, materialize, small
from pointweave.llm.wordhash import slices, white_space, words

SAMPLE, SAMPLE_BYTES = 6000, 24 << 20
THRESHOLD = 0.5
RIDGE, STEPS = 1.0, 30
RATE_BOUNDS = (0.02, 0.98)

#: Byte classes whose shares are measured.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "bar": b"|", "symbol": b"#*$%&<>_=~^@\\{}[]", "line": b"\n", "quote": b"\"'()", "slash": b"/-+",
}


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    rows, size = len(bounds) - 1, np.maximum(np.diff(bounds), 1).astype(float)
    out = np.zeros((rows, len(CLASSES) + 6))
    some = np.flatnonzero(np.diff(bounds))
    for k, chars in enumerate(CLASSES.values()):
        own = np.zeros(256, np.int64)
        own[list(chars)] = 1
        if len(some):
            out[some, k] = np.add.reduceat(own[data], bounds[some]) / size[some]
    newline = np.zeros(256, bool)
    newline[10] = True
    w, at = words(data, bounds, white_space())
    lines, line_at = words(data, bounds, newline)
    k = len(CLASSES)
    for i in range(rows):
        own, line = w[at[i] : at[i + 1]], lines[line_at[i] : line_at[i + 1]]
        n = len(own)
        distinct = len(np.unique(own)) if n else 0
        out[i, k : k + 6] = (np.log1p(n), distinct / max(n, 1), np.log1p(n) * distinct / max(n, 1), len(np.unique(line)) / max(len(line), 1), min(size[i] / max(n, 1), 40.0), n / max(len(line), 1) < 4)
    return out


class Logistic:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z, w = self._design(x), np.zeros(2 * x.shape[1] + 1)
        penalty = np.full(len(w), RIDGE)
        penalty[0] = 1e-6
        for _ in range(STEPS):  # Newton
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + penalty * w
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        rate = y.mean()
        self.prior = float(np.log(rate / (1 - rate)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, z * z])

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w - self.prior, -30, 30)


def train(docs: DataFrame, labels: DataFrame) -> Logistic | None:
    """docs: doc_id, text. labels: doc_id, good (0 or 1)."""
    labels = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    n = labels.count()
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))))
    picked = materialize(picked, "labels")
    x, y, size = [], [], 0
    own = docs.join(small(picked, 24), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")  # the same rows in every run
    for r in own.select("text", "good").toLocalIterator():  # about SAMPLE rows
        raw = (r["text"] or "").encode()
        size += len(raw)
        if size > SAMPLE_BYTES and len(x) >= 200:
            break
        x.append(measures(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        y.append(r["good"])
    y = np.array(y, float)
    return Logistic(np.vstack(x), y) if len(set(y)) == 2 else None


def _evidence(model: Logistic | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.evidence(measures(data, bounds)) if model else np.zeros(len(bounds) - 1) for _, data, bounds in slices(batch.column(3))]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.float64())], ["doc_id", "host", "path", "evidence"])

    return run


def _shrunk(places: DataFrame, parent_rate, strength: float) -> DataFrame:
    return places.withColumn("rate", (F.col("good") + strength * parent_rate) / (F.col("n") + strength))


def _strength(places: DataFrame) -> float:
    """How many documents a parent's rate counts for, by the spread of rates between places."""
    t = places.agg(F.sum("n"), F.sum("good"), F.count(F.lit(1)), F.sum(F.col("good") * F.col("good") / F.col("n"))).first()
    n, good, k, squares = (float(v or 0) for v in t)
    m = min(max(good / n if n else 0.5, 1e-3), 1 - 1e-3)
    spread = max((squares / n if n else 0) - m * m - m * (1 - m) * max(k - 1, 0) / max(n, 1), 1e-7)
    return min(max(m * (1 - m) / spread - 1, 5.0), 5000.0)


def classify(df: DataFrame, labels: DataFrame, text: str = "text", host: str = "source", path: str = "lang", key: str = "doc_id", label: str = "quality", label_key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, evidence, host_rate, path_rate, score, kept."""
    lean_batches(df.sparkSession)
    own = df.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    model = train(own.select("doc_id", "text"), labels.select(F.col(label_key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")))
    scored = materialize(own.mapInArrow(_evidence(model), "doc_id long, host string, path string, evidence double"), "evidence")
    prior = model.prior if model else 10.0
    good = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(good).alias("good")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    t = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (t[1] or 0.0) / t[0] if t[0] else 0.5
    hosts = _shrunk(hosts, F.lit(overall), _strength(hosts)).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    strength = _strength(paths)
    paths = _shrunk(paths, F.col("host_rate"), strength).select("h", F.col("path").alias("p"), "host_rate", F.col("rate").alias("path_rate"), F.col("n").alias("of"), F.col("good").alias("among"))
    paths = small(materialize(paths, "rates"), 80)
    out = scored.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    # what a document says itself counts once: its own place's rate is taken over the others there
    others = (F.col("among") - good + strength * F.col("host_rate")) / (F.col("of") - 1 + strength)
    rate = F.greatest(F.least(others, F.lit(RATE_BOUNDS[1])), F.lit(RATE_BOUNDS[0]))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= THRESHOLD).alias("kept"))

"""Toxicity by maximum-scoring segments.

Fit: each word gets the log-odds of toxic against other text with Dirichlet priors, shrunk to its lower
confidence bound; counts are of distinct contexts (word before, word, word after), so that copies of one
text count once. Words with a clear bound keep their weight, all others share one small negative score.

Score: a linear scan (Ruzzo and Tompa) finds every maximal-scoring segment of a text. The best segment of
n words has the extreme-value probability 1 - exp(-K n exp(-lambda S)) in other text; lambda solves
sum(p * exp(lambda * s)) = 1 over the background word rates p. A logistic curve on -log10 of that
probability, fitted on the labelled rows, gives the score.

The fit uses labelled rows with crc32(id as text) mod ``folds`` != 0, at most about ``fit_rows`` of them,
chosen by a hash of the id; so all that is learnt and broadcast is bounded by that parameter. Scoring
reads every text whole and shuffles nothing.

Edge cases: null and empty texts have no segment and get the score of no evidence. Without labels of both
kinds the score is the share of toxic labels (0.5 without labels). Labels that are null or without a document are
ignored; with several labels for one id the largest counts. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import table, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def maximal_segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), in linear time.

    hits: (place, positive score), in order; every place between them scores gap, which is negative.
    """
    stack: list[list] = []  # [begin, end, sum before, sum with it, link to the last one with a smaller sum before]
    total, last = 0.0, -1
    for at, score in hits:
        total += gap * (at - last - 1)
        last = at
        seg = [at, at + 1, total, total + score, -1]
        total += score
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                seg[4] = j
                stack.append(seg)
                break
            seg[0], seg[2] = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
    return [(b, e, r - left) for b, e, left, r, _ in stack]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    gap: float = -0.01
    scale: float = 1.0
    k: float = 1e-3
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def surprise(self, best: float, n: int) -> float:
        """-log10 of the chance that the best segment of n words of other text scores this much."""
        if best <= 0:
            return 0.0
        log_e = math.log(self.k * n) - self.scale * best
        return -log_e / math.log(10) if log_e < -30 else -math.log10(-math.expm1(-math.exp(min(log_e, 700))))

    def segments(self, text: bytes | None) -> tuple[list[tuple[int, int, float]], int]:
        words = WORD.findall((text or b"").lower())
        known = self.weights
        hits = [(k, known[w]) for k, w in enumerate(words) if w in known]
        return maximal_segments(hits, self.gap) if hits else [], len(words)

    def score(self, surprise: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * surprise + c * math.log1p(surprise)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method; the first column is the intercept and isn't shrunk."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _contexts(batches):
    for batch in batches:
        words, contexts, toxic = [], [], []
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            w = WORD.findall((text.as_py() or b"").lower())
            seen = set(zip([b"", *w], w, [*w[1:], b""], strict=False))
            words += [x[1] for x in seen]
            contexts += [hash_context(a, c) for a, _, c in seen]
            toxic += [label] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(contexts, pa.int64()), pa.array(toxic, pa.int32())], ["word", "context", "label"])


def hash_context(before: bytes, after: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(before + b" " + after) - (1 << 63)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, fit_rows: int) -> DataFrame:
    """text (bytes) and label of about fit_rows labelled rows at most, none of the held-out fold; no other column of docs is read."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != 0)
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(known, "id").select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fit_rows: int = 20_000, prior: float = 0.5, bound: float = 2.0) -> Model:
    rows = written(training_rows(docs, labels, label, id_col, text_col, folds, fit_rows), "toxic-fit")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        share = size.get(1, 0) / sum(size.values()) if size else 0.5
        return Model(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    counts = rows.mapInArrow(_contexts, "word binary, context long, label int").distinct()
    counts = counts.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    counts = written(counts, "toxic-words")
    total = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    all1, all0 = total["n1"] or 1, total["n0"] or 1
    odds = F.log((F.col("n1") + prior) / (F.lit(all1) - F.col("n1") + prior)) - F.log((F.col("n0") + prior) / (F.lit(all0) - F.col("n0") + prior))
    weight = odds - bound * F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    found = counts.where("n1 >= 3").withColumn("weight", weight).where("weight > 1").collect()  # of a bounded sample
    model = Model({bytes(r["word"]): r["weight"] for r in found})
    rate1, rate0 = (max(1e-9, sum(r[k] for r in found) / n) for k, n in (("n1", all1), ("n0", all0)))
    model.gap = min(-0.002, math.log((1 - min(rate1, 0.9)) / (1 - min(rate0, 0.5))))
    rates = [((r["n0"] + prior) / all0, r["weight"]) for r in found]
    rest = max(1e-9, 1 - sum(p for p, _ in rates))
    low, high = 1e-3, 50.0
    for _ in range(80):  # the positive root of sum(p * exp(scale * s)) = 1
        mid = (low + high) / 2
        over = sum(p * math.exp(min(700, mid * s)) for p, s in rates) + rest * math.exp(mid * model.gap) > 1
        low, high = (low, mid) if over else (mid, high)
    model.scale, model.k = (low + high) / 2, max(rate0, 1e-6)
    surprise = [(r["surprise"], r["label"]) for r in measured(rows, model, ["label"]).select("surprise", "label").collect()]
    x = np.array([[1, s, math.log1p(s)] for s, _ in surprise])
    model.curve = tuple(logistic(x, np.array([y for _, y in surprise], float)))
    return model


def measured(rows: DataFrame, model: Model, carry: list[str], significant: float = 2.0) -> DataFrame:
    """carry, surprise, and the segments whose own surprise is significant: begin, end (in words) and score. rows: with text (bytes)."""
    block = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = block.value
        for batch in batches:
            surprise, segments = [], []
            for text in batch.column("text"):
                found, n = m.segments(text.as_py())
                surprise.append(m.surprise(max((s for _, _, s in found), default=0.0), n))
                segments.append([{"begin": b, "end": e, "score": s} for b, e, s in found if m.surprise(s, n) >= significant])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(surprise, pa.float64()), pa.array(segments, kind)], [*carry, "surprise", "segments"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(*carry, "text").mapInArrow(scan, kinds + ", surprise double, segments array<struct<begin: bigint, end: bigint, score: double>>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from 0.5 up) and the significant segments of each document."""
    found = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), model, ["id"])
    a, b, c = model.curve
    value = F.lit(a) + F.lit(b) * F.col("surprise") + F.lit(c) * F.log1p("surprise")
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))))
    return found.select(F.col("id").alias(id_col), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "segments")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("segments").cast("long").alias("n_segments"))

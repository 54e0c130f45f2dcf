"""Operator 4, language ID: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by FTRL-proximal with elastic net, calibrated by a
temperature.

1. Document frequencies of the hashed character 1- to 3-grams are counted in
   Spark over all training rows (per task a dense count, then one sum).
2. The regression is fitted on a bounded sample of labelled rows, about
   ``per_class`` of each label, drawn by a hash of the id; the driver gets
   their sparse vectors (whole texts, counted in the tasks), not texts.
3. A fifth of the sample (by hash) is left out of the fit and sets the
   temperature.
4. Every text is scored in the tasks that read it; nothing is shuffled.

Cases: null text or one without a letter gets ``und`` and score 0 (so does
every text if no row can be learned from); a null label is not learned; ties
go to the label first in order; repeated rows are scored alike; extra columns
are ignored; an empty table gives an empty result."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 16
UNKNOWN = "und"


def grams(text: str, orders: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the text's character n-grams (case-folded)."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts = []
    for n in range(1, orders + 1):
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + c[k:len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        parts.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(every) < 6000:
        return np.unique(every, return_counts=True)
    counts = np.bincount(every, minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector: buckets and values."""
    at, counts = grams(text)
    return at, _unit(counts, idf[at])


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and the number of documents."""
    def run(batches):
        total, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            for text in b.column(0):
                total[grams(text.as_py() or "")[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))],
                                         ["bucket", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**16 + 1 rows
    df = np.zeros(1 << BUCKET_BITS, np.int64)
    known = counts[counts["bucket"] >= 0]
    df[known["bucket"].to_numpy()] = known["n"].to_numpy()
    return df, int(counts.loc[counts["bucket"] < 0, "n"].sum())


def ftrl(rows, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3,
         l2: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights (classes, buckets + 1) of FTRL-proximal over sparse rows
    ``(label, buckets, values)``; the last column is the intercept."""
    dim = (1 << BUCKET_BITS) + 1
    z, n = np.zeros((classes, dim)), np.zeros((classes, dim))

    def weights(at):
        zi, ni = z[:, at], n[:, at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, x = rows[i]
            at, x = np.append(at, dim - 1), np.append(x, 1.0)
            w = weights(at)
            p = softmax(w @ x)
            p[label] -= 1.0
            g = p[:, None] * x[None, :]
            g2 = g * g
            ni = n[:, at]
            z[:, at] += g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[:, at] = ni + g2
    return weights(np.arange(dim))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least log loss (golden-section search)."""
    if not labels:
        return 1.0

    def loss(log_t):
        return -sum(math.log(max(float(softmax(x / math.exp(log_t))[y]), 1e-12)) for x, y in zip(logits, labels))

    lo, hi, phi = math.log(0.02), math.log(10.0), (math.sqrt(5) - 1) / 2
    a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(30):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - phi * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + phi * (hi - lo)
            fb = loss(b)
    return math.exp((lo + hi) / 2)


def fit(training: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = 800, **ftrl_options) -> dict:
    """The model: labels, idf, weights and temperature, from ``training`` (rows
    that may be learned from)."""
    rows = training.where(F.col(label_col).isNotNull()) \
        .select(F.col(label_col).cast("string").alias("label"), F.col(id_col).cast("string").alias("id"),
                F.col(text_col).cast("string").alias("text"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return {"labels": []}
    df, n = document_frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1_000_000))
    limit = F.lit(0)
    for label, size in sizes.items():
        limit = F.when(F.col("label") == label, math.ceil(1_000_000 * min(1.0, per_class / size))).otherwise(limit)
    index = {label: i for i, label in enumerate(labels)}

    def run(batches):
        for b in batches:
            got = [grams(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([index[x.as_py()] for x in b.column(0)], pa.int32()), b.column(1),
                 pa.array([at.astype("<u2").tobytes() for at, _ in got], pa.binary()),
                 pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for _, c in got], pa.binary())],
                ["label", "held", "at", "counts"])

    sample = rows.where(draw < limit) \
        .select("label", (F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(5)), F.lit(5)) == 0).alias("held"), "text") \
        .mapInArrow(run, "label int, held boolean, at binary, counts binary").collect()
    vectors = []
    for r in sample:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        vectors.append((r["label"], at, _unit(np.frombuffer(r["counts"], "<u2").astype(float), idf[at]), r["held"]))
    # the order of training must not depend on the order of tasks
    vectors.sort(key=lambda v: (v[0], len(v[1]), v[1].tobytes(), v[2].tobytes()))
    learn = [v[:3] for v in vectors if not v[3]] or [v[:3] for v in vectors]
    w = ftrl(learn, len(labels), **ftrl_options)
    held = [v for v in vectors if v[3]]
    t = temperature([w[:, at] @ x + w[:, -1] for _, at, x, _ in held], [v[0] for v in held])
    return {"labels": labels, "idf": idf, "weights": w.astype(np.float32), "temperature": t}


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``lang_pred`` and ``score``;
    existing columns of these names are replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "__text")]
    schema = docs.select(*names).schema
    given = docs.select(*names, F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        labels = m["labels"]
        for b in batches:
            pred, score = [], []
            for text in b.column(b.num_columns - 1):
                text = text.as_py()
                if not labels or not text or not any(map(str.isalpha, text)):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, x = vector(text, m["idf"])
                p = softmax((m["weights"][:, at] @ x + m["weights"][:, -1]) / m["temperature"])
                k = int(np.argmax(p))
                pred.append(labels[k])
                score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double")



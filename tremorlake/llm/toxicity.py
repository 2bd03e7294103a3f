"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade <= j) = logistic(theta_j - w . x): the thresholds are ordered and share the
weights w; x has the log counts of selected words. The output is the expected severity,
the sum over grades of P(grade >= j).

Labels give toxic 0 or 1; grades 1 to 3 of toxic documents are thirds of the count of
indicator words, which for each half of the documents are found on the other half
(log-odds over toxic and other documents above INDICATOR), so a document's own words do
not decide which words count. The classifier is fitted on at most `sample` labelled
documents, those with the least hash of their doc_id. Words are counted and chosen in
Spark (`min_df` toxic documents, chi-square MIN_CHI, the `features` best); the counts of
the chosen ones go to one task, which fits, so the driver sees features and weights
alone. All documents are scored, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import prepare, signed
from .textkernel import NOT_ALNUM, Words, slices

GRADES = 4
INDICATOR = 3.0
#: Chi-square below which a word is no feature.
MIN_CHI = 12.0
PAIRS = np.dtype([("f", "<i4"), ("n", "<i4")])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Sparse:
    """Rows of (feature, value), enough for X w and X' r."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.shape[0])

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], minlength=self.shape[1])


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int, l2: float = 0.5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the penalised likelihood; thresholds are a first one and positive steps, so they stay ordered."""
    n, m = x.shape
    share = np.clip(np.array([(y <= j).mean() for j in range(grades - 1)]), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[:m], np.exp(p[m + 1 :])
        theta = p[m] + np.concatenate([[0], np.cumsum(gaps)])
        s = x.dot(w)
        up = np.where(y < grades - 1, _logistic(theta[np.minimum(y, grades - 2)] - s), 1.0)
        low = np.where(y > 0, _logistic(theta[np.maximum(y - 1, 0)] - s), 0.0)
        prob = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up) / prob, low * (1 - low) / prob
        g_theta = -np.bincount(np.minimum(y, grades - 2), du * (y < grades - 1), minlength=grades - 1) + np.bincount(np.maximum(y - 1, 0), dl * (y > 0), minlength=grades - 1)
        g_gaps = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([(x.tdot(du - dl) + l2 * w) / n, [g_gaps[0] / n], g_gaps[1:] * gaps / n])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p - 0.1 * (0.5 * (1 + np.cos(np.pi * t / steps))) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return p[:m], p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])


class Ordinal:
    """A fitted model: sorted feature hashes, their weights, thresholds."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.hashes, self.weights, self.thresholds = hashes, weights, thresholds

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return _logistic(s[:, None] - self.thresholds[None, :])


def _counts(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, log count) of known words."""
    if not len(known) or not len(words.hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    hit = known[at] == words.hashes
    key, n = np.unique(words.text_of_word()[hit] * np.int64(len(known)) + at[hit], return_counts=True)
    return key // len(known), key % len(known), np.log1p(n)


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) of the distinct words of each text, sorted."""
    w = Words(data, offsets, lower=True, separators=NOT_ALNUM)
    of = w.text_of_word()
    order = np.lexsort((w.hashes, of))
    h, of = w.hashes[order], of[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[first], h[first]


#: Classes of a sampled document: twice the half it is in, and one more where it is toxic.
CLASSES = 4


def _train(rows: list, table: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from rows (class, counts of features); table: documents of each class that hold a feature."""
    cls = np.array([r[0] for r in rows])
    a = np.frombuffer(b"".join(r[1] for r in rows), dtype=PAIRS)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) // PAIRS.itemsize for r in rows])
    col, times = a["f"].astype(np.int64), a["n"].astype(float)
    grade, toxic = np.zeros(len(rows), dtype=np.int64), cls % 2 == 1
    dose = np.zeros(len(rows))
    for half in (0, 1):
        neg, pos = (totals[2 * (1 - half) + i] for i in (0, 1))
        in_neg, in_pos = (table[:, 2 * (1 - half) + i] for i in (0, 1))
        odds = np.log((in_pos + 0.5) / (pos - in_pos + 0.5)) - np.log((in_neg + 0.5) / (neg - in_neg + 0.5))
        mine = cls[row] // 2 == half
        dose += np.bincount(row[mine], times[mine] * (odds[col[mine]] > INDICATOR), minlength=len(rows))
    if toxic.any():
        cuts = np.quantile(dose[toxic], [1 / 3, 2 / 3])
        grade[toxic] = 1 + (dose[toxic, None] > cuts[None, :]).sum(axis=1)
    return fit_ordinal(Sparse(row, col, np.log1p(times), (len(rows), len(table))), grade, GRADES)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, min_df: int = 3) -> Ordinal:
    """Fits on at most `sample` labelled documents; null labels and doc_ids are left out."""
    prepare(docs.sparkSession)
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    cls = 2 * F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) + F.when(F.col("toxic") > 0, 1).otherwise(0)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", cls.cast("int").alias("cls"))), "doc_id")  # `sample` rows at most

    def distinct(batches):
        held = [[] for _ in range(CLASSES)]
        for part, data, offsets in slices(batches, "text"):
            c = part.column(1).to_numpy(zero_copy_only=False)
            of, h = _distinct_words(data, offsets)
            for k in range(CLASSES):
                held[k].append(h[c[of] == k])
        for k in range(CLASSES):
            h, n = np.unique(np.concatenate(held[k]) if held[k] else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.full(len(h), k, dtype=np.int32)), pa.array(n.astype(np.int64))], names=["h", "cls", "n"])

    counted = own.select("text", "cls").mapInArrow(distinct, "h long, cls int, n long")
    by = [F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(CLASSES)]
    df = counted.groupBy("h").agg(*by)
    a, b = F.col("c1") + F.col("c3"), F.col("c0") + F.col("c2")
    totals = np.zeros(CLASSES)
    for r in own.groupBy("cls").count().collect():  # CLASSES rows
        totals[r["cls"]] = r["count"]
    pos, neg = float(totals[1] + totals[3]), float(totals[0] + totals[2])
    chi = F.try_divide((a * neg - b * pos) ** 2 * (pos + neg) / max(1.0, pos * neg), (a + b) * (pos + neg - a - b))
    top = df.where((a >= min_df) & (a * neg > b * pos)).withColumn("chi", chi).where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "h").limit(features)
    got = sorted((r["h"] % 2**64, r["c0"], r["c1"], r["c2"], r["c3"]) for r in top.collect())  # `features` rows at most
    known = np.array([r[0] for r in got], dtype=np.uint64)
    table = np.array([r[1:5] for r in got], dtype=float).reshape(-1, CLASSES)
    nothing = Ordinal(known[:0], np.zeros(0), np.full(GRADES - 1, 20.0))
    if not len(known):
        return nothing

    def rows(batches):
        for part, data, offsets in slices(batches, "text"):
            t, f, v = _counts(Words(data, offsets, lower=True, separators=NOT_ALNUM), known)
            at = np.searchsorted(t, np.arange(part.num_rows + 1))
            a = np.zeros(len(f), dtype=PAIRS)
            a["f"], a["n"] = f, np.rint(np.expm1(v))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "cls", "pairs"])

    def train(batches):
        every = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if every:
            w, theta = _train([x[1:] for x in every], table, totals)
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([theta.tolist()], pa.list_(pa.float64()))], names=["w", "theta"])

    # one task: `sample` rows of at most `features` counts
    fitted = own.select("doc_id", "text", "cls").mapInArrow(rows, "doc_id long, cls int, pairs binary").repartition(1).mapInArrow(train, "w array<double>, theta array<double>").collect()
    return Ordinal(known, np.array(fitted[0]["w"]), np.array(fitted[0]["theta"])) if fitted else nothing


def score(docs: DataFrame, model: Ordinal, threshold: float = 0.3) -> DataFrame:
    """docs' rows with expected_severity, grade (largest j with P(grade >= j) >= threshold, else 0) and toxic (grade > 0) added.

    threshold: 0.3 parts labelled held-out documents best (toxic ones score 0.3 or more, others 0.01 on average).
    Null and empty texts have no features. Columns of these names are replaced; others stay.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # `features` weights at most
    added = ["expected_severity", "grade", "toxic"]
    base = docs.drop(*added)

    def run(batches):
        m = shared.value
        for rows, data, offsets in slices(batches, "text"):
            t, f, v = _counts(Words(data, offsets, lower=True, separators=NOT_ALNUM), m.hashes)
            above = m.above(np.bincount(t, v * m.weights[f], minlength=rows.num_rows))
            out = [pa.array(above.sum(axis=1)), pa.array((above >= threshold).sum(axis=1).astype(np.int32)), pa.array(above[:, 0] >= threshold)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *out], names=[*rows.schema.names, *added])

    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    return base.mapInArrow(run, schema)

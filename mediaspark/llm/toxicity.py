"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text, util

#: Most toxic and most other labelled texts that the classifier is fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
#: Most features of the classifier; the least likelihood ratio (one in 2,000 by chance) and odds ratio of one.
FEATURES, LEAST_G, LEAST_ODDS = 4_096, 12.0, 10.0
#: Pull of each weight towards 0, in rows.
SHRINK = 0.3
PREFIXES = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, row) of all words and of the first bytes of longer words."""
    starts, ends, at = text.word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    parts = [text.word_hashes(data, starts, ends), *(text.prefix_hashes(data, starts, ends, k) for k in PREFIXES)]
    hashes = np.concatenate(parts)
    rows = np.tile(row, len(parts))
    real = hashes != 0
    return hashes[real], rows[real]


@dataclass
class Model:
    """P(grade > j) = sigmoid(weights . present features - thresholds[j]): one set of weights, ordered thresholds."""

    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def present(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) of the model's features, each once a row."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        hashes, rows = hashes[near], rows[near]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        both = np.unique(rows[hit] * len(self.keys) + at[hit])
        return both % len(self.keys), both // len(self.keys)

    def severity(self, feature: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Expected grade: the sum of the probabilities of passing each threshold."""
        score = np.bincount(row, self.weights[feature], n)
        return _sigmoid(score[:, None] - self.thresholds).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def select(rows: DataFrame) -> np.ndarray:
    """Features present in toxic texts far more often than in others: by the likelihood ratio of the two shares, and their odds.

    ``rows`` hold (toxic, hashes). Features are counted within tasks, then in Spark; at most FEATURES reach the driver.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, hashes = [], []
            for toxic, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes.append(np.frombuffer(raw.as_py(), np.int64))
                flags.append(np.full(len(hashes[-1]), toxic == 1))
            keys, at = np.unique(np.concatenate(hashes), return_inverse=True) if hashes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            flag = np.concatenate(flags) if flags else np.zeros(0, bool)
            counts = [np.bincount(at[flag == y], minlength=len(keys)) for y in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, counts)], ["h", "pos", "neg"])

    sizes = rows.agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).first()
    n1, n0 = float(sizes["n1"]), float(sizes["n0"])
    if not (n1 and n0):
        return np.zeros(0, np.uint64)
    pos, neg = F.col("pos"), F.col("neg")
    share = (pos + neg) / (n1 + n0)
    term = lambda k, n: k * F.log(F.greatest(k, F.lit(1e-9)) / (n * share)) + (n - k) * F.log(F.greatest(n - k, F.lit(1e-9)) / F.greatest(n * (1 - share), F.lit(1e-9)))
    odds = (pos + 0.5) * (n0 - neg + 0.5) / ((n1 - pos + 0.5) * (neg + 0.5))
    counts = rows.select("toxic", "hashes").mapInArrow(tally, "h bigint, pos bigint, neg bigint").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    marked = counts.filter("pos > 0").withColumns({"g": 2 * (term(pos, n1) + term(neg, n0)), "odds": odds}).filter((F.col("g") >= LEAST_G) & (F.col("odds") >= LEAST_ODDS))
    found = [r["h"] for r in marked.orderBy(F.desc("g"), "h").limit(FEATURES).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def fit(keys: np.ndarray, present: list[np.ndarray], toxic: np.ndarray, steps: int = 2_000) -> Model:
    """Fit on the indices of each text's features and whether it is toxic.

    The labels know toxic or not; of toxic texts those are grade 2 that hold more features than their median, the others
    are grade 1.
    """
    model = Model(keys, np.zeros(len(keys)), np.array([5.0, 7.0]))
    if not len(keys):
        return model
    n = len(present)
    row = np.repeat(np.arange(n), [len(x) for x in present])
    feature = np.concatenate(present).astype(np.int64)
    marked = np.array([len(x) for x in present])
    grade = np.where(toxic == 1, 1 + (marked > np.median(marked[toxic == 1])), 0)
    above = (grade[:, None] > np.arange(2)).astype(float)  # grade passes each threshold
    w, t = model.weights, np.array([2.0, np.log(2.0)])  # thresholds are t0 and t0 + exp(t1): always in order
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for k in range(1, steps + 1):
        cuts = np.array([t[0], t[0] + np.exp(t[1])])
        off = _sigmoid(np.bincount(row, w[feature], n)[:, None] - cuts) - above
        grads = np.bincount(feature, off.sum(1)[row], len(w)) / n + SHRINK / n * w, np.array([-off.sum(), -off[:, 1].sum() * np.exp(t[1])]) / n
        for x, g, a, b in zip((w, t), grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= 0.1 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    model.thresholds = np.array([t[0], t[0] + np.exp(t[1])])
    return model


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, hashes of the features) of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts, by hashes of ids and of features.

    Texts of the same features count once. Labels are bounded first, and texts again, as an id may have many.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = [known.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in (("toxic = 1", SAMPLE_TOXIC), ("toxic = 0", SAMPLE_CLEAN))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in text.chunks(batch.column(0)):
                hashes, row = features(data, offsets)
                order = np.argsort(row, kind="stable")
                hashes, at = hashes[order], np.searchsorted(row[order], np.arange(len(offsets)))
                rows += [np.unique(hashes[at[k] : at[k + 1]]).tobytes() for k in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["toxic", "hashes"])

    labelled = docs.select("doc_id", "text").join(F.broadcast(few[0].union(few[1])), "doc_id").select("text", "toxic")
    rows = labelled.mapInArrow(extract, "toxic int, hashes binary").withColumn("_h", F.xxhash64("hashes")).withColumn("_g", F.md5("hashes"))
    rows = util.save(rows.withColumn("_row", F.monotonically_increasing_id()), "labelled")
    once = rows.groupBy("_h", "_g", "toxic").agg(F.min("_row").alias("_row"))
    kept = [once.filter(kind).orderBy("_h", "_g", "toxic").limit(n).select("_row") for kind, n in (("toxic = 1", SAMPLE_TOXIC), ("toxic = 0", SAMPLE_CLEAN))]
    return util.save(rows.join(F.broadcast(kept[0].union(kept[1])), "_row").select("toxic", "hashes"), "sample")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the classifier; the driver gets the chosen features and which of them each text of the sample holds."""
    rows = _sample(docs, labels)
    keys = select(rows)
    model = Model(keys, np.zeros(len(keys)), np.zeros(2))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for raw in batch.column(1):
                hashes = np.frombuffer(raw.as_py(), np.uint64)
                held.append(model.present(hashes, np.zeros(len(hashes), np.int64))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], ["toxic", "held"])

    got = sorted(rows.mapInArrow(hold, "toxic int, held array<bigint>").collect(), key=lambda r: (r["toxic"], r["held"])) if len(keys) else []
    return fit(keys, [np.array(r["held"], np.int64) for r in got], np.array([r["toxic"] for r in got], np.int64))


def score(docs: DataFrame, labels: DataFrame, reject: float = 0.5, names: tuple[str, str] = ("severity", "rejected")) -> DataFrame:
    """All columns of ``docs`` with ``severity``, the expected grade of 0 to 2, and ``rejected``: severity of at least ``reject``.

    Columns of ``docs`` that have these names are replaced; other names can be given.

    The classifier is fitted on a bounded sample of labelled texts (SAMPLE_TOXIC, SAMPLE_CLEAN); every document is
    scored over its whole text, however long. Null, empty and wordless texts have no features and get the severity of
    none. Labels that are null, contradictory (toxic counts) or of absent documents are no obstacle; without labels
    of both kinds nothing is rejected. Features that are equally telling rank by hash; repeated rows get equal results,
    an empty table an empty one.
    """
    util.bound_batches(docs.sparkSession)
    model = train(docs, labels)

    @F.arrow_udf("double")  # only texts go to Python and only numbers come back, whatever other columns hold
    def predict(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for i, j, data, offsets in text.chunks(texts):
            out[i:j] = model.severity(*model.present(*features(data, offsets)), j - i)
        return pa.array(out)

    scored = docs.drop(*names).withColumn(names[0], predict("text"))
    return scored.withColumn(names[1], F.col(names[0]) >= reject)


def keep_civil(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    free = tuple(next(f"_{n}{k}" for k in range(len(docs.columns) + 1) if f"_{n}{k}" not in docs.columns) for n in ("severity", "rejected"))
    return score(docs, labels, reject, free).filter(~F.col(free[1])).select(docs.columns)

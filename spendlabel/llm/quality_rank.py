"""Quality scores by Bradley-Terry pairwise ranking.

A preference pair is a training document of quality 1 and one of quality 0; the model says
the first wins with probability sigmoid(w . (f1 - f0)), so logistic loss on feature
differences learns the weights. Features are shares that need only the text itself:
symbols, capitals, digits, exclamation, repeated neighbours and 3-word windows, distinct
words, duplicate lines, word length, line length and text length, each as a log and as an
indicator-like squash, standardised on the sample.

The threshold is a quantile of the training scores: the share of quality 0 among labelled
training rows lies below it. The reported score is a sigmoid with the slope learned on the
sample, shifted so that it is THRESHOLD at that quantile.

Fitted on every labelled training row: up to ``ROWS`` (half of either class) on the driver over
``PAIRS`` drawn pairs; more by Newton passes in Spark, over the pairs of small groups that each
row is dealt into by a hash of its id. Mean, scale, threshold and slope then are those of all
rows too (ranks to 1 in 100,000). Every whole text is scored.

Edge cases. Null or empty text: features of a text without words, scored like any other.
Null id: scored; held_out false. Null label: not used. Labels of one class only: score
0.5 everywhere. Repeated labels of one id: the least quality counts. Repeated rows and
ties: one row each, equal texts get equal scores. Empty table: empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut as stored, ship
from .learn import Adam, bounded_sample, fold, sigmoid

ROWS, PAIRS = 6_000, 60_000
PARTNERS, GROUP_ROWS = 8, 20_000
STEPS, RATE, L2 = 300, 0.05, 1e-3
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_SYMBOLS, _DIGITS = b"#*$%&|<>{}[]~^_=+\\/@", b"0123456789"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))


def _share(raw: bytes, what: bytes) -> float:
    return (len(raw) - len(raw.translate(None, what))) / max(1, len(raw))


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = [
        _share(raw, _SYMBOLS), _share(raw, b"!"), _share(raw, _DIGITS), _share(raw, b".,;:?"),
        _share(raw, _UPPER) / max(1e-3, _share(raw, _LETTERS)),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2),
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    logs = [np.log(n), np.log(max(1, len(raw)) / n), np.log(n / max(1, len(lines)))]
    return [f for s in shares for f in (np.log(max(s, 0) + 1e-3), max(s, 0) / (max(s, 0) + 0.1))] + logs


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float  # the quantile of training scores that THRESHOLD stands for

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        if not texts:
            return np.zeros(0)
        f = (np.array([text_features(t) for t in texts]) - self.mean) / self.scale
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return sigmoid(np.clip(self.slope * (np.clip(f, -8, 8) @ self.weights - self.cut) + shift, -30, 30))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Weights w by logistic loss on f(good) - f(bad) over ``pairs`` sampled pairs."""
    rng = np.random.default_rng(len(good) * 31 + len(bad))
    diff = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w, opt = np.zeros(diff.shape[1]), Adam(diff.shape[1], RATE)
    for _ in range(STEPS):
        lost = 1 - sigmoid(diff @ w)
        w = opt.step(w, -(diff * lost[:, None]).mean(0) + L2 * w)
    return w


def _fit_whole(docs: DataFrame, lab: DataFrame, bad_share: float) -> Model:
    """The model of all rows of ``lab`` (doc_id, quality) that have a document."""
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([text_features(t) for t in column(b, "text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column(b, "h"), column(b, "quality"), f], ["h", "quality", "f"])

    texts = (docs.select("doc_id", "text").join(lab, "doc_id").groupBy("doc_id")
             .agg(F.min("text").alias("text"), F.min("quality").cast("int").alias("quality"))
             .select(F.xxhash64("doc_id").alias("h"), "quality", "text"))
    rows = stored(texts.mapInArrow(featurise, "h long, quality int, f array<double>"), "quality_rows")
    count = dict(rows.groupBy("quality").count().collect())
    none = np.zeros(0)
    if len(count) < 2:
        return Model(none, none, none, 1.0, 0.0)
    stats = rows.select(F.posexplode("f").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).orderBy("i").collect()
    mean, scale = np.array([r[1] for r in stats]), np.array([r[2] for r in stats]) + 1e-6
    groups, w = _groups(rows, count), np.zeros(len(mean))
    loss, grad, curve = _pair_sums(groups, w, mean, scale)
    for _ in range(30):
        step = np.linalg.solve(curve + L2 * np.eye(len(w)), grad + L2 * w)
        found = _pair_sums(groups, w - step, mean, scale)
        while found[0] + L2 / 2 * ((w - step) ** 2).sum() > loss + L2 / 2 * (w**2).sum() + 1e-12 and abs(step).max() > 1e-6:
            step = step / 2
            found = _pair_sums(groups, w - step, mean, scale)
        w, (loss, grad, curve) = w - step, found
        if abs(step).max() < 1e-5:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = column(b, "f").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((f - mean) / scale, -8, 8) @ w)], ["s"])

    scores = rows.select("f").mapInArrow(score, "s double")
    at, low, high = scores.agg(F.percentile_approx("s", [bad_share, 0.05, 0.95], 100_000)).first()[0]
    above = scores.where(F.col("s") > at).agg(F.min("s")).first()[0]
    return Model(mean, scale, w, float(8 / (high - low + 1e-9)), float((at + (at if above is None else above)) / 2))


def _groups(rows: DataFrame, count: dict[int, int]) -> DataFrame:
    """(q[], f[][]): every row dealt by its hash into groups of about ``PARTNERS`` rows of the rarer
    class; where that would make groups of more than ``GROUP_ROWS``, the rarer rows are dealt into several."""
    rarer = min(count, key=lambda q: (count[q], q))
    n = max(1, count[rarer] // PARTNERS, sum(count.values()) // GROUP_ROWS)
    copies = max(1, -(-PARTNERS * n // count[rarer]))
    last = F.when(F.col("quality") == rarer, copies - 1).otherwise(0)
    dealt = rows.withColumn("g", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.groupBy(F.pmod(F.pmod("h", F.lit(n)) + F.col("g"), F.lit(n)).alias("g"))
    held = dealt.agg(F.sort_array(F.collect_list(F.struct("h", "quality", "f"))).alias("r"))
    return stored(held.select(F.col("r.quality").alias("q"), F.col("r.f").alias("f")), "quality_groups")


def _pair_sums(groups: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, its gradient and its curvature over all pairs of the groups, added up in the tasks."""
    d = len(w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + d + d * d)
        for b in batches:
            for i in range(b.num_rows):
                q = b.column(0)[i].values.to_numpy()
                f = np.clip((b.column(1)[i].values.flatten().to_numpy().reshape(len(q), d) - mean) / scale, -8, 8)
                diff = (f[q == 1][:, None] - f[q == 0][None]).reshape(-1, d)
                m = diff @ w
                lost = 1 - sigmoid(m)
                total += np.concatenate([[len(m), np.logaddexp(0, -m).sum()], -(diff * lost[:, None]).sum(0),
                                         (diff.T @ (diff * (lost * (1 - lost))[:, None])).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["t"])

    parts = groups.mapInArrow(add, "t array<double>").select(F.posexplode("t").alias("i", "v"))
    t = np.array([r[1] for r in parts.groupBy("i").agg(F.sum("v")).orderBy("i").collect()])
    t = t / max(t[0], 1)
    return float(t[1]), t[2:2 + d], t[2 + d:].reshape(d, d)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Model from ``labels`` (doc_id, quality) without the held-out fold."""
    mine = F.coalesce(fold("doc_id", folds), F.lit(held_out)) != held_out
    lab = labels.where(mine & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ship(docs.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [column(b, "quality"), pa.array([text_features(t) for t in column(b, "text").to_pylist()], pa.list_(pa.float64()))],
                ["quality", "f"])

    n, n_bad, n_good = lab.agg(F.count("*"), F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).first()
    if max(n_bad, n_good) > ROWS // 2:
        return _fit_whole(docs, lab.where(F.col("quality").isin(0, 1)), n_bad / n)
    rows = [(r.quality, r.f) for q in (0, 1)
            for r in bounded_sample(docs, lab.where(F.col("quality") == q).withColumn("quality", F.col("quality").cast("int")), ROWS // 2)
            .select("quality", "text").mapInArrow(featurise, "quality int, f array<double>").toLocalIterator()]
    none = np.zeros(0)
    if len({q for q, _ in rows}) < 2:
        return Model(none, none, none, 1.0, 0.0)
    rows.sort()  # the same order at any partitioning
    y = np.array([q for q, _ in rows])
    f = np.array([f for _, f in rows])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    f = np.clip((f - mean) / scale, -8, 8)
    w = bradley_terry(f[y == 1], f[y == 0])
    s = f @ w
    # the sample holds as many of either class as it can; the quantile is that of all labels
    weight = np.where(y == 0, n_bad / max(1, (y == 0).sum()), (n - n_bad) / max(1, (y == 1).sum()))
    order = np.argsort(s, kind="stable")
    mass = np.cumsum(weight[order]) / weight.sum()
    at = min(len(s) - 2, int(np.searchsorted(mass, n_bad / n)))
    cut = float((s[order[at]] + s[order[at + 1]]) / 2)
    spread = np.subtract(*np.percentile(s, [95, 5])) + 1e-9
    return Model(mean, scale, w, float(8 / spread), cut)


def quality(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT,
            threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(column(b, "text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text",
                       F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")

"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary linear classifier per bit, on hashed words, their
affix n-grams and, in scripts without spaces, character n-grams, predicts the bit. Decoding compares the bit margins with every codeword:
each bit's loss log(1 + exp(-code * margin)) is weighted by how well that bit's classifier did on
the sample, and the codeword of least weighted loss wins. The score is the softmax of the
negative losses at the winner; a text is ``ambiguous`` when the second codeword is close
(score below ``CLEAR``).

Codes are the exhaustive code for up to seven languages (every split of the languages
once) and, beyond, the best of several random dense codes by least row distance.
Every language of the labelled documents is learned, from at most ``PER_LANG`` documents each
and ``ROWS`` in all (about ``LEAST`` each where that is more); every whole text is scored in the
tasks.

Edge cases. Null text or text without a letter: ``und`` with score 0. Null lang: not used
for learning. No labelled document: ``und`` everywhere; one language only: that one, with
score 1. Null id: predicted; held_out false. Repeated rows and ties: one row each, equal
texts get equal results; equal losses go to the language first in order. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ship
from .learn import Adam, WordScores, bounded_sample, fold, sampled_features, sigmoid, word_weights

#: Documents of a language at most, in all, and of a language where there are very many.
PER_LANG, ROWS, LEAST = 500, 4_000, 20
FEATURES, STEPS, RATE, L2 = 20_000, 60, 0.2, 1e-4
FOLDS, HELD_OUT, CLEAR = 4, 2, 0.75
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1; every column splits the rows."""
    if n <= 7:  # exhaustive: first row all +1, each other split once
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T.reshape(n, -1)
    rng = np.random.default_rng(n)
    best, length = None, int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        far = (code.shape[1] - (code.astype(int) @ code.T.astype(int)) + 2 * code.shape[1] * np.eye(n)).min()
        if best is None or far > best[0]:
            best = (far, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    features: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning language and its score, for rows of margins."""
        agree = margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -agree) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / p.sum(1)


def _margins(texts: list[str | None], table: WordScores, bias: np.ndarray) -> np.ndarray:
    out = np.tile(bias, (len(texts), 1))
    for i, t in enumerate(texts):
        words = word_weights(t)
        if words and len(bias):
            n = np.fromiter(words.values(), float, len(words))
            rows = np.array([table[w] for w in words])
            out[i] += (n[:, None] * rows).sum(0) / n.sum()
    return out


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Model from text and lang of ``docs`` without the held-out fold."""
    mine = docs.where((F.coalesce(fold("doc_id", folds), F.lit(held_out)) != held_out) & F.col("lang").isNotNull())
    counts = sorted((r.lang, r.n) for r in mine.groupBy("lang").agg(F.count("*").alias("n"))
                    .collect())
    langs = [x for x, _ in counts]
    code, none = codewords(len(langs)) if langs else np.zeros((0, 0), np.int8), np.zeros(0)
    if len(langs) < 2:
        return Model(langs, np.zeros((len(langs), 0)), none.astype(np.int64), np.zeros((0, 0)), none, none)
    # an id is taken when its hash falls below its language's share: about PER_LANG of each
    limit = max(LEAST, min(PER_LANG, ROWS // len(langs)))
    share = F.create_map(*[F.lit(x) for k, n in counts for x in (k, min(1.0, 1.2 * limit / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    ids = mine.where(u < share[F.col("lang")]).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    marks, x = sampled_features(bounded_sample(docs, ids, max(ROWS, 2 * LEAST * len(langs))), "lang")
    y = np.array([langs.index(k) for k in marks])
    total = np.bincount(x.row, x.val, x.n)
    x.val = x.val / np.maximum(total[x.row], 1e-9) * 7  # about seven features a word
    seen = x.presence(np.ones(x.n, bool))
    top = np.argsort(-seen, kind="stable")[:FEATURES]
    features = np.sort(top[seen[top] > 1])
    x = x.keep(features)
    weights, bias, trust = [], [], []
    per = np.bincount(y, minlength=len(langs))
    for bit in range(code.shape[1]):
        target = code[y, bit].astype(float)
        # languages count alike, and so do the two sides of the split
        sample = 1 / np.maximum(1, per[y])
        for side in (1, -1):
            sample[target == side] /= max(1e-9, sample[target == side].sum())
        sample /= sample.sum()
        w, opt = np.zeros(len(features) + 1), Adam(len(features) + 1, RATE)
        for _ in range(STEPS):
            g = x.dot(w[:-1]) + w[-1]
            coef = -target * sigmoid(-target * g) * sample
            grad = np.append(x.dot_t(coef, len(features)), coef.sum())
            grad[:-1] += L2 * w[:-1]
            w = opt.step(w, grad)
        right = (sample * (np.sign(x.dot(w[:-1]) + w[-1]) == target)).sum()
        weights.append(w[:-1] * 7)
        bias.append(w[-1])
        trust.append(max(1e-3, 2 * right - 1))
    return Model(langs, code.astype(float), features, np.array(weights).T, np.array(bias), np.array(trust))


def identify(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT,
             clear: float = CLEAR) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANGS and FEATURES bound its size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = WordScores(m.features, m.weights)
        for b in batches:
            texts = column(b, "text").to_pylist()
            known = [bool(t and _LETTER.search(t)) and bool(m.langs) for t in texts]
            if len(m.langs) > 1 and texts:
                at, score = m.decode(_margins(texts, table, m.bias))
            else:
                at, score = np.zeros(len(texts), int), np.ones(len(texts))
            pred = [m.langs[i] if k else "und" for i, k in zip(at, known)]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "held_out"), pa.array(pred, pa.string()), pa.array(score),
                 pa.array(score < clear)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text",
                       F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")).mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")

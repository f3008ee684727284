"""Operators 7 to 9 against dense re-computations: plain matrices over all training rows,
written anew from the methods' formulas, compared score by score."""

import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from spendlabel.llm import language_id, quality_rank, toxicity
from spendlabel.llm.learn import BITS

from .helpers import prose, table

LANGS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}


def corpus(spark):
    r = np.random.default_rng(3)
    rows, lab = [], []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        words = ["".join(r.choice(list(LANGS[lang]), r.integers(2, 8))) for _ in range(int(r.integers(12, 40)))]
        toxic, good = i % 4 == 1, i % 5 < 3
        words += ["vile", "Nasty"][: 1 + i % 2] * (1 + i % 3) if toxic else []
        lines = [" ".join(words)] + ([] if good else ["#$ %& buy buy buy!! 99"] * (2 + i % 3))
        rows.append((i, "\n".join(lines), lang, "s"))
        if i % 6:
            lab.append((i, int(good), int(toxic)))
    rows += [rows[3], rows[4], (500, None, "aa", "s"), (501, "", "bb", "s"), (502, prose(1, 30), None, "s")]
    return rows, lab, spark.createDataFrame(lab + [lab[0]], "doc_id long, quality int, toxic int")


def fold_of(i, n):
    return zlib.crc32(str(i).encode()) % n


def features(text):
    out = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        names = ["=" + w] + ["^" + w[:k] for k in (3, 4, 5, 6) if len(w) > k] + [w[-k:] + "$" for k in (3, 4) if len(w) > k]
        for name in names:
            out[zlib.crc32(name.encode()) >> (32 - BITS)] += 1 + math.log(n)
    return out


def dense(texts):
    held = [features(t) for t in texts]
    names = sorted({f for h in held for f in h})
    return names, np.array([[h.get(f, 0.0) for f in names] for h in held])


def descend(w, gradient, rate, steps):
    m = v = np.zeros(len(w))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_toxicity_equals_a_dense_model(spark):
    rows, lab, labels = corpus(spark)
    texts = {i: t for i, t, *_ in rows}
    mine = [i for i in texts if fold_of(i, 3) != 1]
    known = {i: t for i, _, t in lab if fold_of(i, 3) != 1}
    pos = [i for i in mine if known.get(i)]
    names, x = dense([texts[i] for i in pos + mine])
    p = np.arange(len(x)) < len(pos)
    prior = sum(known.values()) / len(known)
    a, b, mid = (x[p] > 0).mean(0), (x[~p] > 0).mean(0), (x > 0).mean(0)
    z = np.abs(a - b) / np.sqrt(np.maximum(mid * (1 - mid), 1e-9) * (1 / p.sum() + 1 / (~p).sum()))
    use = (z > 3.5) & ((x > 0).sum(0) >= 3)
    x = x[:, use]
    bias0 = math.log(prior / (1 - prior))

    def gradient(w):
        g = x @ w[:-1] + w[-1]
        down = logistic(g)  # derivative of l(-g); of l(g): down - 1
        risk = np.log1p(np.exp(g))
        if risk[~p].mean() - prior * risk[p].mean() >= 0:
            c = np.where(p, (prior * (down - 1) - prior * down) / p.sum(), down / (~p).sum())
        else:
            c = np.where(p, prior * down / p.sum(), -down / (~p).sum())
        return np.append(x.T @ c + 1e-4 * w[:-1], c.sum())

    w = descend(np.append(np.zeros(use.sum()), bias0), gradient, 0.1, 300)
    weight = dict(zip(np.array(names)[use].tolist(), w[:-1]))
    docs = table(spark, rows)
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert 0 < use.sum() < 4_000 and len(got) == len(rows)
    for r in got:
        want = logistic(w[-1] + sum(n * weight.get(f, 0.0) for f, n in features(texts[r.doc_id]).items()))
        assert abs(r.score - want) < 1e-3 and r.held_out == (fold_of(r.doc_id, 3) == 1)
        assert r.predicted == int(r.score >= 0.7)


def test_language_equals_a_dense_model(spark):
    rows, _, _ = corpus(spark)
    langs = sorted(LANGS)
    texts, lang = {i: t for i, t, *_ in rows}, {i: x for i, _, x, _ in rows if x}
    mine = [i for i in lang if fold_of(i, 4) != 2]
    names, x = dense([texts[i] for i in mine])
    y = np.array([langs.index(lang[i]) for i in mine])
    x = x / np.maximum(x.sum(1, keepdims=True), 1e-9) * 7
    use = (x > 0).sum(0) > 1
    x = x[:, use]
    code = np.array([c for c in product((1, -1), repeat=3) if c[0] == 1 and -1 in c]).T
    ws, trust = [], []
    for c in code.T:
        t = c[y].astype(float)
        s = 1 / np.bincount(y)[y]
        for side in (1, -1):
            s[t == side] /= s[t == side].sum()
        s /= s.sum()

        def gradient(w):
            k = -t * logistic(-t * (x @ w[:-1] + w[-1])) * s
            return np.append(x.T @ k + 1e-4 * w[:-1], k.sum())
        ws.append(w := descend(np.zeros(use.sum() + 1), gradient, 0.2, 60))
        trust.append(max(1e-3, 2 * s[np.sign(x @ w[:-1] + w[-1]) == t].sum() - 1))
    at = {f: i for i, f in enumerate(np.array(names)[use].tolist())}
    docs = table(spark, rows)
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert use.sum() < 20_000 and len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        total = sum(1 + math.log(n) for n in Counter(text.lower().split()).values())
        row = np.zeros(use.sum())
        for f, n in features(text).items():
            if f in at:
                row[at[f]] += 7 * n / total
        loss = [sum(q * math.log1p(math.exp(-bit * (row @ w[:-1] + w[-1]))) for q, bit, w in zip(trust, c, ws)) for c in code]
        if not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        share = math.exp(-min(loss)) / sum(math.exp(-v) for v in loss)
        assert r.lang_pred == langs[int(np.argmin(loss))] and abs(r.score - share) < 1e-3
        assert r.held_out == (fold_of(r.doc_id, 4) == 2)


def plain_quality(text):
    raw = (text or "").encode()
    words, total = re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw), max(1, len(raw))
    share = lambda chars: sum(c in chars for c in raw) / total
    letters = bytes(range(65, 91)) + bytes(range(97, 123))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    three = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    shares = [share(b"#*$%&|<>{}[]~^_=+\\/@"), share(b"!"), share(b"0123456789"), share(b".,;:?"),
              share(letters[:26]) / max(1e-3, share(letters)), sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n,
              1 - len(set(three)) / max(1, len(words) - 2), 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines))]
    out = []
    for s in shares:
        out += [math.log(s + 1e-3), s / (s + 0.1)]
    return out + [math.log(n), math.log(max(1, len(raw)) / n), math.log(n / max(1, len(lines)))]


def test_quality_equals_a_dense_model(spark):
    rows, lab, labels = corpus(spark)
    texts = {i: t for i, t, *_ in rows}
    known = {i: q for i, q, _ in lab if fold_of(i, 5)}
    held = sorted((q, plain_quality(texts[i])) for i, q in known.items())
    y, f = np.array([q for q, _ in held]), np.array([v for _, v in held])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    f = np.clip((f - mean) / scale, -8, 8)
    good, bad = f[y == 1], f[y == 0]
    rng = np.random.default_rng(len(good) * 31 + len(bad))  # the operator's draw of pairs
    diff = good[rng.integers(len(good), size=60_000)] - bad[rng.integers(len(bad), size=60_000)]
    w = descend(np.zeros(f.shape[1]), lambda w: -(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + 1e-3 * w, 0.05, 300)
    s = np.sort(f @ w)
    n_bad = int((y == 0).sum())
    cut = (s[n_bad - 1] + s[n_bad]) / 2  # every label is in the sample: the quantile of quality 0
    slope = 8 / (np.percentile(s, 95) - np.percentile(s, 5) + 1e-9)
    docs = table(spark, rows)
    got = quality_rank.quality(docs, quality_rank.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        z = np.clip((np.array(plain_quality(texts[r.doc_id])) - mean) / scale, -8, 8) @ w
        want = logistic(np.clip(slope * (z - cut) + math.log(0.3 / 0.7), -30, 30))
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (fold_of(r.doc_id, 5) == 0)

"""Toxic spans by a linear-chain conditional random field over words.

Two states (plain, toxic); a word's emission for the toxic state is a bias plus the weights of
its features (the lower-cased word and its prefixes), and the transitions are learned with
them.  Tokens get their training labels from the document labels: in documents labelled toxic,
the words with a feature that is almost only found in toxic documents (a Chernoff bound on the
binomial tail, corrected for the number of features, and a purity) are toxic tokens.

Forward-backward gives each word's marginal.  Words without a weighted feature all have the
same emission, so runs of them are exact powers of one 2 x 2 matrix: only the weighted words are
visited, which keeps whole texts of any length cheap.  A document's score is a logistic function of
its largest marginal (log-odds) and of the expected number of toxic words, fitted on the same
bounded sample; spans are runs of neighbouring words with a marginal of at least 0.5.

The fit uses at most ``max_docs`` labelled documents of at most ``max_chars`` code points each,
those of lowest hash.  Everything else covers all rows.

Defined cases: NULL text counts as empty; a text without words gets the score of one without a
toxic word.  Rows without a 0/1 label, and keys with differing labels, aren't learned from.
Without both classes in the sample the score is the share of toxic labels (0 without labels).
Repeated rows are scored alike and all kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import ship_package, tidy

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("p", T.DoubleType())]))


def features(word: str) -> list[str]:
    w = word.lower()
    return [w + "$", *[w[:n] for n in PREFIXES if len(w) >= n]]


# ------------------------------------------------------------------ training
def feature_counts(words: list[list[str]], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """Documents of each class that hold each feature."""
    pos: Counter = Counter()
    neg: Counter = Counter()
    for ws, y in zip(words, toxic, strict=True):
        (pos if y else neg).update({f for w in set(ws) for f in features(w)})
    return pos, neg


def toxic_evidence(pos: Counter, neg: Counter, rate: float) -> dict[str, float]:
    """df * KL(df_pos / df || rate) of the features more frequent in toxic documents."""
    out = {}
    for f, p in pos.items():
        df = p + neg[f]
        q = p / df
        if p >= 3 and q > rate:
            rest = (1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0
            out[f] = df * (q * math.log(q / rate) + rest)
    return out


class _Emissions(dict):
    """Word -> weight of its features (0 for a word without any), filled on demand; emptied
    when it holds ``most`` words."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        got = 0.0
        for f in features(word):
            got += self.weights.get(f, 0.0)
        self[word] = got
        return got


class Crf:
    """Weights of the chain; see the module docstring."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: float,
                 calibration: tuple[float, float, float]):
        self.weights, self.bias, self.trans = weights, float(bias), np.asarray(trans, float)
        self.start, self.calibration = float(start), calibration
        self._prepare()

    def __getstate__(self):
        return (self.weights, self.bias, self.trans, self.start, self.calibration)

    def __setstate__(self, state):
        self.__init__(*state)

    def _prepare(self) -> None:
        self.emission = _Emissions(self.weights)
        a = np.exp(self.trans - self.trans.max())
        plain = a * np.array([1.0, math.exp(self.bias)])   # [from, to] step onto a plain word
        vals, vecs = np.linalg.eig(plain)
        order = np.argsort(-vals.real)
        vals, vecs = vals.real[order], vecs.real[:, order]
        inv = np.linalg.inv(vecs)
        self._p1 = np.outer(vecs[:, 0], inv[0])
        self._p2 = np.outer(vecs[:, 1], inv[1])
        self._mu = vals[1] / vals[0]
        self._a = a.tolist()
        self._powers: dict[int, tuple[float, float, float, float]] = {}

    def power(self, k: int) -> tuple[float, float, float, float]:
        """The k-th power of a plain step, up to a factor."""
        got = self._powers.get(k)
        if got is None:
            m = np.maximum(self._p1 + self._mu ** k * self._p2, 0.0) if k else np.eye(2)
            got = tuple(m.ravel().tolist())
            if len(self._powers) < 100_000:
                self._powers[k] = got
        return got

    def marginals(self, words: list[str]) -> tuple[list[int], list[float]]:
        """(positions of weighted words, their marginals of the toxic state)."""
        e = list(map(self.emission.__getitem__, words))
        at = [i for i, x in enumerate(e) if x]
        if not at:
            return at, []
        (a00, a01), (a10, a11) = self._a
        toxic = [math.exp(min(self.bias + e[i], 60.0)) for i in at]
        # forward: weights of the two states at every weighted word
        fwd = []
        first, boost = at[0], math.exp(self.bias)
        if first == 0:
            x, y = 1.0, math.exp(self.start) * toxic[0]
        else:
            x, y = 1.0, math.exp(self.start) * boost
            p = self.power(first - 1)
            x, y = x * p[0] + y * p[2], x * p[1] + y * p[3]
            x, y = x * a00 + y * a10, (x * a01 + y * a11) * toxic[0]
        fwd.append((x / (x + y), y / (x + y)))
        for j in range(1, len(at)):
            x, y = fwd[-1]
            gap = at[j] - at[j - 1] - 1
            if gap:
                p = self.power(gap)
                x, y = x * p[0] + y * p[2], x * p[1] + y * p[3]
            x, y = x * a00 + y * a10, (x * a01 + y * a11) * toxic[j]
            fwd.append((x / (x + y), y / (x + y)))
        # backward
        p = self.power(len(words) - 1 - at[-1])
        u, v = p[0] + p[1], p[2] + p[3]
        out = [0.0] * len(at)
        for j in range(len(at) - 1, -1, -1):
            x, y = fwd[j]
            out[j] = y * v / (x * u + y * v)
            if j:
                t = toxic[j]
                u, v = a00 * u + a01 * t * v, a10 * u + a11 * t * v
                gap = at[j] - at[j - 1] - 1
                if gap:
                    p = self.power(gap)
                    u, v = p[0] * u + p[1] * v, p[2] * u + p[3] * v
                u, v = u / (u + v), v / (u + v)
        return at, out

    @staticmethod
    def summary(p: list[float]) -> tuple[float, float]:
        top = min(max(max(p, default=0.0), 1e-5), 1 - 1e-5)
        return math.log(top / (1 - top)), math.log1p(sum(x for x in p if x >= 0.01))

    def score(self, p: list[float]) -> float:
        a, b = self.summary(p)
        c0, c1, c2 = self.calibration
        z = max(-40.0, min(40.0, c0 + c1 * a + c2 * b))
        return 1.0 / (1.0 + math.exp(-z))


def _segments(words: list[list[str]], labels: list[list[int]], weighted: dict[str, int],
              length: int, most: int, rng: np.random.Generator):
    """Windows of ``length`` words: every one with a toxic token, and as many others again
    (at least 2,000), up to ``most``; their feature numbers and labels."""
    hot, cold = [], []
    for d, (ws, ys) in enumerate(zip(words, labels, strict=True)):
        for s in range(0, len(ws), length):
            (hot if any(ys[s:s + length]) else cold).append((d, s))
    hot = [hot[i] for i in rng.permutation(len(hot))[:most // 2]]
    cold = [cold[i] for i in rng.permutation(len(cold))[:max(2000, len(hot))]]
    segs = hot + cold
    y = np.zeros((len(segs), length), np.int8)
    valid = np.zeros((len(segs), length), bool)
    cell, feat = [], []
    for r, (d, s) in enumerate(segs):
        ws = words[d][s:s + length]
        y[r, :len(ws)] = labels[d][s:s + length]
        valid[r, :len(ws)] = True
        for t, w in enumerate(ws):
            for f in features(w):
                k = weighted.get(f)
                if k is not None:
                    cell.append(r * length + t)
                    feat.append(k)
    return y, valid, np.array(cell, np.int64), np.array(feat, np.int64)


def _forward_backward(emit: np.ndarray, valid: np.ndarray, trans: np.ndarray, start: float):
    """Marginals [n, t] of the toxic state, pair marginals [2, 2] summed, start marginals."""
    n, length = emit.shape
    alpha = np.zeros((length, 2, n))
    alpha[0, 1] = start + emit[:, 0]
    for t in range(1, length):
        for j in (0, 1):
            a = np.logaddexp(alpha[t - 1, 0] + trans[0, j], alpha[t - 1, 1] + trans[1, j])
            alpha[t, j] = np.where(valid[:, t], a + (emit[:, t] if j else 0.0), alpha[t - 1, j])
    logz = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
    beta = np.zeros((2, n))
    marg = np.zeros((n, length))
    pairs = np.zeros((2, 2))
    marg[:, -1] = np.exp(alpha[-1, 1] - logz)
    for t in range(length - 1, 0, -1):
        on = valid[:, t]
        step = [[trans[i, j] + (emit[:, t] if j else 0.0) + beta[j] for j in (0, 1)] for i in (0, 1)]
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] += np.exp(alpha[t - 1, i] + step[i][j] - logz)[on].sum()
        beta = np.stack([np.where(on, np.logaddexp(step[i][0], step[i][1]), beta[i]) for i in (0, 1)])
        marg[:, t - 1] = np.exp(alpha[t - 1, 1] + beta[1] - logz)
    return marg * valid, pairs, marg[:, 0].sum()


def _fit_chain(y, valid, cell, feat, n_feat, steps: int = 60, rate: float = 0.25, l2: float = 1.0):
    """Maximum penalised likelihood by Adam: (feature weights, bias, transitions, start)."""
    n, length = y.shape
    theta = np.zeros(n_feat + 6)          # features, bias, 4 transitions, start
    theta[n_feat] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    yv = y * valid
    pair_true = np.zeros((2, 2))
    both = valid[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            pair_true[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
    flat_true = yv.ravel()
    for k in range(1, steps + 1):
        w, bias = theta[:n_feat], theta[n_feat]
        trans, start = theta[n_feat + 1:n_feat + 5].reshape(2, 2), theta[n_feat + 5]
        emit = np.bincount(cell, weights=w[feat], minlength=n * length).reshape(n, length) + bias
        marg, pairs, begin = _forward_backward(emit, valid, trans, start)
        diff = (marg.ravel() - flat_true)
        grad = np.concatenate([
            np.bincount(feat, weights=diff[cell], minlength=n_feat), [diff.sum()],
            (pairs - pair_true).ravel(), [begin - yv[:, 0].sum()]])
        grad = (grad + l2 * theta * np.r_[np.ones(n_feat), 0.01 * np.ones(6)]) / n
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-9)
    return (theta[:n_feat], theta[n_feat], theta[n_feat + 1:n_feat + 5].reshape(2, 2),
            theta[n_feat + 5])


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression with intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = l2 * np.diag([0.1] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) + ridge @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(texts: list[str], toxic: list[int], segment: int = 32, max_segments: int = 12_000,
        max_features: int = 20_000, purity: float = 0.8, seed: int = 7) -> Crf:
    """Fit the chain and the calibration on whole texts with 0/1 labels."""
    first = {t: i for i, t in reversed(list(enumerate(texts)))}    # one of equal texts
    texts, toxic = [texts[i] for i in sorted(first.values())], [toxic[i] for i in sorted(first.values())]
    y = np.array(toxic, int)
    words = [WORD.findall(t) for t in texts]
    none = Crf({}, -5.0, np.zeros((2, 2)), 0.0, (0.0, 0.0, 0.0))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        none.calibration = (math.log(share / (1 - share)), 0.0, 0.0)
        return none
    pos, neg = feature_counts(words, y)
    evidence = toxic_evidence(pos, neg, float(y.mean()))
    sure = math.log(20 * (len(pos) + len(neg)))
    marked = {f for f, s in evidence.items() if s >= sure and pos[f] >= purity * (pos[f] + neg[f])}
    # features that may carry weight: nominally significant ones, the strongest first
    strong = sorted((f for f, s in evidence.items() if s >= 4.0), key=lambda f: (-evidence[f], f))
    weighted = {f: i for i, f in enumerate(strong[:max_features])}
    kind: dict[str, int] = {}

    def is_marked(w: str) -> int:
        got = kind.get(w)
        if got is None:
            got = kind[w] = int(any(f in marked for f in features(w)))
        return got

    labels = [[is_marked(w) for w in ws] if t else [0] * len(ws) for ws, t in zip(words, y, strict=True)]
    rng = np.random.default_rng(seed)
    seg = _segments(words, labels, weighted, segment, max_segments, rng)
    w, bias, trans, start = _fit_chain(*seg, len(weighted))
    weights = {f: float(w[i]) for f, i in weighted.items() if abs(w[i]) > 0.05}
    crf = Crf(weights, bias, trans, start, (0.0, 1.0, 0.0))
    x = np.array([crf.summary(crf.marginals(ws)[1]) for ws in words])
    crf.calibration = _fit_logistic(x, y)
    return crf


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = 4000,
                    max_chars: int = 20_000) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_docs`` learnable rows (column ``learn``) of lowest hash."""
    lab = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min("toxic").alias("_lo"), F.max("toxic").alias("_toxic"))
           .where(F.col("_lo") == F.col("_toxic")).select("doc_id", "_toxic"))
    # the keys are chosen on narrow rows; only the chosen rows' texts reach the driver
    narrow = (docs.where(F.col("learn") & (F.coalesce(F.length("text"), F.lit(0)) <= max_chars))
              .select("doc_id").join(lab, "doc_id")
              .orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(max_docs))
    chosen = F.broadcast(narrow.distinct())          # at most max_docs keys
    rows = (docs.where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
            .orderBy("doc_id", "text").limit(max_docs).collect())
    return [r["text"] for r in rows], [r["_toxic"] for r in rows]


# ------------------------------------------------------------------ scoring
def spans_of(text: str, at: list[int], p: list[float], least: float = 0.5) -> list[tuple]:
    """(start, end, largest marginal) of runs of neighbouring words with p >= least; offsets
    are code points of the text."""
    hot = {i: q for i, q in zip(at, p, strict=True) if q >= least}
    if not hot:
        return []
    out: list[list] = []
    for i, m in enumerate(WORD.finditer(text)):
        q = hot.get(i)
        if q is None:
            continue
        if out and out[-1][3] == i - 1:
            out[-1][1], out[-1][2], out[-1][3] = m.end(), max(out[-1][2], q), i
        else:
            out.append([m.start(), m.end(), q, i])
    return [tuple(s[:3]) for s in out]


def score_documents(docs: DataFrame, crf: Crf, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score``, ``predicted`` and ``spans`` of every row's whole text."""
    ship_package(docs.sparkSession)
    src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    schema = (src.select(*keep).schema.add("score", "double").add("predicted", "integer")
              .add("spans", SPANS))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, spans = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                at, p = crf.marginals(WORD.findall(text))
                score.append(crf.score(p))
                spans.append([{"start": s, "end": e, "p": q} for s, e, q in spans_of(text, at, p)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(score, pa.float64()),
                 pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(spans, span)], schema.names)

    return src.mapInArrow(tidy(run), schema)


def fit_on(docs: DataFrame, labels: DataFrame, **bounds) -> Crf:
    """The model from the learnable rows of ``docs`` (column ``learn``)."""
    return fit(*training_sample(docs, labels, **bounds))


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` (same columns) that aren't predicted toxic by a model fitted on its
    labelled rows."""
    crf = fit_on(docs.select("doc_id", "text", F.lit(True).alias("learn")), labels, **bounds)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return score_documents(src, crf, ("_row",)).where(F.col("predicted") == 0).select("_row.*")

"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: in a toxic document, a
token counts as toxic where its word or one of its prefixes is nearly never seen in
clean documents. On these labelled tokens a two-state chain is trained (state
weights of words and prefixes, transitions) by the gradient of its likelihood. The
forward-backward marginals of a whole text then give its offending offsets, and a
logistic function of their largest value and their sum gives its score.

Few words carry weight. Stretches of words without any share one transfer matrix,
so a stretch of n words is that matrix to the power n, and the marginals stay exact.

Training reads at most TRAIN_DOCS labelled documents of either class, of at most
TRAIN_CHARS characters each; scoring reads every whole text.

Defined cases: null and empty texts score as no marginal at all; rows with a null id are scored
and not held out; repeated rows are scored alike; without toxic training rows
every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, places_in, small_batches, texts_of

TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
PREFIXES = (4, 5, 6)
#: Log odds shrink by n / (n + SHRINK) for a feature of n toxic contexts, whatever the size of the sample. From
#: such odds on a feature takes part; it labels tokens from the higher odds on.
SHRINK, FEATURE_ODDS, LABEL_ODDS = 3.0, 2.0, 3.0
WINDOW, CLEAN_WINDOWS = 32, 1
ROUNDS, STEP, RIDGE = 50, 0.4, 1e-3
THRESHOLD = 0.7
SPAN_MARGINAL = 0.5
#: Smaller marginals do not add to a score, or long clean texts would.
LEAST_MARGINAL = 0.2
_CACHE = 500_000
_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Chain:
    """A trained chain: feature weights of the toxic state, bias, transitions and score weights."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, score: np.ndarray):
        self.weights, self.bias, self.score = weights, bias, score
        self.trans = np.exp(trans - trans.max())  # [from, to]; state 1 is toxic
        self._gain: dict[str, float] = {}
        plain = self.trans * np.array([1.0, math.exp(bias)])
        lam, vec = np.linalg.eig(plain)
        order = np.argsort(-np.abs(lam))
        self._ratio = float((lam[order[1]] / lam[order[0]]).real)
        self._vec, self._inv = vec[:, order].real, np.linalg.inv(vec[:, order]).real

    def gain(self, word: str) -> float:
        """Weight of a word beside the bias; 0 for almost all words."""
        if word not in self._gain:
            if len(self._gain) > _CACHE:
                self._gain.clear()
            self._gain[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return self._gain[word]

    def _stretch(self, n: int) -> tuple[float, float, float, float]:
        """The plain matrix to the power n, up to a factor."""
        v, w, r = self._vec, self._inv, self._ratio**n
        return tuple(float(v[i, 0] * w[0, j] + v[i, 1] * r * w[1, j]) for i in (0, 1) for j in (0, 1))

    def marginals(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Positions of words with a weight, and their exact toxic marginals."""
        gains = list(map(self._gain.get, words))
        if None in gains:
            for i, g in enumerate(gains):
                if g is None:
                    gains[i] = self.gain(words[i])
        at = [i for i, g in enumerate(gains) if g]
        if not at:
            return [], []
        (t00, t01), (t10, t11) = self.trans.tolist()
        forward, a, before = [], (1.0, 0.0), -1  # the place before the text is clean
        for i in at:
            if i - before > 1:
                m = self._stretch(i - before - 1)
                a = (a[0] * m[0] + a[1] * m[2], a[0] * m[1] + a[1] * m[3])
            e = math.exp(self.bias + gains[i])
            a = (a[0] * t00 + a[1] * t10, (a[0] * t01 + a[1] * t11) * e)
            z = a[0] + a[1]
            a = (a[0] / z, a[1] / z)
            forward.append(a)
            before = i
        out, b, after = [0.0] * len(at), (1.0, 1.0), len(words)
        for k in range(len(at) - 1, -1, -1):
            if after - at[k] > 1:
                m = self._stretch(after - at[k] - 1)
                b = (m[0] * b[0] + m[1] * b[1], m[2] * b[0] + m[3] * b[1])
            p, q = forward[k][0] * b[0], forward[k][1] * b[1]
            out[k] = q / (p + q)
            e = math.exp(self.bias + gains[at[k]])
            b = (t00 * b[0] + t01 * e * b[1], t10 * b[0] + t11 * e * b[1])
            z = b[0] + b[1]
            b = (b[0] / z, b[1] / z)
            after = at[k]
        return at, out

    def document(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """Score and offending spans (code points, end exclusive) of one whole text."""
        lower = text.lower()
        words = _WORD.findall(lower)
        at, p = self.marginals(words)
        x = np.array(_evidence(p))
        score = 1 / (1 + math.exp(-float(np.clip(self.score @ x, -30, 30))))
        spans = []
        if p and max(p) >= SPAN_MARGINAL:
            bad = {i for i, v in zip(at, p, strict=True) if v >= SPAN_MARGINAL}
            place = places_in(text, lower)
            spans = [place(*m.span()) for i, m in enumerate(_WORD.finditer(lower)) if i in bad]
        return score, spans


def _evidence(p: list[float]) -> list[float]:
    return [1.0, max(p, default=0.0), math.log1p(sum(v for v in p if v >= LEAST_MARGINAL))]


def _counts(texts: list[str]) -> tuple[Counter, int]:
    """Distinct contexts (the words on both sides) per feature, and of all words.

    Copies of a text repeat its contexts, so they do not make its words look frequent.
    """
    contexts, words = set(), Counter()
    for t in texts:
        w = _WORD.findall(t.lower())
        for c in zip(["", *w[:-1]], w, [*w[1:], ""], strict=True):
            h = hash(c)
            if h not in contexts:
                contexts.add(h)
                words[c[1]] += 1
    out: Counter = Counter()
    for word, n in words.items():
        for f in features(word):
            out[f] += n
    return out, len(contexts)


def _windows(texts, odds, toxic, keep_plain):
    """Windows of words with token labels: (feature id lists, labels)."""
    out = []
    for d, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        rows = [[f for f in features(w) if f in odds] for w in words]
        marks = [int(toxic and any(odds[f] >= LABEL_ODDS for f in r)) for r in rows]
        plain = 0
        for at in range(0, len(words), WINDOW):
            if any(rows[at : at + WINDOW]) or (plain < keep_plain and d % 2 == 0):
                plain += not any(rows[at : at + WINDOW])
                out.append((rows[at : at + WINDOW], marks[at : at + WINDOW]))
    return out


def train_chain(toxic: list[str], clean: list[str]) -> Chain | None:
    """Fit the chain and the score on sample texts; None without toxic texts."""
    if not toxic:
        return None
    (a, n_a), (b, n_b) = _counts(toxic), _counts(clean)
    odds = {}
    for f, n in a.items():
        o = n / (n + SHRINK) * (math.log((n + 0.5) / (n_a + 1)) - math.log((b[f] + 0.5) / (n_b + 1)))
        if o >= FEATURE_ODDS:
            odds[f] = o
    index = {f: i for i, f in enumerate(sorted(odds))}
    windows = _windows(toxic, odds, True, CLEAN_WINDOWS) + _windows(clean, odds, False, CLEAN_WINDOWS)
    n = len(windows)
    labels, valid = np.zeros((n, WINDOW), dtype=np.int64), np.zeros((n, WINDOW), dtype=bool)
    where, which = [], []
    for r, (rows, marks) in enumerate(windows):
        labels[r, : len(marks)], valid[r, : len(marks)] = marks, True
        for c, row in enumerate(rows):
            where += [r * WINDOW + c] * len(row)
            which += [index[f] for f in row]
    where, which = np.array(where, dtype=np.int64), np.array(which, dtype=np.int64)
    theta = np.zeros(len(index) + 1 + 4)  # state weights, bias, transitions
    theta[len(index)] = -4.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        grad = _gradient(theta, len(index), where, which, labels, valid) / max(1, valid.sum()) * 100 - RIDGE * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += STEP * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    k = len(index)
    weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 0.02}
    chain = Chain(weights, float(theta[k]), theta[k + 1 :].reshape(2, 2), np.array([-6.0, 6.0, 3.0]))
    rows = []
    for text in [*toxic, *clean]:
        _, p = chain.marginals(_WORD.findall(text.lower()))
        rows.append(_evidence(p))
    chain.score = _logistic(np.array(rows), np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return chain


def _gradient(theta, k, where, which, labels, valid) -> np.ndarray:
    """Gradient of the log likelihood of all windows: observed less expected counts."""
    n, width = labels.shape
    emit = np.bincount(where, weights=theta[which], minlength=n * width).reshape(n, width) + theta[k]
    trans = theta[k + 1 :].reshape(2, 2)
    potential = np.exp(trans)
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
    alpha, beta = np.zeros((n, width, 2)), np.ones((n, width, 2))
    state = np.zeros((n, 2))
    state[:, 0] = 1
    for c in range(width):
        state = np.where(valid[:, c, None], state @ potential * e[:, c], state)
        state /= state.sum(1, keepdims=True)
        alpha[:, c] = state
    for c in range(width - 2, -1, -1):
        nxt = (beta[:, c + 1] * e[:, c + 1]) @ potential.T
        beta[:, c] = np.where(valid[:, c + 1, None], nxt / nxt.sum(1, keepdims=True), beta[:, c])
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    diff = (labels - post[:, :, 1]) * valid
    grad = np.zeros_like(theta)
    grad[:k] = np.bincount(which, weights=diff.ravel()[where], minlength=k)
    grad[k] = diff.sum()
    prev = np.concatenate([np.broadcast_to([1.0, 0.0], (n, 1, 2)), alpha[:, :-1]], axis=1)
    pair = prev[:, :, :, None] * potential[None, None] * (e * beta)[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    before = np.concatenate([np.zeros((n, 1), dtype=np.int64), labels[:, :-1]], axis=1)
    for i in (0, 1):
        for j in (0, 1):
            seen = ((before == i) & (labels == j) & valid).sum()
            grad[k + 1 + 2 * i + j] = seen - (pair[:, :, i, j] * valid).sum()
    return grad


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps; classes count alike."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
    return w


def training_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[str]]:
    """(toxic, clean) texts: the labelled rows not held out with the smallest id hashes."""
    known = columns(labels, id=id_col, y=label_col).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.dropDuplicates(["id"])
    pick = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS) for y in (1, 0)]
    ids = pick[0].unionByName(pick[1])  # at most 2 TRAIN_DOCS rows
    texts = columns(docs, id=id_col, text=text_col).filter(F.length("text") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy("id").collect()
    return [r.text for r in rows if r.y == 1], [r.text for r in rows if r.y == 0]


def score(docs: DataFrame, chain: Chain | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in small_batches(batches):
            got = [(0.0, []) if model is None else model.document(t) for t in texts_of(b.column(1))]
            spans = [",".join(f"{s}:{e}" for s, e in x[1]) for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in got], pa.float64()), pa.array(spans)], ["doc_id", "held_out", "score", "spans"])

    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text", held_out(F.col("doc_id")).alias("held_out"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, spans string")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Train on the labelled rows that are not held out, then score every document."""
    chain = train_chain(*training_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    return score(docs, chain, id_col=id_col, text_col=text_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets features of itself and of its neighbours; the
chain labels each line good or bad.  Only documents are labelled, so the
lines of a training document start with its label, and lines of bad
documents that look good to the trained chain are relabelled once (a bad
document may hold good lines).  A document's quality is the length-weighted
mean of its lines' forward-backward marginals, mapped to a probability by a
logistic curve fitted on the training documents.

The training sample is bounded by ``max_docs`` documents, half of them of
each label where there are as many (scores weigh both labels alike, so a rare
label counts), and by ``max_lines`` lines of each: a run of lines that begins
at a place drawn by the text's hash, with the features they have in the whole
text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import id_crc, keep_texts, map_texts, slices, table

THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _BANG, _PIPE, _SYMBOL, _PUNCT, _WIDE, _BREAK = range(10)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
    for c in b" \t\r\x0b\x0c":
        out[c] = _SPACE
    for c in b".,;:'\"-()?":
        out[c] = _PUNCT
    out[ord("!")], out[ord("|")], out[ord("\n")] = _BANG, _PIPE, _BREAK
    return out


_CLASSES = _byte_classes()
N_OWN = 13
#: own features, those of both neighbours, "is first", "is last", constant
N_FEATURES = 3 * N_OWN + 3


def line_features(texts: list[str]):
    """Feature rows of all lines of the texts, line lengths in bytes and the
    number of lines of each text (a line break ends no line of its own)."""
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace") + b"\n", np.uint8)
    kind = _CLASSES[data]
    ends = np.flatnonzero(kind == _BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    width = np.maximum(size, 1).astype(np.float64)

    def share(k):
        seen = np.concatenate([[0], np.cumsum(kind == k)])
        return (seen[ends] - seen[starts]) / width

    upper, lower = share(_UPPER), share(_LOWER)
    words, same, unique, known = [], [], [], []
    for doc in lines:
        before: set[str] = set()
        for line in doc:
            w = line.split()
            n = len(w)
            words.append(n)
            same.append(sum(map(str.__eq__, w, w[1:])) / n if n else 0.0)
            unique.append(len(set(w)) / n if n else 1.0)
            known.append(line in before)
            before.add(line)
    words = np.array(words, np.float64)
    own = np.column_stack([
        np.log1p(size) / 8, upper / np.maximum(upper + lower, 1e-9), share(_DIGIT), share(_BANG) * 8,
        share(_PIPE) * 8, share(_SYMBOL) * 4, share(_SPACE), share(_PUNCT) * 4, share(_WIDE),
        np.array(same), 1 - np.array(unique), np.minimum((size / np.maximum(words, 1)) / 16, 2),
        np.array(known, np.float64)])
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    x = np.zeros((len(own), N_FEATURES))
    x[:, :N_OWN] = own
    x[1:, N_OWN:2 * N_OWN] = own[:-1]
    x[first, N_OWN:2 * N_OWN] = 0
    x[:-1, 2 * N_OWN:3 * N_OWN] = own[1:]
    x[last, 2 * N_OWN:3 * N_OWN] = 0
    x[first, -3] = 1
    x[last, -2] = 1
    x[:, -1] = 1
    return x, size, n_lines


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def forward_backward(unary: np.ndarray, pair: np.ndarray, n_lines: np.ndarray, edges: bool = False,
                     weight: np.ndarray | None = None):
    """Line marginals of two-state chains of different lengths.

    ``unary`` (all lines, 2) holds the chains one after another, ``pair``
    (2, 2) the transition weights; the chains advance together, a step a
    line.  With ``edges`` also the expected transition counts (a transition
    counts with the ``weight`` of its first line) and those first lines.
    """
    start = np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    # alive[t]: the chains that have a line t (the longest come first)
    longest = int(n_lines.max()) if len(n_lines) else 0
    alive = np.searchsorted(-n_lines[order], -np.arange(longest), side="left")
    fwd, bwd = np.empty_like(unary), np.zeros_like(unary)
    for t in range(longest):
        at = start[order[:alive[t]]] + t
        if t:
            fwd[at] = unary[at] + _log_sum(fwd[at - 1][:, :, None] + pair[None], 1)
        else:
            fwd[at] = unary[at]
    for t in range(longest - 2, -1, -1):
        at = start[order[:alive[t + 1]]] + t
        bwd[at] = _log_sum(pair[None] + (unary[at + 1] + bwd[at + 1])[:, None, :], 2)
    both = fwd + bwd
    norm = _log_sum(both, 1)
    marginal = np.exp(both - norm[:, None])
    if not edges:
        return marginal
    inner = np.ones(len(unary), bool)
    inner[start + n_lines - 1] = False
    a = np.flatnonzero(inner)
    joint = fwd[a][:, :, None] + pair[None] + (unary[a + 1] + bwd[a + 1])[:, None, :] - norm[a][:, None, None]
    joint = np.exp(joint) if weight is None else np.exp(joint) * weight[a][:, None, None]
    return marginal, joint.sum(axis=0), a


@dataclass
class QualityModel:
    weights: np.ndarray   # (features,), log-odds of a good line
    pair: np.ndarray      # (2, 2) transitions bad/good
    slope: float
    offset: float

    def line_marginals(self, texts: list[str]):
        """P(good) and length of every line, and the texts' line counts."""
        x, size, n_lines = line_features(texts)
        unary = np.column_stack([np.zeros(len(x)), x @ self.weights])
        return forward_backward(unary, self.pair, n_lines)[:, 1], size, n_lines

    def mean_marginals(self, texts: list[str]) -> np.ndarray:
        good, size, n_lines = self.line_marginals(texts)
        first = np.cumsum(n_lines) - n_lines
        weight = size + 1.0
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return _sigmoid(self.slope * self.mean_marginals(texts) + self.offset)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chain_gradient(theta, x, y, weight, n_lines, ridge: float):
    """Gradient of the chains' log-likelihoods, each weighted alike in all
    its terms (``weight`` is constant within a chain), over the weights' sum,
    less a ridge of ``ridge / 2`` times the squared parameters."""
    w, pair = theta[:-4], theta[-4:].reshape(2, 2)
    marginal, joint, a = forward_backward(
        np.column_stack([np.zeros(len(x)), x @ w]), pair, n_lines, edges=True, weight=weight)
    target = np.column_stack([1 - y, y])
    seen = np.einsum("n,ni,nj->ij", weight[a], target[a], target[a + 1])
    return np.concatenate([x.T @ (weight * (y - marginal[:, 1])), (seen - joint).ravel()]) / weight.sum() - ridge * theta


def _fit_chain(x, y, weight, n_lines, rounds: int, ridge: float):
    """Gradient ascent (Adam) on the weighted conditional likelihood."""
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = chain_gradient(theta, x, y, weight, n_lines, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(x: np.ndarray, size: np.ndarray, n_lines: np.ndarray, labels: np.ndarray,
          rounds: int = 60, ridge: float = 1e-4) -> QualityModel:
    """Fit chain and document curve on documents given as line features."""
    if not len(labels) or labels.min() == labels.max():
        # nothing to tell apart: the share of good labels is every score
        p = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    doc = np.repeat(labels.astype(float), n_lines)
    share = np.where(doc > 0, 0.5 / doc.sum(), 0.5 / (1 - doc).sum()) * len(doc)  # classes weigh alike
    w, pair = _fit_chain(x, doc, share, n_lines, rounds, ridge)
    marginal = forward_backward(np.column_stack([np.zeros(len(x)), x @ w]), pair, n_lines)[:, 1]
    lines = np.where(doc > 0, 1.0, (marginal > 0.8).astype(float))
    w, pair = _fit_chain(x, lines, share, n_lines, rounds, ridge)
    model = QualityModel(w, pair, 1.0, 0.0)
    marginal = forward_backward(np.column_stack([np.zeros(len(x)), x @ w]), pair, n_lines)[:, 1]
    first, weight = np.cumsum(n_lines) - n_lines, size + 1.0
    mean = np.add.reduceat(marginal * weight, first) / np.add.reduceat(weight, first)
    model.slope, model.offset = _fit_curve(mean, labels.astype(float))
    return model


def _fit_curve(mean: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the mean marginal (Newton with a
    small ridge; the slope is kept positive)."""
    z = np.column_stack([mean, np.ones(len(mean))])
    b = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ b)
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0.05, 0.001])
        b += np.linalg.solve(h, z.T @ (y - p) - np.array([0.05, 0.001]) * b)
    return float(max(b[0], 1e-3)), float(b[1])


def training_labels(labels: DataFrame, eligible: Column | None, max_docs: int) -> DataFrame:
    """(doc_id, quality) of at most ``max_docs`` documents, chosen by the
    hash of their id, half of each label (fewer where a label has fewer).
    Repeated labels of one id count as their rounded mean."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .filter(F.lit(True) if eligible is None else eligible)
             .groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality")))
    half = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
            for q in (0, 1)]
    return half[0].union(half[1])


def fit_quality_model(docs: DataFrame, labels: DataFrame, eligible: Column | None = None,
                      max_docs: int = 2000, max_lines: int = 256, **options) -> QualityModel:
    """Train on at most ``max_docs`` labelled documents and ``max_lines``
    lines of each (see the module's text).  Of rows with one id the one of
    the least text hash is taken.  Without rows of both labels every score is
    the share of good ones."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = Window.partitionBy("doc_id").orderBy("h", "text")
    # at most max_docs ids: bounded broadcast
    rows = (docs.select("doc_id", body.alias("text"))
            .join(F.broadcast(training_labels(labels, eligible, max_docs)), "doc_id")
            .withColumn("h", F.xxhash64("text")).withColumn("r", F.row_number().over(one)).filter("r = 1")
            .select("quality", "h", "text"))

    def features(batches):
        for batch in batches:
            for part, texts in slices(batch):
                x, size, n = line_features(texts)
                begin = np.cumsum(n) - n
                begin = begin + part.column(1).to_numpy() % np.maximum(n - max_lines + 1, 1)
                end = begin + np.minimum(n, max_lines)
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([x[i:j].astype(np.float32).tobytes() for i, j in zip(begin, end)], pa.binary()),
                    pa.array([size[i:j].astype(np.int64).tobytes() for i, j in zip(begin, end)], pa.binary()),
                ], names=["quality", "x", "size"])

    got = rows.mapInArrow(features, "quality int, x binary, size binary").collect()
    got.sort(key=lambda r: (r["quality"], bytes(r["x"])))
    size = [np.frombuffer(r["size"], np.int64) for r in got]
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got]
    return train(np.concatenate(x).astype(float) if x else np.zeros((0, N_FEATURES)),
                 np.concatenate(size) if size else np.zeros(0, np.int64),
                 np.array([len(s) for s in size], np.int64),
                 np.array([r["quality"] for r in got], np.int64), **options)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str],
                  threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (1 where score >= threshold) to the
    ``keep`` columns.  A null or empty text is one empty line; repeated rows
    are scored each; an empty table gives no rows; texts of any length are
    scored whole, a slice of texts at a time.  ``keep`` columns that have a
    new column's name are left out."""
    def run(texts):
        s = model.score(texts)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_texts(docs, run, "score double, predicted int", keep)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents, learned from the labels
    outside the fold crc32(doc_id) mod 5 = 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = fit_quality_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs.select("doc_id", "text", held_out.alias("held_out")),
                         model, ["doc_id", "held_out"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keep the documents that the chain predicts as good.
    Null and empty texts are judged as one empty line; repeated rows are kept
    or go together; all columns, whatever their names, come back as they
    were; an empty table gives no rows."""
    model = fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return keep_texts(docs, lambda texts: model.score(texts) >= THRESHOLD)

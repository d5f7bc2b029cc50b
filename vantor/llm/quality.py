"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, doc_key

#: Labelled documents that the field is fitted on, at most; all documents are scored.
FIT_DOCS = 6_000
#: Lines of them, at most, in the fit; documents are taken whole until it is reached.
FIT_LINES = 200_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_STOP = b".,;:'\"?-()"
_ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOP)
_HIGH = bytes(range(128, 256))
#: Own features of a line; neighbours' follow.
OWN = 18


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, byte lengths): each line's own features, then the mean and the spread of its neighbours'.

    An empty or null text is one empty line. Only the text enters.
    """
    lines = (text or b"").split(b"\n")
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    own = np.zeros((len(lines), OWN))
    length = np.zeros(len(lines))
    for i, line in enumerate(lines):
        n = len(line)
        length[i] = n
        if not n:
            own[i, 0] = 1
            continue
        words = line.split()
        k = max(1, len(words))
        count = lambda kind, n=n, line=line: (n - len(line.translate(None, kind))) / n
        letters = max(1, n - len(line.translate(None, _UPPER + _LOWER + _HIGH)))
        own[i] = (
            0, math.log1p(n) / 5, math.log1p(k) / 5, min(3.0, n / k / 6), count(_UPPER) * n / letters, count(_DIGIT), count(_ODD), count(_STOP),
            count(_HIGH), len(set(words)) / k, sum(map(bytes.__eq__, words, words[1:])) / k, line.count(b"|") / k, line.count(b"!") / k,
            seen[line] > 1, math.log1p(seen[line] - 1), line[-1:] in b".!?", len(set(words)) / math.sqrt(k) / 5, max(map(len, words), default=0) / n,
        )
    before = np.vstack([own[:1], own[:-1]])
    after = np.vstack([own[1:], own[-1:]])
    return np.hstack([own, (before + after) / 2, np.abs(own - before), np.ones((len(lines), 1))]), length


def marginals(unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float]:
    """Forward-backward over one document: P(line is good) per line, and log Z. unary: lines x 2 scores; trans: 2 x 2 scores."""
    n = len(unary)
    t00, t01, t10, t11 = trans.ravel().tolist()
    u = unary.tolist()
    f = [u[0]]
    for a, b in u[1:]:
        p, q = f[-1]
        x, y = p + t00, q + t10
        m = x if x > y else y
        z, w = p + t01, q + t11
        k = z if z > w else w
        f.append([a + m + math.log1p(math.exp(-abs(x - y))), b + k + math.log1p(math.exp(-abs(z - w)))])
    good = np.empty(n)
    p = q = 0.0
    for i in range(n - 1, -1, -1):
        a, b = f[i][0] + p, f[i][1] + q
        good[i] = 1 / (1 + math.exp(min(700.0, a - b)))
        if i:
            x, y = u[i][0] + p, u[i][1] + q
            r, s, v, w = t00 + x, t01 + y, t10 + x, t11 + y
            p, q = max(r, s) + math.log1p(math.exp(-abs(r - s))), max(v, w) + math.log1p(math.exp(-abs(v - w)))
    m = max(f[-1])
    return good, m + math.log(sum(math.exp(v - m) for v in f[-1]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Newton steps of a weighted, ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * h[:, None]).T @ x + ridge * weight.sum() * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * weight.sum() * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def chain_pass(score: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: P(good) per line, expected pairs of labels (documents x 2 x 2), and log Z per document.

    score: each line's score of good over bad; size: lines per document. Step t moves all documents that have a line t.
    """
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    longer = np.searchsorted(-size[order], -np.arange(int(size.max())), "left")  # documents with more than t lines
    e = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], 1)
    t = np.exp(trans - trans.max())
    f, b, norm = e.copy(), np.ones_like(e), np.empty(len(e))
    for k, n in enumerate(longer):
        at = start[order[:n]] + k
        if k:
            f[at] *= f[at - 1] @ t
        norm[at] = f[at].sum(1)
        f[at] /= norm[at, None]
    pairs = np.zeros((len(size), 2, 2))
    for k in range(len(longer) - 1, 0, -1):
        doc = order[: longer[k]]
        at = start[doc] + k
        back = e[at] * b[at] / norm[at, None]
        pairs[doc] += f[at - 1][:, :, None] * t * back[:, None, :]
        b[at - 1] = back @ t.T
    z = np.add.reduceat(np.log(norm) + np.maximum(score, 0), start) + (size - 1) * trans.max()
    return (f * b)[:, 1], pairs, z


def likelihood(x: np.ndarray, y: np.ndarray, size: np.ndarray, w: np.ndarray, trans: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood per line of each document's labels, equally weighted documents, less the penalty; its slopes; marginals and seen pairs.

    The slopes are observed less expected features (of lines) and pairs (of neighbours), expectations by forward-backward.
    """
    score = np.clip(x @ w, -30, 30)
    good, pairs, z = chain_pass(score, size, trans)
    start = np.cumsum(size) - size
    inner = np.ones(len(y), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    doc = np.repeat(np.arange(len(size)), size)
    labels = y.astype(np.int64)
    seen = np.zeros((len(size), 2, 2))
    np.add.at(seen, (doc[at], labels[at - 1], labels[at]), 1.0)
    share = 1.0 / size / len(size)
    value = float(share @ (np.add.reduceat(score * y, start) + (seen * trans).sum((1, 2)) - z)) - ridge / 2 * float(w @ w + (trans**2).sum())
    slope = x.T @ (share[doc] * (y - good)) - ridge * w
    return value, slope, ((seen - pairs) * share[:, None, None]).sum(0) - ridge * trans, good, (seen * share[:, None, None]).sum(0)


def climb(x: np.ndarray, y: np.ndarray, size: np.ndarray, w: np.ndarray, trans: np.ndarray, steps: int, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and transitions that climb the chains' conditional likelihood together.

    The slopes are exact; steps are scaled by the curvature that lines and pairs would have on their own, and halved until the likelihood rises.
    """
    doc = np.repeat(np.arange(len(size)), size)
    share = (1.0 / size / len(size))[doc]
    value, dw, dt, good, seen = likelihood(x, y, size, w, trans, ridge)
    for _ in range(steps):
        h = share * np.maximum(good * (1 - good), 1e-4)
        step_w = np.linalg.solve((x * h[:, None]).T @ x + ridge * np.eye(len(w)), dw)
        step_t = dt / (np.maximum(seen * (1 - seen), 0.02) + ridge)
        pace = 1.0
        while pace > 1e-4:
            new = likelihood(x, y, size, w + pace * step_w, trans + pace * step_t, ridge)
            if new[0] > value:
                break
            pace /= 2
        else:
            break
        gain, w, trans = new[0] - value, w + pace * step_w, trans + pace * step_t
        value, dw, dt, good, seen = new
        if gain < 1e-9:
            break
    return w, trans


def fit_field(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, steps: int = 8) -> dict:
    """Fit the field on documents (features, lengths, quality).

    Only documents are labelled. All lines of good documents count as good; the lines of a bad document
    start bad and, round by round, those that the chain finds good are released, but never all. Given the lines'
    labels, unary weights and transitions climb the chains' conditional likelihood together; last, documents are
    calibrated on their length-weighted marginals.
    """
    x = np.vstack([d[0] for d in docs])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    mean[-1], scale[-1] = 0.0, 1.0
    x = (x - mean) / scale
    size = np.array([len(d[1]) for d in docs])
    start = np.cumsum(size) - size
    quality = np.array([d[2] for d in docs])
    if len(set(quality.tolist())) < 2:
        share = (quality.sum() + 1) / (len(quality) + 2)
        return {"mean": mean, "scale": scale, "unary": np.zeros(x.shape[1]), "trans": np.zeros((2, 2)), "doc": np.array([0.0, 0.0, math.log(share / (1 - share))])}
    y = np.repeat(quality, size).astype(float)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    for k in range(rounds + 1):
        w, trans = climb(x, y, size, w, trans, steps if k < rounds else 3 * steps)
        if k < rounds:
            good, _, _ = chain_pass(np.clip(x @ w, -30, 30), size, trans)
            least = np.repeat(np.minimum.reduceat(good, start), size)
            y = np.where(np.repeat(quality, size) == 1, 1.0, (good > np.maximum(0.5, least)).astype(float))
    field = {"mean": mean, "scale": scale, "unary": w, "trans": trans}
    z = np.array([document_evidence(f, n, field) for f, n, _ in docs])
    field["doc"] = _logistic(np.hstack([z, np.ones((len(z), 1))]), quality.astype(float), np.ones(len(z)), 1e-4)
    return field


def document_evidence(features: np.ndarray, length: np.ndarray, field: dict) -> list[float]:
    """Of the lines' good marginals, weighted by length: the mean as log-odds, and the mean of their log-odds. Nothing else of the lines enters."""
    score = (features - field["mean"]) / field["scale"] @ field["unary"]
    good, _ = marginals(np.stack([np.zeros(len(score)), np.clip(score, -30, 30)], 1), field["trans"])
    weight = (length + 1) / (length + 1).sum()
    share, good = min(1 - 1e-4, max(1e-4, float(good @ weight))), np.clip(good, 1e-6, 1 - 1e-6)
    return [math.log(share / (1 - share)), float(np.log(good / (1 - good)) @ weight)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fit_docs: int = FIT_DOCS) -> dict:
    """Fit on at most fit_docs labelled documents outside fold 0, chosen by a hash of their id; one task, bounded."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_fold(id_col, folds) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_docs)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(known), "id")

    def featurize(batches):
        for batch in batches:
            for key, text, quality in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "quality"))):
                f, n = line_features(text)
                yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([quality]), pa.array([pickle.dumps((f.astype("f4"), n.astype("f4")))])], ["id", "quality", "data"])

    def train(batches):
        rows = sorted((i, q, d) for b in batches for i, q, d in zip(*(b.column(k).to_pylist() for k in range(3))))
        got, lines = [], 0
        for _, q, d in rows:
            f, n = pickle.loads(d)
            if lines + len(n) <= FIT_LINES or not got:
                got.append((f.astype(float), n.astype(float), q))
                lines += len(n)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_field(got) if got else None)])], ["model"])

    sample = picked.mapInArrow(featurize, "id string, quality long, data binary")
    model = sample.repartition(1).mapInArrow(train, "model binary").collect()
    found = pickle.loads(bytes(model[0]["model"])) if model else None
    width = 3 * OWN + 1
    return found or {"mean": np.zeros(width), "scale": np.ones(width), "unary": np.zeros(width), "trans": np.zeros((2, 2)), "doc": np.zeros(3)}


def score(docs: DataFrame, field: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability that the document is good, from its text alone."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                z = float(np.dot([*document_evidence(*line_features(text), field), 1.0], field["doc"]))
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Null and empty texts are one empty line and get a score like any other; a null doc_id counts as the
    empty text in the fold; repeated rows are scored each; without usable labels every score is 0.5; an
    empty table gives an empty result.
    """
    found = score(docs, fit(docs, labels, id_col, text_col, folds), id_col, text_col)
    return found.select("doc_id", (F.crc32(doc_key("doc_id").cast("binary")) % folds == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    field = fit(docs, labels, id_col, text_col, folds)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = []
            for text in batch.column(place).to_pylist():
                z = float(np.dot([*document_evidence(*line_features(text.encode() if text is not None else None), field), 1.0], field["doc"]))
                keep.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

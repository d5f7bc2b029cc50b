"""Personal data by patterns and a skip-chain conditional random field with loopy message passing."""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field's weights are fitted on, at most; all documents are searched.
FIT_DOCS = 2_000
#: Documents and nodes that exchange messages at once, which bounds memory.
_BATCH_DOCS, _BATCH_NODES = 256, 100_000
ROUNDS = 10

# Fixed patterns of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost match starts where a run of digits starts, and gives none of its digits back; so each run is read a few times at most.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|"
FEATURES = 16


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed: leftmost matches per kind; failing ones are dropped, not retried."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        # Only the run of local characters up to this @ can start a match, and all of it does.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done if found else 0))
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _keys(token: str) -> set[str]:
    """What makes distant tokens similar: the token itself, the part before an @, and its digits."""
    core = token.strip(_EDGE).lower()
    out = {core, core.split("@")[0], _NOT_DIGIT.sub("", core)}
    return {k for k in out if len(k) >= 6}


def graph_of(text: str, spans: list[tuple[int, str, int]]) -> dict | None:
    """Nodes, observed labels, features, chain edges and skip edges of a document, with or without base spans.

    Nodes are tokens with a digit or @, tokens within a span, and tokens similar to one of those; each other token is
    certainly no entity. Similar tokens are linked in a chain of their occurrences, never all with all.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    label = np.zeros(len(tokens), np.int64)
    starts, ends = (np.array([t[i] for t in tokens]) for i in range(2))
    for s, kind, e in spans:
        label[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = 1 + KINDS.index(kind)
    words = [text[a:b] for a, b in tokens]
    likely = [bool(label[i]) or "@" in w or _DIGITS.search(w) is not None for i, w in enumerate(words)]
    anchors = set().union(*(_keys(words[i]) for i in np.flatnonzero(likely)))
    similar = [() if len(w) < 6 else _keys(w) & anchors for w in words]
    nodes = [i for i, w in enumerate(words) if likely[i] or similar[i]]
    place = {i: k for k, i in enumerate(nodes)}
    chain = [(place[i], place[i + 1]) for i in nodes if i + 1 in place]
    last: dict[str, int] = {}
    skip = set()
    for i in nodes:
        for key in similar[i]:
            if key in last:
                skip.add((place[last[key]], place[i]))
            last[key] = i
    x = np.zeros((len(nodes), FEATURES))
    for k, i in enumerate(nodes):
        w = words[i]
        d = len(w) - len(_DIGITS.sub("", w))
        x[k] = (
            1, "@" in w, w.count("."), w.count(".") == 3, d == 0, 0 < d < 4, 4 <= d < 8, 8 <= d < 14, d >= 14, w[0] == "+", "(" in w or ")" in w,
            "-" in w, any(c.isalpha() for c in w), i - 1 in place, i + 1 in place, d == len(w),
        )
    return {"label": label[nodes], "x": x, "chain": chain, "skip": sorted(skip), "spans": [tokens[i] for i in nodes], "index": nodes}


#: Prior mean of the agreement of similar tokens' labels; all other weights' prior mean is 0.
AGREEMENT = 0.5


def fit_weights(graphs: list[dict], rounds: int = 400, ridge: float = 1.0) -> dict | None:
    """Node, chain and skip weights together, by the pseudo-likelihood of all nodes given their neighbours' labels.

    The objective is concave: log P(label | features, labels of chain and skip neighbours) summed over nodes, less half of ridge times the squared
    distance from the prior mean. Gradient steps with momentum climb it.
    """
    if not graphs:
        return None
    n = len(KINDS) + 1
    x, y = np.vstack([g["x"] for g in graphs]), np.concatenate([g["label"] for g in graphs])
    base = np.cumsum([0] + [len(g["label"]) for g in graphs])
    scale = np.maximum(1.0, np.abs(x).max(0))
    edges = {k: np.array([(a + o, b + o) for g, o in zip(graphs, base) for a, b in g[k]], np.int64).reshape(-1, 2) for k in ("chain", "skip")}
    hot = np.eye(n)[y]
    # What each node sees: its features, the labels before and behind it, and those of similar tokens.
    left, right, same = np.zeros((3, len(y), n))
    np.add.at(left, edges["chain"][:, 1], hot[edges["chain"][:, 0]])
    np.add.at(right, edges["chain"][:, 0], hot[edges["chain"][:, 1]])
    for a, b in (edges["skip"].T, edges["skip"].T[::-1]):
        np.add.at(same, a, hot[b])
    x = x / scale
    prior = {"w": np.zeros((x.shape[1], n)), "chain": np.zeros((n, n)), "skip": AGREEMENT * np.eye(n)}
    now = {k: v.copy() for k, v in prior.items()}
    pace = {k: np.zeros_like(v) for k, v in prior.items()}
    rate = 1.0 / (ridge + 0.25 * len(y) * max(1.0, (x**2).sum(1).max() + left.sum(1).max() + right.sum(1).max() + (same.sum(1) ** 2).max()))
    for k in range(rounds):
        ahead = {name: now[name] + k / (k + 3) * pace[name] for name in now}
        score = x @ ahead["w"] + left @ ahead["chain"] + right @ ahead["chain"].T + same @ ahead["skip"]
        p = np.exp(score - score.max(1, keepdims=True))
        miss = hot - p / p.sum(1, keepdims=True)
        skip = same.T @ miss
        slope = {"w": x.T @ miss, "chain": left.T @ miss + (right.T @ miss).T, "skip": (skip + skip.T) / 2}
        for name in now:
            new = ahead[name] + rate * (slope[name] - ridge * (ahead[name] - prior[name]))
            pace[name], now[name] = new - now[name], new
    return {"w": now["w"] / scale[:, None], "chain": now["chain"], "skip": now["skip"]}


def believe(graphs: list[dict], model: dict) -> list[np.ndarray]:
    """Loopy sum-product over all graphs of a batch at once: node marginals per document. Base labels are clamped."""
    n, base = len(KINDS) + 1, np.concatenate(([0], np.cumsum([len(g["label"]) for g in graphs])))
    unary = np.vstack([g["x"] for g in graphs]) @ model["w"]
    unary = np.clip(unary - unary.max(1, keepdims=True), -12, 0)
    label = np.concatenate([g["label"] for g in graphs])
    known = np.flatnonzero(label)
    unary[known] = -1e3
    unary[known, label[known]] = 0
    src, dst, table = [], [], []
    for kind in ("chain", "skip"):
        pairs = np.array([(a + o, b + o) for g, o in zip(graphs, base) for a, b in g[kind]], np.int64).reshape(-1, 2)
        src += [pairs[:, 0], pairs[:, 1]]
        dst += [pairs[:, 1], pairs[:, 0]]
        table += [np.broadcast_to(t, (len(pairs), n, n)) for t in (model[kind], model[kind].T)]
    counts = [len(s) for s in src]
    back = np.concatenate([np.arange(counts[0]) + counts[0], np.arange(counts[0]), np.arange(counts[2]) + 2 * counts[0] + counts[2], np.arange(counts[2]) + 2 * counts[0]])
    src, dst, table = np.concatenate(src), np.concatenate(dst), np.concatenate(table)
    message = np.zeros((len(src), n))
    total = unary.copy()
    for _ in range(ROUNDS):
        into = total[src] - message[back]
        joint = into[:, :, None] + table
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(1))
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        total = unary.copy()
        np.add.at(total, dst, message)
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return [p[a:b] for a, b in zip(base[:-1], base[1:])]


def added_spans(text: str, spans: list[tuple[int, str, int]], graph: dict, belief: np.ndarray) -> list[tuple[int, str, int]]:
    """Spans of unobserved tokens that the field labels, neighbours of one kind joined; those that meet a base span are left to it."""
    best = belief.argmax(1)
    take = [k for k in np.flatnonzero((graph["label"] == 0) & (best > 0)) if belief[k, best[k]] > 0.5]
    out: list[list] = []
    for k in take:
        s, e = graph["spans"][k]
        word = text[s:e]
        s, e = s + len(word) - len(word.lstrip(_EDGE)), e - (len(word) - len(word.rstrip(_EDGE)))
        if s >= e:
            continue
        if out and out[-1][3] == graph["index"][k] - 1 and out[-1][1] == best[k]:
            out[-1][2], out[-1][3] = e, graph["index"][k]
        else:
            out.append([s, best[k], e, graph["index"][k]])
    return [(s, KINDS[k - 1], e) for s, k, e, _ in out if not any(a < e and s < b for a, _, b in spans)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> dict | None:
    """Weights from at most fit_docs documents that hold base spans, chosen by a hash of their id; one bounded task."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def labelled(batches):
        for batch in batches:
            yield batch.select(["id"]).filter(pa.array([bool(base_spans(t)) for t in batch.column(1).to_pylist()], pa.bool_()))

    hits = rows.where(F.col("text").rlike("[0-9@]") & F.col("id").isNotNull()).mapInArrow(labelled, "id long")
    ids = hits.distinct().orderBy(F.xxhash64("id"), "id").limit(fit_docs)
    picked = rows.join(F.broadcast(stored(ids, "sample")), "id")

    def graphs(batches):
        for batch in batches:
            for key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "text"))):
                spans = base_spans(text or "")
                if spans:
                    g = graph_of(text, spans)
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([pickle.dumps({k: g[k] for k in ("label", "x", "chain", "skip")})])], ["id", "graph"])

    def train(batches):
        found = sorted((k, g) for b in batches for k, g in zip(*(b.column(i).to_pylist() for i in range(2))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_weights([pickle.loads(g) for _, g in found]))])], ["model"])

    model = picked.mapInArrow(graphs, "id long, graph binary").repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(bytes(model[0]["model"])) if model else None


def field_spans(texts: list[str | None], base: list[list], model: dict | None):
    """(place, added spans) of every text with a candidate token, base spans or not; bounded graphs at a time."""
    part: list[tuple[int, dict]] = []
    nodes = 0

    def flush():
        for (i, g), belief in zip(part, believe([g for _, g in part], model)):
            yield i, added_spans(texts[i], base[i], g, belief)

    for i, text in enumerate(texts if model else ()):
        if not text or not _CANDIDATE.search(text):
            continue
        part.append((i, graph_of(text, base[i])))
        nodes += len(part[-1][1]["label"])
        if len(part) >= _BATCH_DOCS or nodes >= _BATCH_NODES:
            yield from flush()
            part, nodes = [], 0
    if part:
        yield from flush()


def find(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every document, whole texts; n_spans counts all spans."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = list(base)
            for i, more in field_spans(texts, base, model):
                spans[i] = sorted(base[i] + more, key=lambda s: (s[0], KINDS.index(s[1])))
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in KINDS]
            hashes = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array([digest(s) for s in spans], pa.string()), pa.array([len(s) for s in spans], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document. Null texts are empty and hold nothing; repeated rows are searched each; a null doc_id
    stays null and is only left out of the fit; an empty table gives an empty result."""
    return find(docs, fit(docs, id_col, text_col), id_col, text_col)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; all columns are kept, null texts stay null."""
    model = fit(docs, id_col, text_col)
    names = docs.columns

    def run(batches):
        at = names.index(text_col)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            base = [base_spans(t or "") for t in texts]
            added = dict(field_spans(texts, base, model))
            for i, found in enumerate(base):
                spans = sorted(found + added.get(i, []))
                if not spans:
                    continue
                out, done = [], 0
                for s, kind, e in spans:
                    if e > done:
                        out += [texts[i][done : max(s, done)], f"[{kind.upper()}]" if s >= done else ""]
                        done = e
                texts[i] = "".join(out) + texts[i][done:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length_col and length_col in names:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out

"""Quality classifier (operator 7): a linear-chain conditional random field over a document's lines.

Each line is good or bad. Its emission is a weighted sum of binned features of the line and of the
lines before and after it; neighbouring labels share learned transition weights. A line of a
labelled document carries that document's label in training. A document's quality is the mean of
its lines' forward-backward marginals of "good", weighted by line length.

Training takes the lines' features of at most about MAX_TRAIN labelled documents and MAX_TRAIN_LINES
lines, chosen by a hash of doc_id, to the driver (a few numbers a line); scoring is one pass over all texts without a
shuffle. Null texts are empty ones: a single empty line, scored like any other. Without both labels
in the training rows, every score is the share of label 1 (0.5 without any). Repeated rows stay
apart; columns other than those named are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.llm import codepoints as cp
from itemforge.llm.common import release, text_slices

MAX_TRAIN = 6_000
MAX_TRAIN_LINES = 60_000
BINS = 14
THRESHOLD = 0.3
FEATURES = ("log_length", "letters", "upper", "digits", "spaces", "stops", "symbols", "word_length", "repeats", "word_repeats", "bars", "starts_upper")
STOPS = [ord(c) for c in ".,;:?'\"()-"]
BAR = ord("|")


def _as_before(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which words equal the word before them on the same line."""
    out = np.zeros(len(h), bool)
    out[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features: lines x FEATURES, line lengths, lines of each document)."""
    points, starts, ends = cp.join(texts)
    points = np.concatenate([points, np.array([10], np.uint32)])
    kind = cp.classes()[points]
    stop = np.flatnonzero(points == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    doc = np.searchsorted(starts, start, side="right") - 1
    length = stop - start
    n = np.maximum(length, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[stop] - total[start]

    letters = count(kind & cp.ALPHA > 0)
    digits = count(kind & cp.DIGIT > 0)
    spaces = count(kind & cp.SPACE > 0)
    stops = count(np.isin(points, STOPS))
    bars = count(points == BAR)
    symbols = length - letters - digits - spaces - stops
    a, b = cp.runs((kind & cp.SPACE) == 0)
    line = np.searchsorted(start, a, side="right") - 1
    words = np.bincount(line, minlength=len(start))
    h = cp.run_hashes(points, a, b)
    same = _as_before(h, line)
    repeats = np.bincount(line[same], minlength=len(start))
    # Repeats at any distance in the line: words less distinct words.
    key = np.lexsort((h, line))
    again = _as_before(h[key], line[key])
    word_repeats = np.bincount(line[key][again], minlength=len(start))
    w = np.maximum(words, 1)
    features = np.stack(
        [
            np.log1p(length), letters / n, count(kind & cp.UPPER > 0) / np.maximum(letters, 1), digits / n, spaces / n, stops / n, symbols / n,
            (length - spaces) / w, repeats / w, word_repeats / w, bars / w, (kind[start] & cp.UPPER > 0).astype(float),
        ],
        axis=1,
    ).astype(np.float32)
    return features, length, np.bincount(doc, minlength=len(texts))


@dataclass
class Crf:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # 3 (before, own, after) x features x BINS
    bias: float
    moves: np.ndarray  # 2 x 2, from and to
    prior: float


def _bins(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], features[:, k], side="right") for k in range(features.shape[1])], axis=1)


def _cells(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the weights that each line switches on; -1 beyond a document's border."""
    lines, wide = bins.shape
    own = bins + np.arange(wide) * BINS
    first = np.zeros(lines, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    last = np.concatenate([first[1:], [True]]) if lines else first
    out = np.full((lines, 3 * wide), -1, np.int64)
    out[:, wide : 2 * wide] = own + wide * BINS
    out[1:, :wide] = np.where(first[1:, None], -1, own[:-1])
    out[:-1, 2 * wide :] = np.where(last[:-1, None], -1, own[1:] + 2 * wide * BINS)
    return out


def _emissions(cells: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    flat = np.concatenate([weights.ravel(), [0.0]])
    return flat[cells].sum(1) + bias


def forward_backward(emit: np.ndarray, counts: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" of all documents' lines at once, and the pair marginals (2 x 2) summed
    with the documents' weights.
    emit: the log-odds of good; step t handles line t of all documents that have one."""
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    e = np.stack([np.zeros(len(emit)), emit], 1)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    if not steps:
        return np.zeros(0), np.zeros((2, 2))
    now = e[start[: active[0]]]
    alpha[start[: active[0]]] = now
    for t in range(1, steps):
        k = active[t]
        v = now[:k, :, None] + moves
        now = np.logaddexp(v[:, 0], v[:, 1]) + e[start[:k] + t]
        alpha[start[:k] + t] = now
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        at = start[:k] + t
        v = moves + (e[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(v[:, :, 0], v[:, :, 1])
        joint = alpha[at][:, :, None] + v
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=(1, 2), keepdims=True))
        pairs += joint.sum(0) if weight is None else np.tensordot(weight[order[:k]], joint, 1)
    odds = np.clip((alpha + beta)[:, 1] - (alpha + beta)[:, 0], -700, 700)
    return 1 / (1 + np.exp(-odds)), pairs


def _edges(features: np.ndarray) -> np.ndarray:
    """Bin borders of each feature: quantiles, where most lines are, and even steps over the range,
    where the rare ones are."""
    quantiles = np.quantile(features, [0.01, 0.05, 0.2, 0.4, 0.6, 0.8, 0.95, 0.99], axis=0)
    steps = np.linspace(features.min(0), features.max(0), BINS - len(quantiles) + 1)[1:-1]
    return np.sort(np.concatenate([quantiles, steps]), axis=0).T


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-5) -> Crf:
    """Maximum likelihood with a ridge, by Adam. labels: one for each document."""
    prior = float(labels.mean()) if len(labels) else 0.5
    wide = len(FEATURES)
    edges = _edges(features) if len(features) else np.zeros((wide, BINS - 1))
    model = Crf(edges, np.zeros((3, wide, BINS)), 0.0, np.zeros((2, 2)), prior)
    if not 0 < prior < 1:
        return model
    cells = _cells(_bins(features, edges), counts)
    y = np.repeat(labels, counts).astype(float)
    # Every document weighs the same, whatever its number of lines.
    weight = 1 / np.maximum(counts, 1) / len(counts)
    by_line = np.repeat(weight, counts)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (np.maximum(counts - 1, 0) * weight)[labels == label].sum()
    size = 3 * wide * BINS
    theta = np.zeros(size + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(_emissions(cells, theta[:size], theta[size]), counts, moves, weight)
        d = (y - p) * by_line
        g = np.zeros_like(theta)
        g[:size] = np.bincount(np.where(cells < 0, size, cells).ravel(), np.repeat(d, cells.shape[1]), size + 1)[:size]
        g[size] = d.sum()
        g[-4:] = (seen - pairs).ravel()
        g -= ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Crf(edges, theta[:size].reshape(3, wide, BINS), float(theta[size]), theta[-4:].reshape(2, 2), prior)


def score_texts(model: Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document scores, line marginals, lines of each document)."""
    features, length, counts = line_features(texts)
    if not 0 < model.prior < 1:
        return np.full(len(texts), model.prior), np.full(len(length), model.prior), counts
    p, _ = forward_backward(_emissions(_cells(_bins(features, model.edges), counts), model.weights, model.bias), counts, model.moves)
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = length + 1.0
    return np.bincount(doc, p * weight, len(texts)) / np.bincount(doc, weight, len(texts)), p, counts


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN, max_lines: int = MAX_TRAIN_LINES) -> Crf:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1; null labels are left out).

    The labels are thinned to about max_docs before the join, so that side is bounded and broadcast
    and the documents don't move; long documents thin them once more, to about max_lines lines."""
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    labels = labels.where("quality is not null").select("doc_id", "quality")
    share = min(1.0, max_docs / max(labels.count(), 1))
    few = labels.where(chosen < int(share * (1 << 20))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    rows = rows.where(chosen < int(share * min(1.0, max_lines / lines) * (1 << 20)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_slices(batch, "text"):
                features, _, counts = line_features(part.column("text").to_pylist())
                cuts = np.cumsum(counts)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([x.tobytes() for x in np.split(features, cuts)])],
                    names=["doc_id", "quality", "features"],
                )

    found = rows.mapInArrow(measure, "doc_id long, quality int, features binary").collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["features"]))
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, len(FEATURES)) for r in found]
    return fit(
        np.concatenate([*features, np.zeros((0, len(FEATURES)), np.float32)]),
        np.array([len(x) for x in features], np.int64),
        np.array([r["quality"] for r in found], np.int64),
    )


def score(df: DataFrame, model: Crf, text: str = "text", lines: bool = False) -> DataFrame:
    """df with score (0 to 1), predicted (1 from THRESHOLD up) and, with lines, each line's marginal."""
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    new += [T.StructField("line_scores", T.ArrayType(T.DoubleType()))] if lines else []
    keep = [f for f in df.schema.fields if f.name not in {n.name for n in new}]
    names = [f.name for f in keep]
    at_text = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_slices(batch, at_text):
                s, p, counts = score_texts(model, [x or "" for x in part.column(at_text).to_pylist()])
                columns = [*part.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
                if lines:
                    columns.append(pa.array([x.tolist() for x in np.split(p, np.cumsum(counts)[:-1])]))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(n.name for n in new)])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType([*keep, *new]))

"""Language ID (operator 2): per-word scores and Viterbi spans.

A word is a run of letters. Its Unicode script narrows the candidates to the languages that were
seen in that script; each candidate scores the word by the log-likelihood of its character trigrams
(hashed, with word borders). Viterbi over the words, with a penalty for each switch of language,
labels spans of mixed-language text; the language of a text is the one with most labelled letters.

Training counts trigrams on the executors, over labelled rows taken by a hash of doc_id so that
about MAX_TRAIN rows at most are used; what reaches the driver is one count table for each language.

A null text, or one without letters, is `und` with score 0 and no spans. Null languages aren't
learned from. With nothing to learn from, every text is `und`. Repeated rows stay apart; ties go to
the language first in alphabetical order; other columns are carried along, but for those named
lang_pred, score and lang_spans, which are replaced. Very long texts are labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.llm import codepoints as cp

MAX_TRAIN = 20_000
BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
OUT_OF_SCRIPT = 60.0
#: First code point of each block range and its script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_CODES = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], np.int8)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages, float32
    allowed: np.ndarray  # scripts x languages


def _trigrams(texts: list[str]):
    """Letters' trigram buckets, and the words they make: (bucket, word start in letters, word
    starts, ends in code points, script, document)."""
    points, starts, ends = cp.join(texts)
    letter = (cp.classes()[points] & cp.ALPHA).astype(bool)
    low = np.where(letter, cp.lower()[points], np.uint32(32))
    pad = np.concatenate([[32], low, [32]]).astype(np.uint32)
    h = pad[:-2] * np.uint32(0x9E3779B1) ^ pad[1:-1] * np.uint32(0x85EBCA77) ^ pad[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    a, b = cp.runs(letter)
    bucket = (h >> np.uint32(17))[letter]
    first = np.concatenate([[0], np.cumsum(b - a)[:-1]]).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    script = _CODES[np.searchsorted(_STARTS, points[a], side="right") - 1]
    doc = np.searchsorted(starts, a, side="right") - 1
    return bucket, first, a - starts[doc], b - starts[doc], script, doc


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """labelled: doc_id, text, lang. Rows without a text or lang are left out."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = rows.select("lang").count()
    share = min(1.0, max_rows / max(n, 1))
    rows = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else F.lit(True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                mine = [i for i in np.flatnonzero(langs == lang)]
                for at in range(0, len(mine), 512):
                    bucket, _, _, _, script, _ = _trigrams([texts[i] for i in mine[at : at + 512]])
                    c, s = held.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                    c += np.bincount(bucket, minlength=BUCKETS)
                    s += np.bincount(script, minlength=len(SCRIPT_NAMES))
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([c.tobytes() for c, _ in held.values()]), pa.array([s.tobytes() for _, s in held.values()])],
                names=["lang", "counts", "scripts"],
            )

    def add(batches):
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, c, s in zip(*(batch.column(k).to_pylist() for k in ("lang", "counts", "scripts")), strict=True):
                new = [np.frombuffer(c, np.int64), np.frombuffer(s, np.int64)]
                total[lang] = [x + y for x, y in zip(total[lang], new, strict=True)] if lang in total else new
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([c.tobytes() for c, _ in total.values()]), pa.array([s.tobytes() for _, s in total.values()])],
                names=["lang", "counts", "scripts"],
            )

    schema = "lang string, counts binary, scripts binary"
    # The sums of a language meet in one task: as many small tables as there are input partitions.
    tables = rows.mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).collect()
    tables.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in tables], np.float64).reshape(len(tables), BUCKETS)
    scripts = np.array([np.frombuffer(r["scripts"], np.int64) for r in tables], np.float64).reshape(len(tables), len(SCRIPT_NAMES))
    log_p = np.log((counts + 0.2) / (counts.sum(1, keepdims=True) + 0.2 * BUCKETS))
    allowed = scripts >= 0.005 * np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed[:, :] &= scripts > 0
    return Model([r["lang"] for r in tables], np.ascontiguousarray(log_p.T, np.float32), np.ascontiguousarray(allowed.T))


def _word_scores(model: Model, bucket: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
    scores = np.empty((len(first), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        scores[:, k] = np.add.reduceat(model.log_p[:, k][bucket], first)
    ok = model.allowed[script]
    scores -= np.float32(OUT_OF_SCRIPT) * (~ok & ok.any(1, keepdims=True))
    return scores


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best labels of all documents' words at once. scores: words x languages, document after
    document; counts: words of each document. Step t handles word t of all that have one."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    back = np.zeros(scores.shape, np.int16)
    if not len(active) or not active[0]:
        return labels
    own = np.arange(scores.shape[1], dtype=np.int16)
    best = scores[start[: active[0]]].astype(np.float64)
    for t in range(1, len(active)):
        k = active[t]
        v = best[:k]
        top = v.argmax(1)
        move = v[np.arange(k), top] - penalty
        stay = v >= move[:, None]
        at = start[:k] + t
        back[at] = np.where(stay, own, top[:, None])
        best[:k] = np.maximum(v, move[:, None]) + scores[at]
    now = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return labels


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df (without its text) with lang_pred, score and lang_spans (code points)."""
    keep = [f for f in df.schema.fields if f.name not in (text, "lang_pred", "score", "lang_spans")]
    fields = [*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", SPANS)]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for top in range(0, batch.num_rows, 4096):
                part = batch.slice(top, 4096)
                texts = part.column(part.num_columns - 1).to_pylist()
                pieces = []
                for at in range(0, len(texts), 512):
                    bucket, first, a, b, script, doc = _trigrams([x or "" for x in texts[at : at + 512]])
                    if len(first) and m.languages:
                        pieces.append((_word_scores(m, bucket, first, script), a, b, doc + at))
                columns = part.columns[:-1]
                n = len(texts)
                langs = len(m.languages)
                if pieces:
                    scores, a, b, doc = (np.concatenate(x) for x in zip(*pieces, strict=True))
                    label = viterbi(scores, np.bincount(doc, minlength=n))
                    weight = np.bincount(doc * langs + label, b - a, n * langs).reshape(n, langs)
                    total = weight.sum(1)
                    pred = np.where(total > 0, weight.argmax(1), langs)
                    score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
                    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])
                    at = np.flatnonzero(new)
                    to = np.concatenate([at[1:] - 1, [len(doc) - 1]])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=n))]).astype(np.int32)
                    spans = pa.StructArray.from_arrays([pa.array(a[at], pa.int32()), pa.array(b[to], pa.int32()), pa.array(names[label[at]], pa.string())], names=["start", "end", "lang"])
                else:
                    pred, score, offsets = np.full(n, langs), np.zeros(n), np.zeros(n + 1, np.int32)
                    spans = pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                columns += [pa.array(names[pred], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text)).mapInArrow(run, T.StructType(fields))


def fold(column: str, of: int) -> Column:
    """crc32 of the id as text, modulo of; null ids are in no fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))

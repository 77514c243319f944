"""Secret scans (operator 3): fixed patterns, and a randomness test battery for what they miss.

Patterns (kinds assign, access, hex) are leftmost and non-overlapping per kind. Beside them, every
run of at least MIN_RUN key-like characters is a candidate. Its encoding is inferred as the smallest
of the known alphabets that holds it. The evidence is the likelihood of uniform draws from that
alphabet against the likelihood of the run as ordinary text, a chain of characters fitted to
identifiers and words: symbol counts and lag-1 order, which chi-squared and serial correlation only
compare with uniform draws, weigh in where ordinary text differs. A ratio over a distribution
exceeds x with chance 1/x at most, so its inverse, times the number of alphabets to choose from, is a
p-value under ordinary text, at every length and also for runs of one character class. Within a
document the p-values are weighted by length, as long runs carry more evidence, and go through
Benjamini-Hochberg control (kind random).

A run can be neither ordinary nor drawn at random (aaaa, abcd1234 again and again). So a discovery
also has to pass three tests of uniform draws: chi-squared of the symbol counts, the runs test about
the middle of the alphabet, and lag-1 serial correlation (Bonferroni over the three). These three
only refuse; about REJECT_RANDOM of true keys are refused by them.

Offsets are code points, end exclusive. Null and empty texts have no spans. Repeated rows stay
apart, an empty table gives an empty result, and other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.llm.common import release

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_RUN = 20
REJECT_RANDOM = 0.01  # a candidate less likely than this under uniform draws isn't one
DISCOVERY_RATE = 0.01
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "+/-_"
#: From the smallest to the largest alphabet; the first that holds a run is its encoding.
ALPHABETS = [
    ("decimal", DIGITS), ("hex", DIGITS + LOWER[:6]), ("hex_upper", DIGITS + UPPER[:6]), ("lower", LOWER), ("upper", UPPER),
    ("base32", UPPER + "234567"), ("base32_lower", LOWER + "234567"), ("base36", DIGITS + LOWER), ("base36_upper", DIGITS + UPPER),
    ("letters", UPPER + LOWER), ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + MARKS),
]
#: Ordinary letters: for each letter before, and last for the start of a word, -2 log2 of the chance
#: of a to z as a base-36 digit. From identifiers of Python's library and words of four languages.
LETTER_COST = """
ca89afbe9he796cah7859deedi 7cbd5fff8bh4ed7ci99c8ihiag 7hbe7fg58k89de5eh9c7afhidj 7cda4deb5hhafb6eha89afdgej
8d979cdd9ig9b6bce568cddbfe 8ecb77ed5jg8ed6di7988gfich 7cde3fb88kg9c89dk88a9eejhf 5bef4hf98keaea7eja98cfcjgf
ac8a7cafdih9a46bga87fchejc 3jbe6fjfaibegf7ckd9d6khkfk 9dbb3cbd7jg9fabcfb7bcfaidi 7fdb4egf5ig7fd7djeaabfhj6i
5afc3fhf6jfbad77ke9cahhjek 8c976c6b9idbeb8dgc85bcdjgg cca9cacgbhd994bai69a7cbfhi 5fcd59gb9kf7fe79h6a8agejbk
dfeecghfeikcgceeccae1hhjjk 6cbb4ecc7idbba7ci988bedich 9e8d6ed77gdbcd99ec849gehcj 7dce5eg55kgbec8ci89abfehbc
99ad6ccdakg895a9h787efg9ig 5eeg2eff5khdddaejdddfhfihi 6fdc7eh36jhbf98dk89cehefij 8c7b6afc7khaad96dab5dcfbbg
9abc6cfa8ki9a786ja76edagde 7bbd3ddd8fecbf9cgcbb4egkfd 8a897aba8fd9a989e877adbegg
""".split()
#: Ordinary order of classes (digit, lower, upper, mark), after each of them and at the start.
CLASS_STEP = np.array([[0.76, 0.062, 0.015, 0.163], [0.003, 0.892, 0.022, 0.083], [0.004, 0.15, 0.743, 0.103], [0.021, 0.722, 0.221, 0.036], [0.009, 0.503, 0.257, 0.231]])
MARK_SHARE = np.array([0.05, 0.2, 0.3, 0.45])
RUN_BYTES = np.isin(np.arange(256), list((UPPER + LOWER + DIGITS + "+/-_").encode()))
HEX_BYTES = np.isin(np.arange(256), list((DIGITS + LOWER[:6]).encode()))
SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value_start", T.IntegerType())])
)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _ordinary() -> tuple[np.ndarray, np.ndarray]:
    """Log chances of the first character, and of each character after each other, in ordinary text
    (characters as in SYMBOL). Every row is a distribution."""
    cost = np.array([[int(x, 36) for x in row] for row in LETTER_COST])
    letter = 2.0 ** (-cost / 2)
    letter /= letter.sum(1, keepdims=True)
    digit = np.full((11, 10), 0.1)
    digit[:10] = 0.065 + 0.25 * np.eye(10) + 0.1 * np.roll(np.eye(10), 1, 1)  # the same again, and the next
    kind = np.repeat([0, 1, 2, 3, 4], [10, 26, 26, 4, 1])
    at = np.concatenate([np.arange(10), np.arange(26), np.arange(26), np.arange(4), [0]])
    rows = []
    for c, i in zip(kind, at, strict=True):
        word = i if c in (1, 2) else 26
        new = 26 if c == 1 else word  # a capital after a small letter begins a word
        parts = [digit[i if c == 0 else 10], letter[word], letter[new], MARK_SHARE]
        rows.append(np.concatenate([share * part for share, part in zip(CLASS_STEP[c] / CLASS_STEP[c].sum(), parts, strict=True)]))
    logs = np.log(np.array(rows))
    return logs[:-1], logs[-1]


SYMBOL = np.zeros(256, np.intp)
SYMBOL[list((DIGITS + LOWER + UPPER + MARKS).encode())] = np.arange(66)
STEP_LOG, START_LOG = _ordinary()


def battery(run: str) -> tuple[str, float, float]:
    """(encoding, p-value of uniform randomness, p-value of ordinary text) of a run."""
    name, alphabet = next(((n, a) for n, a in ALPHABETS if set(run) <= set(a)), ALPHABETS[-1])
    n, k = len(run), len(alphabet)
    at = np.array([alphabet.find(c) for c in run])
    counts = np.bincount(at, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    p_chi = math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n) / math.sqrt(2)) / 2
    high = at >= k / 2
    ones = int(high.sum())
    zeros = n - ones
    if ones and zeros:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * ones * zeros / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = at - at.mean()
    p_serial = _two_sided(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n)) if d.any() else 0.0
    code = SYMBOL[np.frombuffer(run.encode(), np.uint8)]
    gain = -n * math.log(k) - float(START_LOG[code[0]] + STEP_LOG[code[:-1], code[1:]].sum())
    p_ordinary = min(1.0, len(ALPHABETS) * math.exp(-min(max(gain, 0.0), 700.0)))
    return name, min(1.0, 3 * min(p_chi, p_runs, p_serial)), p_ordinary


def discoveries(runs: list[str], rate: float = DISCOVERY_RATE) -> list[bool]:
    """Which runs of one document are secrets, by length-weighted Benjamini-Hochberg control."""
    found = [battery(r) for r in runs]
    mean = sum(map(len, runs)) / len(runs)
    weighted = [p / (len(r) / mean) for r, (_, _, p) in zip(runs, found, strict=True)]
    order = sorted(range(len(runs)), key=weighted.__getitem__)
    cut = max((k for k, i in enumerate(order, 1) if weighted[i] <= rate * k / len(runs)), default=0)
    taken = set(order[:cut])
    return [i in taken and found[i][1] >= REJECT_RANDOM for i in range(len(runs))]


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, member: np.ndarray, least: int):
    """Maximal runs of member bytes, cut at the documents' borders: (start, end) in data."""
    m = member[data]
    before, after = np.concatenate([[False], m[:-1]]), np.concatenate([m[1:], [False]])
    full = starts < ends
    before[starts[full]] = False
    after[ends[full] - 1] = False
    a, b = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    long = b - a >= least
    return a[long], b[long]


def scan(texts: pa.StringArray) -> list[list[tuple[str, int, int, int]]]:
    """Spans (kind, start, end, start of the value) of each text, by start and then kind."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    starts, ends = offsets[:-1], offsets[1:]
    raw = memoryview(data)
    by_doc: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for kind, member, least in (("hex", HEX_BYTES, 24), ("run", RUN_BYTES, MIN_RUN)):
        if len(data):
            a, b = _runs(data, starts, ends, member, least)
            for d, x, y in zip((np.searchsorted(offsets, a, side="right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
                by_doc.setdefault(d, {}).setdefault(kind, []).append((x, y))
    out = []
    for d, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        doc = bytes(raw[lo:hi])
        low = doc.lower()
        named, access = any(k in low for k in KEYWORDS), b"AKIA" in doc
        runs = by_doc.get(d, {})
        if not (named or access or runs):
            out.append([])
            continue
        text = doc.decode()
        spans = []
        if named:
            spans += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if access:
            spans += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if runs:
            # Characters begun before each byte: code points from byte offsets.
            chars = None if len(text) == len(doc) else np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
            point = (lambda x: x - lo) if chars is None else (lambda x: int(chars[x - lo]))
            spans += [("hex", point(x), point(y), point(x)) for x, y in runs.get("hex", [])]
            taken = [(s, e) for _, s, e, _ in spans]
            left = [(s, e) for x, y in runs.get("run", []) for s, e in [(point(x), point(y))] if not any(s < te and ts < e for ts, te in taken)]
            if left:
                keep = discoveries([text[s:e] for s, e in left])
                spans += [("random", s, e, s) for (s, e), k in zip(left, keep, strict=True) if k]
        out.append(sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))
    return out


def scan_one(text: str | None) -> list[tuple[str, int, int, int]]:
    return scan(pa.array([text], pa.string()))[0]


def find_secrets(df: DataFrame, text: str = "text", spans: str = "secrets", redacted: str | None = None) -> DataFrame:
    """df with an array of the spans found in its text; with redacted, also the text in which each
    secret value has become [REDACTED] (a null text stays null)."""
    keep = [f for f in df.schema.fields if f.name not in (spans, redacted)]
    names = [f.name for f in keep]
    fields = [*keep, T.StructField(spans, SPANS)] + ([T.StructField(redacted, T.StringType())] if redacted else [])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column(names.index(text))
                found = scan(column)
                rows = [[dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in f] for f in found]
                columns = [*part.columns, pa.array(rows, kind)]
                if redacted:
                    columns.append(pa.array([x and _redact(x, f) for x, f in zip(column.to_pylist(), found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType(fields))


def _redact(text: str, found: list[tuple[str, int, int, int]]) -> str:
    parts, at = [], 0
    for value, end in sorted((v, e) for _, _, e, v in found):
        if end > at:
            parts += [text[at : max(at, value)], "[REDACTED]" if value >= at else ""]
            at = end
    return "".join([*parts, text[at:]])

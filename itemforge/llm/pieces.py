"""SentencePiece encoding and decoding (operator 8) by a merge-type prefix table.

Every prefix of a text has one last token in its BPE encoding. An automaton over the pieces gives
the tokens that end at each position; the one whose left neighbour (the stored last token of the
shorter prefix) is compatible with it is stored. Two tokens are compatible when the merges that
made them would all have come before any merge across their border. Ids are then recovered
backwards from the table.

Pieces never hold a space mark after another character, nor a newline, so texts are cut there and
the ids of a chunk are kept and used again. Characters without a piece are spelled as bytes.

Null and empty texts have no ids and decode to an empty text. Repeated rows stay apart; an empty
table gives an empty result; columns other than those named are carried along unread, and input
columns with the results' names are replaced. Very long texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.llm.common import held, text_slices

MARK = "▁"
#: Bytes of chunks and their ids held by a worker before it starts anew, ENTRY a chunk included.
CACHE_BYTES = 64 << 20
ENTRY = 220
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PrefixTable:
    def __init__(self, model: str, cache_bytes: int = CACHE_BYTES):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only identity-normalised BPE models with a dummy prefix and byte fallback")
        self.piece = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        # Merges are tried by score, highest first; equal scores share a rank and go left to right.
        scores = sorted({-proto.pieces[i].score for i in self.ids.values()})
        rank = {s: k for k, s in enumerate(scores)}
        self.rank = {i: rank[-proto.pieces[i].score] for i in self.ids.values()}
        self.byte_ids = [self.piece.index(f"<0x{b:02X}>") for b in range(256)]
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        self.split: dict[int, tuple[int, int] | None] = {}
        for p, i in self.ids.items():
            final = self._final_merge(p)
            if final is not None or len(p) == 1:
                self.automaton.add_word(p, (len(p), i))
                self.split[i] = final
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_bytes, self.held = cache_bytes, 0
        # For decoding: the bytes of every id, one after the other.
        raw = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                raw.append(bytes([self.byte_ids.index(i)]))
            elif p.type == CONTROL:
                raw.append(b"")
            elif p.type == UNKNOWN:
                raw.append(proto.trainer_spec.unk_surface.encode() or " ⁇ ".encode())
            else:
                raw.append(p.piece.replace(MARK, " ").encode())
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([p.startswith(MARK) for p in self.piece])
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.is_empty = np.array([p.type == CONTROL for p in proto.pieces])

    def _final_merge(self, piece: str) -> tuple[int, int] | None:
        """The last merge by which the piece comes about; None if it never does."""
        parts = list(piece)
        if any(c not in self.ids for c in parts):
            return None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return None
            if len(parts) == 2:
                return self.ids[parts[0]], self.ids[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges at the border, latest first: none across it may have come earlier."""
        ids, piece, rank, split = self.ids, self.piece, self.rank, self.split
        limit = 1 << 60  # a merge across must rank below this to come first
        while True:
            across = ids.get(piece[left] + piece[right])
            if across is not None and rank[across] < limit:
                return False
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            # Of equal ranks the merge on the left comes first, so the right one is undone first.
            if b is not None and (a is None or rank[right] >= rank[left]):
                limit, right = rank[right] + 1, b[0]
            else:
                limit, left = rank[left], a[1]

    def _segment(self, s: str) -> list[int]:
        """Ids of a run of known characters."""
        last = [-1] * (len(s) + 1)
        for end, (size, token) in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end] = token
        out, at = [], len(s)
        while at:
            token = last[at]
            if token < 0:
                raise AssertionError(f"no last token for a prefix of {s!r}")
            out.append(token)
            at -= len(self.piece[token])
        return out[::-1]

    def _ids(self, s: str) -> bytes:
        out: list[int] = []
        if self.known.issuperset(s):
            out = self._segment(s)
        else:
            at = 0
            for k, c in enumerate(s):
                if c not in self.known:
                    out += self._segment(s[at:k]) if k > at else []
                    out += [self.byte_ids[b] for b in c.encode()]
                    at = k + 1
            out += self._segment(s[at:]) if at < len(s) else []
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cache, out = self.cache, []
        if len(self.pairs) * 100 > self.cache_bytes:
            self.pairs.clear()
        for t in texts:
            if self.held > self.cache_bytes:
                cache.clear()
                self.held = 0
            if not t:
                out.append(b"")
                continue
            if "  " in t or t[0] == " " or MARK in t:
                # Runs of space marks stay together. The keys can't be chunks: they hold a mark.
                parts = [x if x[0] == MARK else f"{MARK}\n{x}" for x in SEGMENT.findall(MARK + t.replace(" ", MARK))]
            else:
                parts = t.replace("\n", " \n").split(" ")
            try:
                out.append(b"".join(map(cache.__getitem__, parts)))
            except KeyError:
                for p in parts:
                    if p not in cache:
                        if p[:2] == MARK + "\n":
                            s = p[2:]
                        else:
                            s = p if p[:1] in ("\n", MARK) else MARK + p
                        x = cache[p] = self._ids(s) if s[0] != "\n" or len(s) == 1 else self._ids("\n") + self._ids(s[1:])
                        self.held += len(p) + len(x) + ENTRY
                out.append(b"".join(map(cache.__getitem__, parts)))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the documents that end at ends in ids."""
        size = self.size[ids]
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # The first token that makes text loses its leading space mark, as the dummy prefix.
        for k in np.flatnonzero((ends > first)):
            at = first[k]
            while at < ends[k] and self.is_empty[ids[at]]:
                at += 1
            first[k] = at
        has = first < ends
        strip = np.zeros(len(ids), bool)
        strip[first[has]] = self.marked[ids[first[has]]]
        start = self.start[ids] + strip
        size = size - strip
        stop = np.cumsum(size)
        out = self.raw[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        cuts = np.concatenate([[0], stop])[ends].tolist()
        texts, at = [], 0
        for cut in cuts:
            raw = out[at:cut]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = b"".join(_bad_bytes(raw))
            texts.append(raw)
            at = cut
        return texts


def _bad_bytes(raw: bytes) -> Iterator[bytes]:
    """Each byte that is part of no character becomes one replacement character."""
    at = 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            yield raw[at : at + n]
            break
        else:
            n = 1
            yield "�".encode()
        at += n


def prefix_table(model: str) -> PrefixTable:
    """One table for each Python worker and model."""
    return held(("prefix table", model), lambda: PrefixTable(model))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of its text (array<int>), and with decoded also the text that they spell.
    The text column itself is left out; all other columns stay."""
    keep = [c for c in df.columns if c not in (text, ids, decoded)]
    fields = [f for f in df.schema.fields if f.name in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model)
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                raw = t.encode([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                ends = np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                columns = part.columns[:-1]
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
                if decoded:
                    columns.append(pa.array([x.decode() for x in t.decode(flat, ends)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(text)).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its ids spell. Null ids spell an empty text."""
    fields = [f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())]
    names = [f.name for f in fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(names.index(ids)).to_pylist()]
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            texts = t.decode(np.concatenate([*lists, np.zeros(0, np.int64)]), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in texts], pa.string())], names=[*names, text])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType(fields))

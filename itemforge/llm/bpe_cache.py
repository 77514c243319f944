"""Exact encoding of whole texts with a byte-level BPE, re-using the ids of repeated chunks.

A text without doubled or exotic white space is cut before every single space and newline. The
pre-tokenizer's pattern starts a new piece at each of those cuts, so the ids of the text are the
ids of its chunks put together. Each distinct chunk of a batch is looked up once; a word of Latin
letters with marks behind it is two pieces, so the word and the marks are looked up apart. Those
not met before are put one after the other and encoded by the
library as one text; the widths of the ids tell where each ends. Words of Latin letters are
known to be one piece, so they pass the pattern by. Texts with other white space go to the library
as they are, and so do texts that hold an added token such as <|endoftext|>, unless those are to be
encoded as ordinary text.
"""

from __future__ import annotations

import os
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from itemforge.llm.common import held

#: Bytes of chunks and their ids held by a worker, about ENTRY a chunk included, and LONG_ENTRY more
#: where it is longer than KEY_BYTES. Beyond, only chunks that were met again stay, or only those of
#: the texts at hand.
CACHE_BYTES = 128 << 20
ENTRY, LONG_ENTRY = 48, 200
KEY_BYTES = 23
#: Chunks put together as one text for the library.
TOGETHER = 4096
NUL, EMPTY, SPACE = (pa.scalar(x, pa.large_string()) for x in ("\0", "", " "))
BARE = pa.array(["", "\n", "\0"], pa.large_string())
OTHER_SPACE = re.compile(r"[^\S \n]")
MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
#: Letters up to here are the same in every version of Unicode.
LAST_LETTER = 0x24F
LETTERS = "".join(filter(str.isalpha, map(chr, range(LAST_LETTER + 1))))
WORD = rf"\A[{LETTERS}]+\z"


def viewed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of large strings, without a copy."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, "<i8")[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start to start + size of each span, one after the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return at


def joined(strings: pa.Array, by: pa.Scalar) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(strings)], strings), by)[0].as_py()


class KnownChunks:
    """Ids of chunks, by row. Up to KEY_BYTES a chunk is its own key, three numbers, found by a hash of
    them among the sorted hashes and then compared; longer ones are kept in a dict."""

    def __init__(self, dtype: np.dtype):
        self.flat = np.zeros(0, dtype)
        self.keys = np.zeros((0, 3), "<u8")
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)  # a size of -1: not to be cut
        self.met = np.zeros(0, bool)  # again, since the last trim
        self.hashes, self.rows = np.zeros(0, "<u8"), np.zeros(0, np.int32)
        self.long: dict[str, int] = {}
        self.long_bytes = 0

    @property
    def held(self) -> int:
        return self.flat.nbytes + ENTRY * len(self.start) + self.long_bytes

    @staticmethod
    def keyed(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, hashes, whether the chunk is too long for a key)."""
        data, offsets = viewed(chunks)
        data = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(24, np.uint8)])
        at, size = offsets[:-1] - offsets[0], np.diff(offsets)
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
        keys = np.stack([eight[at + k] & masks[np.clip(size - k, 0, 8)] for k in (0, 8, 16)], axis=1)
        keys[:, 2] |= size.astype("<u8") << np.uint64(56)
        h = np.zeros(len(keys), "<u8")
        for k in range(3):
            h = (h + keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return keys, h, size > KEY_BYTES

    def find(self, chunks: pa.Array, keys: np.ndarray, hashes: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The row of each chunk, -1 if it isn't known."""
        rows = np.full(len(chunks), -1, np.int32)
        if len(self.hashes):
            order = np.argsort(hashes)
            at = np.empty(len(order), np.int64)
            at[order] = np.searchsorted(self.hashes, hashes[order])
            at[at == len(self.hashes)] = 0
            row = self.rows[at]
            equal = self.keys[row] == keys
            same = (self.hashes[at] == hashes) & equal[:, 0] & equal[:, 1] & equal[:, 2] & ~long
            rows[same] = row[same]
        which = np.flatnonzero(long)
        if len(which):
            rows[which] = [self.long.get(c, -1) for c in chunks.take(pa.array(which)).to_pylist()]
        self.met[rows[rows >= 0]] = True
        return rows

    def add(self, chunks: pa.Array, keys: np.ndarray, hashes: np.ndarray, long: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of new chunks, whose ids are the spans of ids. One whose hash another chunk has may
        not be found again; it is then learnt again."""
        rows = np.arange(len(self.start), len(self.start) + len(chunks), dtype=np.int32)
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(chunks), bool)])
        self.flat = np.concatenate([self.flat, ids])
        self.keys = np.concatenate([self.keys, keys])
        self._index(keys, hashes, rows, long)
        for c, r in zip(chunks.filter(pa.array(long)).to_pylist(), rows[long].tolist(), strict=True):
            self.long[c] = r
            self.long_bytes += LONG_ENTRY + len(c)
        return rows

    def _index(self, keys: np.ndarray, hashes: np.ndarray, rows: np.ndarray, long: np.ndarray) -> None:
        hashes, rows = hashes[~long], rows[~long]
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.rows = np.insert(self.hashes, at, hashes[order]), np.insert(self.rows, at, rows[order])

    def trim(self, rows: np.ndarray) -> np.ndarray:
        """Forget the chunks that weren't met again; where most were, all but those of rows. Returns
        what the rows, -1 left out, are called then."""
        if 2 * self.met.sum() > len(self.met):
            self.met[:] = False
            self.met[rows[rows >= 0]] = True
        stay = np.flatnonzero(self.met)
        new = np.full(len(self.start) + 1, -1, np.int32)
        new[stay] = np.arange(len(stay))
        kept = new[self.rows] >= 0
        self.hashes, self.rows = self.hashes[kept], new[self.rows[kept]]
        self.long = {c: int(new[r]) for c, r in self.long.items() if new[r] >= 0}
        self.long_bytes = sum(map(len, self.long)) + LONG_ENTRY * len(self.long)
        size = np.maximum(self.size[stay], 0).astype(np.int64)
        self.flat = self.flat[spans(self.start[stay], size)]
        self.keys, self.start, self.size = self.keys[stay], np.cumsum(size) - size, self.size[stay]
        self.met = np.zeros(len(stay), bool)
        return new[rows]


class ChunkedEncoder:
    """encode(texts) gives the ids of the texts as numbers of `dtype`, equal to the library's own with
    encode_special_tokens set to `special_as_text` (its default is False)."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts of the tokens that the library cuts out before any pre-tokenizing.
        self.added = tuple(t.content for t in added if not (special_as_text and t.special))
        self.cache_bytes = cache_bytes
        # For words known to be one piece each: the same model, which only cuts at a mark. The
        # vocabulary's spelling of bytes is taken from the library.
        self.pieces = Tokenizer.from_file(path)
        letters = " " + LETTERS
        spelled = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letters))
        self.spelling = np.arange(256, dtype="<u4")
        self.spelling[list(letters.encode())] = list(map(ord, spelled))
        self.pieces.pre_tokenizer = CharDelimiterSplit("\x01")
        for t in (self.tokenizer, self.pieces):
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # ours is larger and shared by all texts
        # Bytes of text behind each id: every byte is one character in the vocabulary's spelling.
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.known = KnownChunks(self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, part: pa.Array, space: np.ndarray, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ids of each chunk of part, of the ids of all of them one after the other.
        space: one before the chunk; skip: ids in front that aren't the chunk's."""
        cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(np.diff(viewed(part)[1]) + space), side="left") + 1
        starts = np.concatenate([[0], cuts[:-1]]) + skip
        return starts, cuts - starts

    def _words(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of words of letters, each with a space before it. Every one is a piece of
        its own, so they are spelled here and only cut at a mark by the library."""
        raw = (" " + joined(part, pa.scalar("\x01 ", pa.large_string()))).encode()
        spelled = self.spelling[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.pieces.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.dtype)
        return ids, *self._cut(part, np.ones(len(part), bool), np.zeros(len(part), bool), ids)

    def _others(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # A first chunk stands after a newline here, which is a piece of its own and one id.
        ids = self._library([(" " + joined(part, SPACE)).replace(" \n", "\n").replace(" \0", "\n")])[0]
        data, offsets = viewed(part)
        head = data[offsets[:-1]]
        return ids, *self._cut(part, (head != 0) & (head != 10), head == 0, ids)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of chunks, which stand without their space; a text's first chunk, which has
        none, begins with NUL. Chunks with or beside other white space, for which the cut rule doesn't
        hold, have the size -1."""
        bad = pc.is_in(new, value_set=BARE).to_numpy(zero_copy_only=False)
        if OTHER_SPACE.search(joined(new, SPACE)):
            bad = bad | np.array([bool(OTHER_SPACE.search(c)) for c in new.to_pylist()])
        plain = pc.match_substring_regex(new, WORD).to_numpy(zero_copy_only=False)
        start, size = np.zeros(len(new), np.int64), np.full(len(new), -1, np.int64)
        found, n = [np.zeros(0, self.dtype)], 0
        for which, encode in ((plain, self._words), (~plain & ~bad, self._others)):
            which = np.flatnonzero(which)
            for at in range(0, len(which), TOGETHER):
                few = which[at : at + TOGETHER]
                ids, starts, size[few] = encode(new.take(pa.array(few)))
                start[few] = starts + n
                found.append(ids)
                n += len(ids)
        return np.concatenate(found), start, size

    def _rows(self, units: pa.Array) -> np.ndarray:
        """The row of each of the distinct units in the known chunks; new ones are learnt."""
        key = self.known.keyed(units)
        rows = self.known.find(units, *key)
        if self.known.held > self.cache_bytes:
            rows = self.known.trim(rows)
        new = np.flatnonzero(rows < 0)
        if len(new):
            chunks = units.take(pa.array(new))
            rows[new] = self.known.add(chunks, *(k[new] for k in key), *self._learn(chunks))
        return rows

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all distinct chunks one after the other, number of ids of each, whether it can't be cut)."""
        word = pc.utf8_rtrim(chunks, MARKS)
        plain = pc.match_substring_regex(word, WORD)
        data, offsets = viewed(chunks)
        full, upto = np.diff(offsets), np.diff(viewed(word)[1])
        # Letters and then marks are two pieces, and many marks follow the same letters. Marks are
        # written as a text's first chunk, which has no space before it.
        tailed = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (upto < full))
        size = (full - upto)[tailed]
        tails = data[spans(offsets[:-1][tailed] + upto[tailed], size)]
        tails = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype("<i8")), pa.py_buffer(tails))
        units = pa.concat_arrays([pc.if_else(plain, word, chunks), pc.binary_join_element_wise(NUL, tails, EMPTY)]).dictionary_encode()
        row = self._rows(units.dictionary)[units.indices.to_numpy()]
        n = len(chunks)
        starts, sizes = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        for k, (which, rows) in enumerate(((slice(None), row[:n]), (tailed, row[n:]))):
            starts[which, k], sizes[which, k] = self.known.start[rows], self.known.size[rows]
        bad = sizes[:, 0] < 0
        sizes[bad] = 0
        return self.known.flat[spans(starts.ravel(), sizes.ravel())], sizes.sum(axis=1), bad

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each). Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        # A NUL in the text would look like the mark of a first chunk.
        data, offsets = viewed(texts)
        raw = data[offsets[0] : offsets[-1]].tobytes()
        apart = [x for x in ("\0", *self.added) if x.encode() in raw]
        cut = pc.if_else(reduce(pc.or_, (pc.match_substring(texts, x) for x in apart)), EMPTY, texts) if apart else texts
        chunks = pc.split_pattern(pc.binary_join_element_wise(NUL, pc.replace_substring(cut, "\n", " \n"), EMPTY), " ")
        first = chunks.offsets.to_numpy()[:-1] - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, size, bad = self._chunks(coded.dictionary)
        each = size[codes]
        ids = flat[spans((np.cumsum(size) - size)[codes], each)]
        sizes = np.add.reduceat(each, first)
        if bad.any():  # chunks that can't be cut: their texts go to the library whole
            rest = np.flatnonzero(np.logical_or.reduceat(bad[codes], first))
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k, x in zip(rest.tolist(), self._library(texts.take(pa.array(rest)).to_pylist()), strict=True):
                parts[k] = x
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, sizes


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The ids with the id end after those of each text."""
    out = np.empty(len(ids) + len(sizes), ids.dtype)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes + 1) - 1] = False
    out[own], out[~own] = ids, end
    return out


def encoder(path: str, special_as_text: bool = True, cache_bytes: int = CACHE_BYTES) -> ChunkedEncoder:
    """One encoder for each Python worker, vocabulary, treatment of added tokens and size of its cache."""
    return held(("chunks", path, special_as_text, cache_bytes), lambda: ChunkedEncoder(path, cache_bytes, special_as_text))

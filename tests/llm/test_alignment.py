import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemforge.llm import alignment, queries
from itemforge.scratch import materialize

VOCAB, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoded():
    a = Tokenizer.from_file(VOCAB)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    # The byte-level spelling: printable bytes are themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def both(text):
        want = (" " + text).encode()
        x = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (x, y) if text and b"".join(r for _, r in x) == want == b"".join(r for _, r in y) else ([], [])

    return both


def brute(rows, both):
    docs, pairs = [], Counter()
    for i, text in rows:
        sides = []
        for tokens in both(text or ""):
            at, spans = 0, []
            for t, raw in tokens:
                spans.append((at, at + len(raw), t))
                at += len(raw)
            sides.append(spans)
        a, b = sides
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else _walk(a, b)
        pairs.update(links)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for s, e, t in side if start < e <= cut) for side in sides) if len(a) < 3000 else None)
            start = cut
        docs.append((i, a, b, links, groups))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = []
    for i, a, b, links, groups in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else ("" if not groups else None)
        out.append((i, len(a), len(b), len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), digest))
    return out


def _walk(a, b):
    links, j = [], 0
    for x in a:
        while b[j][1] <= x[0]:
            j += 1
        k = j
        while k < len(b) and b[k][0] < x[1]:
            links.append((x[2], b[k][2]))
            k += 1
    return links


def noise(n, seed):
    rng = random.Random(seed)
    marks = [*" \n\t\0ab'sé1,.<|▁漢\x1c\x85\xa0", "<|endoftext|>", " the", "'ll", "  ", " " * 17, "<0x0A>", "</s>", "=", "🙂", "\r\n"]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize(("block", "shard", "pairs"), [(16 << 20, 1 << 17, 1 << 20), (3000, 100, 0)])
def test_alignment_is_brute_force(spark, odd, documents, encoded, monkeypatch, block, shard, pairs):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SHARD_CHUNKS", shard)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate([*noise(400, 4), "a" * 5000, "=" * 700, "漢" * 300])], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(documents.limit(40).select("doc_id", "text")).union(more)
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(map(repr, brute(rows, encoded)))
    got = alignment.alignments(docs.repartition(3), VOCAB, MODEL)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    got = [tuple(r) for r in got.select("doc_id", *alignment.FIGURES, digest).collect()]
    long = {w[: w.rindex(",")] for w in want if w.endswith("None)")}  # their groups aren't spelled out above
    shown = sorted(repr(r) for r in got if repr(r)[: repr(r).rindex(",")] not in long)
    assert shown == sorted(w for w in want if not w.endswith("None)")) and len(got) == len(want)


def test_query(spark, sf, documents, encoded):
    got = queries.op13_tokenizer_alignment(spark, sf)
    assert got.columns == ["doc_id", *alignment.FIGURES, "groups_sha256"]
    want = brute([(r.doc_id, r.text) for r in documents.collect()], encoded)
    by_id = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(by_id) == len(want) == documents.count()
    for w in want:
        assert by_id[w[0]][: 7 if w[7] is None else 8] == w[: 7 if w[7] is None else 8]


def test_operator_on_units_without_cuts(spark):
    """Tokens that end together only at the end of a long unit still give a link a pair, no more."""
    rows = [(1, 1 << 40, [7] * 5001, [2] * 5001, [9] * 5002, [1, *[2] * 5000, 1]), (2, 5, [1], [3], [2, 3], [1, 2])]
    units = spark.createDataFrame(rows, "unit long, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>")
    found = {r.unit: r for r in alignment.align(units).collect()}
    assert Counter(found[1].links) == {7 << 32 | 9: 10002} and tuple(found[1])[1:5] == (1 << 40, 5001, 5002, 1)
    assert found[1].groups == ",".join(["7"] * 5001) + "|" + ",".join(["9"] * 5002)
    assert tuple(found[2])[1:] == (5, 1, 2, 1, "1|2,3", [1 << 32 | 2, 1 << 32 | 3])


def test_empty_tables(spark, odd):
    docs = odd.select("doc_id", "text")
    assert alignment.alignments(docs.limit(0), VOCAB, MODEL).count() == 0
    got = alignment.alignments(docs.where("text is null or text = '' or doc_id = 8"), VOCAB, MODEL).collect()
    assert len(got) == 3 and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")}


def test_texts_and_tokens_of_chunks_are_dropped_once_aligned(spark, odd, monkeypatch):
    made = []
    monkeypatch.setattr(alignment, "materialize", lambda *args: made.append(materialize(*args)) or made[-1])
    got = alignment.alignments(odd.select("doc_id", "text"), VOCAB, MODEL)
    left = [t for t in made if os.path.exists(t._itemforge_path.removeprefix("file://"))]
    assert len(left) < len(made) and not {"chunks", "a", "b"} & {c for t in left for c in t.columns}
    assert got.count() == odd.count()

import hashlib
import random
import re
import string
import zlib

import numpy as np
from pyspark.sql import functions as F

from itemforge.llm import language, quality, queries, secrets


def test_language_held_out(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97


def test_language_odd_rows(documents, odd):
    model = language.train(documents)
    rows = {(r.doc_id, r.source): r for r in language.identify(odd, model).collect()}
    assert len(rows) == odd.count() - 1
    for doc in (2, 3, 4, 7):
        r = next(v for (i, _), v in rows.items() if i == doc)
        assert (r.lang_pred, r.score, r.lang_spans) == ("und", 0.0, [])
    none = language.train(documents.limit(0))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_every_letter_has_its_class(spark, documents):
    from itemforge.llm import codepoints

    assert max(k for k in range(0x110000) if chr(k).isalpha() or chr(k).isdigit() or chr(k).isspace()) < codepoints.TABLE
    df = spark.createDataFrame([(1, chr(0x30000) * 5)], "doc_id long, text string")
    row = language.identify(df, language.train(documents)).first()
    assert row.lang_pred != "und" and row.score > 0


def test_language_spans(spark, documents):
    model = language.train(documents)
    texts = {r.lang: r.text for r in documents.where("length(text) between 300 and 900").dropDuplicates(["lang"]).collect()}
    mixed = texts["en"] + "\n" + texts["de"] + "\n" + texts["en"]
    df = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    spans = language.identify(df, model).first().lang_spans
    assert [s.lang for s in spans if s.end - s.start > 60] == ["en", "de", "en"]


def test_viterbi_brute_force():
    rng = np.random.default_rng(4)
    counts = np.array([0, 5, 1, 6, 3, 0])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32) * 3
    got = language.viterbi(scores, counts, 2.0)
    at = 0
    for n in counts:
        part = scores[at : at + n].astype(float)
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.zeros((1, 0), int)
        value = lambda p: sum(part[k, p[k]] for k in range(n)) - 2.0 * sum(p[1:] != p[:-1])  # noqa: E731, B023
        assert n == 0 or np.isclose(value(got[at : at + n]), max(map(value, paths)))
        at += n


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(text):
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda x: (x[1].start(), order.index(x[0]))))


def noisy_secrets(n, seed):
    rng = random.Random(seed)
    bits = ["token", "API_KEY", "ſecret", "Secret", "passwd", '"', "'", " ", "  ", ":", "=", "é", "AKIA", "\n", "漢", "K"]
    def run():
        return "".join(rng.choice(rng.choice(["0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits])) for _ in range(rng.choice([3, 6, 16, 20, 24, 40])))
    return ["".join(rng.choice([*bits, run()]) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_secret_base_spans(spark, odd, documents):
    texts = [(k, t) for k, t in enumerate([*noisy_secrets(1500, 3), None, "", "a" * 100_000 + "f" * 30])]
    df = spark.createDataFrame(texts, "doc_id long, text string").union(documents.select(F.col("doc_id") + 100_000, "text"))
    for r in secrets.find_secrets(df).collect():
        spans = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind != "random")
        assert spans == base_spans(r.text or "")
    assert secrets.find_secrets(odd).count() == odd.count()


def test_secret_query(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, sf).collect()}
    for r in documents.collect():
        base = base_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [base.count(k + ":") for k in ("assign", "access", "hex")]


def test_randomness_battery():
    rng = random.Random(6)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(200)]
    words = ["thisIsAnOrdinaryCamelCaseIdentifierName", "internationalizationandlocalization", "AVERYLONGCONSTANTNAMEINCAPITALS", "a" * 40, "abcd1234" * 6, "00000000000000000001"]
    assert np.mean([secrets.discoveries([k])[0] for k in keys]) > 0.9
    assert not any(secrets.discoveries(words))


def test_random_keys_of_every_alphabet():
    rng = random.Random(8)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    words = ["thisIsAnOrdinaryCamelCaseIdentifierName", "internationalizationandlocalization", "AVERYLONGCONSTANTNAMEINCAPITALS", "a_test_of_the_ordinary_function_names", "docs/guide/getting-started/index"]
    for alphabet in (digits, digits + low[:6], low, up, up + "234567", digits + low, low + up, low + up + digits, low + up + digits + "+/"):
        for n in (20, 32, 64, 128):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(60)]
            assert np.mean([secrets.discoveries([k])[0] for k in keys]) > 0.9, (alphabet, n)
            found = [secrets.discoveries([k, *words]) for k in keys]
            assert np.mean([f[0] for f in found]) > 0.75 and not any(any(f[1:]) for f in found), (alphabet, n)


def test_ordinary_likelihood_is_a_distribution():
    assert np.allclose(np.exp(secrets.STEP_LOG).sum(1), 1) and np.isclose(np.exp(secrets.START_LOG).sum(), 1)


def test_redaction(spark):
    text = "x token = \"0123456789abcdef0123456789abcdef\" y"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.redacted for r in secrets.find_secrets(df, redacted="redacted").collect()}
    assert got == {1: 'x token = "[REDACTED]" y', 2: "plain", 3: None}


def test_forward_backward_brute_force():
    rng = np.random.default_rng(7)
    counts, moves = np.array([3, 1, 0, 4]), rng.normal(size=(2, 2))
    emit = rng.normal(size=counts.sum())
    p, pairs = quality.forward_backward(emit, counts, moves)
    want, both, at = [], np.zeros((2, 2)), 0
    for n in counts:
        paths = np.array(np.meshgrid(*[range(2)] * n)).reshape(n, -1).T if n else np.zeros((1, 0), int)
        w = np.array([np.exp(sum(emit[at + k] * s[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(s[:-1], s[1:]))) for s in paths])
        w /= w.sum()
        want += [(w * paths[:, k]).sum() for k in range(n)]
        for s, x in zip(paths, w, strict=True):
            for a, b in zip(s[:-1], s[1:]):
                both[a, b] += x
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95


def test_quality_odd_rows(spark, odd, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels)
    rows = quality.score(odd, model, lines=True).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id[1].line_scores) == 2 and by_id[2].score == by_id[3].score
    none = quality.train(documents, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0


def test_secret_query_spans(spark, tmp_path):
    """Kinds, counts and joined spans of the query against the scan of each text on its own, over
    planted keys of several alphabets and noise."""
    rng = random.Random(6)
    alphabets = [string.digits, "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits]
    keys = ["an ordinary text with the key " + "".join(rng.choice(a) for _ in range(40)) + " in it" for a in alphabets for _ in range(20)]
    texts = dict(enumerate([*keys, *noisy_secrets(200, 8), None, "", "plain words only, and some_longer_identifier_of_code in them"]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.n_random, r.base_sha256, r.spans) for r in queries.op3_secret_scan(spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        found = secrets.scan_one(text)
        base = base_spans(text or "")
        assert ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found if k != "random") == base
        counts = tuple(sum(x[0] == k for x in found) for k in secrets.KINDS)
        assert got[i] == (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
    # Decimal keys are hex spans already; the method finds the others.
    assert all(got[i][2:4] == (1, 0) for i in range(20))
    assert sum(got[i][2:4] == (0, 1) for i in range(20, len(keys))) >= 0.95 * (len(keys) - 20)
    assert got[len(texts) - 1][:4] == (0, 0, 0, 0)

import random
import re

from pyspark.sql import functions as F

from itemforge.functions import labels as lab
from itemforge.functions import markup as mk
from itemforge.functions import text as tx


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v")).alias("x")).collect()]


def test_markup_golden(spark):
    cases = {
        "235 92 U": r"${}^{235}_{92}\text{U}$", "1 √ LC": r"$\frac{1}{\sqrt{LC}}$", "V0 √ 2": r"$\frac{V_0}{\sqrt{2}}$", "XL": "$X_{L}$",
        "3 × 108 m/s": r"$3 \times 10^{8}$ m/s", "π 3": r"$\frac{\pi}{3}$", "2π 3": r"$\frac{2\pi}{3}$", "α β": r"$\alpha \beta$",
        "αβ": r"$\alpha\beta$", "ω0": r"$\omega^0$", "∑": r"$\su_m$", "30°": r"30^$\circ$", "": "",
    }
    assert column(spark, [*cases, None], mk.markup) == [*cases.values(), None]
    assert column(spark, ["∑", "Vm √ 2"], lambda c: mk.markup(c, faithful=False)) == [r"$\sum$", r"$\frac{V_m}{\sqrt{2}}$"]


def test_entries_of_the_fixed_tables(spark):
    """Entries of each table, spelled here and not taken from the code."""
    cases = {
        "14 6 C": r"${}^{14}_{6}\text{C}$", "23 11 Na": r"${}^{23}_{11}\text{Na}$", "2 1 X": "2 1 X",
        "θ ε µ λ": r"$\theta \varepsilon \mu \lambda$", "a ≥ b": r"a $\geq$ b", "a ∝ b": r"a $\propto$ b", "A → B": r"A $\rightarrow$ B", "5 − 3": "5 - 3",
        r"\nabla x": r"$\nabla$ x", r"\cdot": r"$\cdot$", r"\partial t": r"$\partial$ t", r"\unknown": r"\unknown", "VC L2 n1": "$V_{C} L_2 n_1$", "10-7": "$10^{-7}$",
    }
    assert column(spark, [*cases], mk.markup) == [*cases.values()]
    page = "x\nPrevious Year Questions • Free download at collegedunia.com \nPage 12 y\nz"
    assert column(spark, [page], tx.clean_pages) == ["x\n y\nz"]


def test_segments_lose_nothing(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab$ \n\\") for _ in range(rng.randrange(0, 14))) for _ in range(800)]
    for text, got in zip(texts, column(spark, texts, tx.segments), strict=True):
        assert "".join(got) == text
        assert got == [p for p in re.split(r"(\$[^$]+?\$)", text) if p]


def test_text_functions(spark):
    assert column(spark, ["What's  the E-field?"], tx.normalize) == ["what s the e field"]
    assert column(spark, ["A, B/C"], tx.slug) == ["a-b-c"]
    assert column(spark, ["  a  \n b \t", None], tx.collapse) == ["a b", None]
    assert column(spark, ["50% off", "50 off"], lambda c: tx.contains_ci(c, "50% O")) == [True, False]
    page = "Collegedunia | Class 12 Physics \nChapter 3\nBody\n\n\n\nMore\nPage 7\nEnd"
    assert column(spark, [page], tx.clean_pages) == ["Body\n\nMore\nEnd"]


def test_labels(spark):
    assert column(spark, [None, "", "Refer to the official CBSE paper", "x"], lab.has_answer) == [False, False, False, True]
    assert column(spark, [100, 51, 50, 0], lab.progress_band, "long") == ["green", "blue", "amber", "gray"]
    pairs = spark.createDataFrame([(29, 200), (1, 8), (0, 0)], "a long, b long")
    assert [r[0] for r in pairs.select(lab.percent(F.col("a"), F.col("b"))).collect()] == [14, 13, 0]
    files = ["class-12-physics-atoms-pyq-1779702121", "class-12-physics-new-topic-pyq-1779702122", "class-12-physics-o'hare-3d-pyq-1779702129"]
    assert column(spark, files, lab.chapter_of_file) == ["Atoms", "New Topic", "O'Hare 3D Pyq 1779702129"]
    assert column(spark, ["Atoms", "Other"], lab.chapter_icon) == ["🔬", "📚"]


def test_display(spark):
    assert column(spark, ["→E and →"], mk.residual_symbols) == [r"$\vec{E}$ and $\rightarrow$"]
    assert column(spark, ["$a$ $b$"], mk.merge_blocks) == ["$a b$"]
    assert column(spark, ["$$x$$ y\nz"], mk.display_math) == [["x"]]


def test_symbols_and_roots_in_one_pass(spark):
    pairs = {"√": mk.ROOT, **{k: "\\" + v for k, v in mk.GREEK.items()}, **mk.SIGNS}
    texts = [None, "", "√", "aα\n×\x01β−", "日本 ℵ𝛼 °°C ñ±²³", "x" + "".join(pairs) + "y", " ".join(pairs)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", mk.commands_for_symbols(F.col("x")).alias("y"))
    for x, y in df.collect():
        assert y == (x and "".join(pairs.get(c, c) for c in x))
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()  # one pass a symbol before
    assert all(re.match(mk.SYMBOL_AT, c) for c in pairs)

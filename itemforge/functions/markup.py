"""Plain notation to delimited math markup. The order of the steps and their patterns are fixed
values: each step may make new math blocks, so each tokenises again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.text import control_clean, map_segments, map_spans, rx, template, where_found

# Element symbols, two letters before one.
ELEMENTS = (
    "He Li Be Ne Na Mg Al Si Cl Ar Ca Sc Ti Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te "
    "Xe Cs Ba La Ce Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa Np Pu Am Cm "
    "H B C N O F P S K V W U Y I"
).split()
# Greek letters by command.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "Γ": "Gamma", "δ": "delta", "Δ": "Delta", "ε": "varepsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "Θ": "Theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "Λ": "Lambda", "μ": "mu", "µ": "mu", "ν": "nu", "ξ": "xi",
    "Ξ": "Xi", "π": "pi", "Π": "Pi", "ρ": "rho", "σ": "sigma", "Σ": "Sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "Φ": "Phi",
    "χ": "chi", "ψ": "psi", "Ψ": "Psi", "ω": "omega", "Ω": "Omega",
}
# Operators and signs.
SIGNS = {
    "×": r"\times", "÷": r"\div", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∝": r"\propto", "∞": r"\infty",
    "∫": r"\int", "∑": r"\sum", "∂": r"\partial", "∇": r"\nabla", "→": r"\rightarrow", "←": r"\leftarrow", "⇒": r"\Rightarrow",
    "°": r"^\circ", "−": "-",
}
# Characters that are none, by few ranges that Java checks fast; a few others are told by lookup.
NO_SYMBOL = r"\x00-¯¶-ÖØ-öø-ΐϊ-↏"
SYMBOL_AT = f"[^{NO_SYMBOL}]"
# Commands that get their own block when bare.
COMMANDS = (
    "alpha beta gamma delta varepsilon epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega times div leq geq neq approx propto rightarrow leftarrow Rightarrow "
    "infty pm mp cdot partial nabla sin cos tan log ln exp int sum sqrt frac circ text"
).split()
ROOT = "__SQRT__"
NUMBER = r"(\d+(?:\.\d+)?)"
NAME = r"([A-Za-z][A-Za-z0-9]*)"
FRACTION_ROOT = r"$\frac{<1>}{\sqrt{<2>}}$"


def chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, text in rules:
        c = rx(c, pattern, template(text))
    return c


def nuclear(c: Column) -> Column:
    return chain(c, [(r"\b(\d{1,3})\s+(\d{1,2})\s+(" + "|".join(ELEMENTS) + r")\b", r"${}^{<1>}_{<2>}\text{<3>}$")])


def commands_for_symbols(c: Column) -> Column:
    """One pass cuts the text at characters that may be symbols; only these are looked up."""
    texts = F.create_map(*(F.lit(x) for k, v in {"√": ROOT, **{k: "\\" + v for k, v in GREEK.items()}, **SIGNS}.items() for x in (k, v)))
    pieces = F.regexp_extract_all(c, F.lit(r"[\x00-\u00AF\u00B6-\u00D6\u00D8-\u00F6\u00F8-\u0390\u03CA-\u218F]++|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) == 1, F.coalesce(F.try_element_at(texts, p), p)).otherwise(p)), "")


def roots(c: Column) -> Column:
    """Texts without a root stay as they are."""
    return where_found(c, ROOT, _roots)


def _roots(c: Column) -> Column:
    c = chain(
        c,
        [
            (rf"(?<![A-Za-z_$]){NUMBER}\s+{ROOT}\s+{NUMBER}(?!\d)", FRACTION_ROOT),
            (rf"(?<![A-Za-z_$]){NUMBER}\s+{ROOT}\s+{NAME}", FRACTION_ROOT),
            (rf"([A-Za-z]\w*)\s+{ROOT}\s+{NUMBER}", FRACTION_ROOT),
            (rf"{ROOT}\s*{NUMBER}", r"$\sqrt{<1>}$"),
            (rf"{ROOT}\s*{NAME}", r"$\sqrt{<1>}$"),
        ],
    )
    return F.replace(c, F.lit(ROOT), F.lit(r"$\sqrt{\cdot}$"))


def subscripts(c: Column) -> Column:
    return chain(
        c,
        [
            (r"\bX([LCR])\b", "$X_{<1>}$"),
            (r"\bV([LCR])\b", "$V_{<1>}$"),
            (r"\b([VIEvBbi])0\b", "$<1>_0$"),
            (r"\b([VIEvi])m\b", "$<1>_m$"),
            (r"\b([CLRilrn])([12345])\b", "$<1>_<2>$"),
        ],
    )


def powers_of_ten(c: Column) -> Column:
    return chain(
        c,
        [
            (rf"{NUMBER}\s*\\times\s*10\s*\^?\s*\{{?(-?\d+)\}}?", r"$<1> \times 10^{<2>}$"),
            (r"\b10-(\d+)\b", "$10^{-<1>}$"),
            (r"10\^?\{?(\d+)\}?\s+(\d*)\\pi", r"$\frac{10^{<1>}}{<2>\pi}$"),
        ],
    )


def wrap_commands(c: Column) -> Column:
    return chain(c, [(r"(\\(?:" + "|".join(COMMANDS) + r")(?:\{[^}]*\})*)", "$<1>$")])


def denominators(c: Column) -> Column:
    return chain(c, [(r"\$([^$]+)\$ (\d)(?=[\s,)(.\n]|$)", r"$\frac{<1>}{<2>}$")])


def pi_fractions(c: Column) -> Column:
    ahead = r"(?=[\s,)(.;:]|$)"
    return chain(
        c,
        [
            (r"(\d)\s*\$\\pi\$ (\d+)" + ahead, r"$\frac{<1>\pi}{<2>}$"),
            (r"\$\\pi\$ (\d+)" + ahead, r"$\frac{\pi}{<1>}$"),
            (r"\$([^$]+)\$ \$\\pi\$" + ahead, r"$\frac{<1>}{\pi}$"),
            (r"(\d)\$\\frac\{\\pi\}\{(\d+)\}\$", r"$\frac{<1>\pi}{<2>}$"),
        ],
    )


def omega_powers(c: Column) -> Column:
    """The digit after omega becomes a power, 0 included (a rule for 0 alone could never apply)."""
    return chain(c, [(r"\$\\omega\$(\d)", r"$\omega^<1>$")])


def empty_roots(c: Column) -> Column:
    empty = r"\$\\sqrt\{\}?\$"
    return chain(
        c,
        [
            (rf"(\d+) {empty}\s*{NAME}", FRACTION_ROOT),
            (rf"{empty} {NAME}", r"$\sqrt{<1>}$"),
            (r"\$\\sqrt\{\}\$", r"$\sqrt{\cdot}$"),
        ],
    )


def inner_subscripts(c: Column, faithful: bool = True) -> Column:
    """Inside math blocks. Faithful also splits commands that end in m (\\sum to \\su_m)."""
    guard = "" if faithful else r"(?<!\\[A-Za-z]{0,12})"
    return map_segments(c, lambda s: chain(s, [(r"([A-Za-z])0\b", "<1>_0"), (guard + r"([A-Za-z])m\b", "<1>_m")]), math=True)


def fuse(c: Column) -> Column:
    """Drops $$ and turns "$ $" into a space, which also fuses neighbouring blocks."""
    return F.replace(F.replace(c, F.lit("$$"), F.lit("")), F.lit("$ $"), F.lit(" "))


# What has to occur in a text for a step to change anything in it.
NUCLEAR_AT = r"\d\s+\d{1,2}\s+[A-Z]"
SUBSCRIPT_AT = r"\b(?:[XV][LCR]|[VIEvBbi]0|[VIEvi]m|[CLRilrn][1-5])\b"
POWER_AT = r"\\times|\b10-\d|\\pi"
ANY_AT = "|".join([NUCLEAR_AT, SYMBOL_AT, ROOT, SUBSCRIPT_AT, POWER_AT, r"[\\$]"])

# Neighbourhoods. A word is hot if it holds a character that some pattern names (HOT) or is a letter pair
# that is a subscript. No pattern reaches over white space with other characters on both sides, and only
# hot words, the word before one that begins hot, and the word after one that ends hot, become
# blocks, which fuse over a space. So a neighbourhood is hot words with those, and with neighbours that
# could be blocks. Braces may hold anything: from one on the text stays together. Dollars in the text
# pair over any distance: then all from the first hot word on stays together.
# Words are told by ranges that Java checks fast: plain characters are ASCII but digits and the marks that
# patterns name, Latin, Cyrillic and Hebrew letters, and dashes and quotes. All others count as hot.
# Most words are passed by in a loop (COLD), not tried at each character, and small letters by a class of
# their own, as Java asks every range of a larger one. Pairs are looked for only where one can begin,
# at a word's begin and after marks in it (MARKS).
PLAIN = r"a-z!-#%-/:-\[\]`|~\u00A1-\u00AF\u00B1-\u00B4\u00B6-\u00D6\u00D8-\u00F6\u00F8-\u036F\u0400-\u05FF\u2010-\u2027"
BLANK = r" \t\n\x0B\f\r"
WORD, HOT, GAP = f"[{PLAIN}]", f"[^{PLAIN}{BLANK}]", f"[{BLANK}]++"
MARKS = f"[{PLAIN}&&[^A-Za-z]]"
PAIRED = rf"(?:[a-zA-Z]*+(?![{BLANK}]){MARKS})*?(?:[XV][LCR]|[VIEvi]m)(?![A-Za-z0-9_])"
TO_WORD = rf"(?:[^{BLANK}{{]*+\{{(?s:.)*+|[^{BLANK}]++)"
IS_HOT = rf"(?:{WORD}*+{HOT}|{PAIRED})"
BEGIN = rf"(?<![^{BLANK}])(?=[^{BLANK}])(?:(?={WORD}*+(?:{HOT}|{GAP}{HOT}))(?:{WORD}++{GAP}(?={HOT}))?|(?={PAIRED}))"
NEIGHBOURHOOD = rf"{BEGIN}{TO_WORD}(?:(?<={HOT}){GAP}{TO_WORD}|{GAP}(?={IS_HOT}|{WORD}++{GAP}{HOT}){TO_WORD})*+"
COLD = rf"[{BLANK}]*+(?:(?!{PAIRED})(?:[a-z]++|{WORD})++(?:{GAP}(?:(?=[a-zA-Z])|(?!{HOT}))|\z))*+"
FROM_FIRST = rf"{BEGIN}(?s:.)++"


def markup_whole(c: Column, faithful: bool = True) -> Column:
    """All steps in order over a clean text; a step is left out of texts in which nothing can set it off."""
    c = where_found(c, NUCLEAR_AT, nuclear)
    for trigger, step in ((SYMBOL_AT, commands_for_symbols), (ROOT, roots), (SUBSCRIPT_AT, subscripts), (POWER_AT, powers_of_ten), (r"\\", wrap_commands)):
        c = where_found(c, trigger, lambda x, step=step: map_segments(x, step))
    return where_found(c, r"\$", lambda x: fuse(inner_subscripts(empty_roots(omega_powers(pi_fractions(denominators(x)))), faithful)))


def markup(c: Column, faithful: bool = True) -> Column:
    """All steps in order. Null and empty texts pass through. The text is cut once into neighbourhoods
    in which a step can find something; only these are rewritten, each on its own."""

    def some(x: Column) -> Column:
        return where_found(x, ANY_AT, lambda s: markup_whole(s, faithful))

    def both(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("$")), map_spans(x, FROM_FIRST, some, COLD)).otherwise(map_spans(x, NEIGHBOURHOOD, some, COLD))

    return F.transform(F.array(control_clean(c)), both)[0]


def audit(c: Column) -> list[Column]:
    """Counts of malformed markup, as aggregates."""
    return [
        F.count_if((F.length(c) - F.length(F.replace(c, F.lit("$"), F.lit("")))) % 2 != 0).alias("odd_dollar"),
        F.count_if(F.contains(c, F.lit(r"$\sqrt{}$"))).alias("empty_root"),
        F.count_if(F.rlike(c, F.lit(r"\$\\pi\$ \d"))).alias("pi_digit"),
        F.count_if(F.rlike(c, F.lit(r"\$\\omega\$\d"))).alias("omega_digit"),
        F.count_if(F.rlike(c, F.lit(r"(?Ud)\$[^$]+\$ \d(?=[\s,).]|$)"))).alias("denominator"),
    ]


def residual_symbols(c: Column) -> Column:
    """Display-time: symbols that are still bare become blocks of their own."""
    late = "ω π α β γ Γ δ Δ ε θ λ μ µ ν ξ ρ σ τ φ χ ψ Ω".split()
    for ch in late:
        c = F.replace(c, F.lit(ch), F.lit(f"$\\{GREEK[ch]}$"))
    c = chain(c, [(r"\s*°\s*", r"$^{\circ}$")])
    for ch in "×÷":
        c = F.replace(c, F.lit(ch), F.lit(f"${SIGNS[ch]}$"))
    c = chain(c, [("→([A-Za-z])", r"$\vec{<1>}$")])
    for ch in "→≤≥≠≈∝∞":
        c = F.replace(c, F.lit(ch), F.lit(f"${SIGNS[ch]}$"))
    return F.replace(c, F.lit("−"), F.lit("-"))


def merge_blocks(c: Column) -> Column:
    return chain(c, [(r"\$([^$]+)\$\s*\$([^$]+)\$", "$<1> <2>$")])


def display_math(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\$\$([^$]+?)\$\$"), F.lit(1))


def inline_math(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\$([^$\n]+?)\$"), F.lit(1))


def line_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br/>"))

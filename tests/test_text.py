"""Text rules against a table of cases and against a plain statement of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallysheet.functions import text as T
from tallysheet.functions import validate as V

#: Input, text after T1 to T9.
CORRECTED = [
    ("7p + 4q = 19", "7 * p + 4 * q = 19"), ("6 + l = 8", "6 + 1 = 8"), ("I - 9 = 5", "I -9 = 5"), ("m^S = 6", "m^S = 6"), ("m^Z - 8 = O", "m^Z -8 = O"), ("8×5÷4", "8 * 5/4"), ("w=ru-k", "w = ru-k"),
    ("9u+4=6", "9 * u + 4 = 6"), ("k^3-5k+2=O", "k^3 - 5 * k + 2 = O"), ("(5+6×7", "(5 + 6 * 7)"), ("p/q + r/s", "p/q + r/s"), ("u/S+I/7", "u/5 + 1/7"), ("4 o 6", "406"), ("4o6", "4 * o * 6"),
    ("p**4", "p *  * 4"), ("9 - 8", "9 - 8"), ("-6", " -6"), ("u)v)w", "uvw"), ("6-5-4", "6 - 5 - 4"), ("(9)-2", "(9) - 2"), ("8−5", "8 - 5"), ("", ""), ("  ", "  "), (None, None),
]


def apply(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *[c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns)])
    return [tuple(r)[1:] for r in rows.orderBy("i").collect()]


def test_corrector_cases(spark):
    got = apply(spark, [a for a, _ in CORRECTED], T.corrected)
    assert [g for (g,) in got] == [b for _, b in CORRECTED]


def plain(t):
    """The rules as a plain function of strings."""
    types = []
    for kind, p, r in [("letter_to_digit", rf"(?<=[0-9+\-*/=\s(]){c}(?=[0-9+\-*/=\s)])", d) for c, d in zip("OlISZ", "01152", strict=True)] + [
        ("operator_normalization", "×", "*"), ("operator_normalization", "÷", "/"), ("operator_normalization", "−", "-"), ("implicit_multiplication", r"([a-zA-Z])(\d)", r"\1*\2"),
        ("implicit_multiplication", r"(\d)([a-zA-Z])", r"\1*\2"), ("contextual_digit", r"(?<=\d)\s*[oO]\s*(?=\d)", "0")]:
        new = re.sub(p, r, t)
        types += [kind] * (new != t)
        t = new
    for p, r in [(r"\s*=\s*", " = "), (r"\s*\+\s*", " + "), (r"(?<!\d)\s*-\s*(?=\d)", " -"), (r"(?<=\d)\s*-\s*(?=\d)", " - "), (r"(?<=\))\s*-\s*(?=\d)", " - "), (r"\s*\*\s*", " * "), (r"\s*/\s*", " / ")]:
        t = re.sub(p, r, t)
    while t.count(")") > t.count("("):
        k = t.rindex(")")
        t = t[:k] + t[k + 1 :]
    t += ")" * (t.count("(") - t.count(")"))
    for p, r in [(r"(\d+)\s*/\s*(\d+)", r"\1/\2"), (r"\(\s*(\d+)\s*/\s*(\d+)\s*\)", r"(\1/\2)"), (r"([a-zA-Z]+)\s*/\s*([a-zA-Z0-9]+)", r"\1/\2"), (r"([a-zA-Z0-9]+)\s*\^\s*([0-9]+)", r"\1^\2"), (r"([a-zA-Z0-9]+)\s*\*\*\s*([0-9]+)", r"\1^\2")]:
        t = re.sub(p, r, t)
    return t, types


def test_corrector_on_random_strings(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("012OlISZoxab+-*/=^() \t×÷−\x1c é") for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    texts = [t for t in texts if t.strip()]
    rows = T.with_substitution_types(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    got = [(r.c, r.types) for r in rows.select("k", T.corrected(F.col("text")).alias("c"), "types").orderBy("k").collect()]
    want = [plain(t) for t in texts]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if (g[0], list(g[1])) != w]
    assert not bad, bad[:3]


FORMULAS = [
    ("k^3 - 8 = 0", "exponent", "intermediate", "subtraction,exponent,exponent", "$k^{3} - 8 = 0$"),
    ("cos(45°) = 4/9", "function", "complex", "division,fraction,functions,fraction,parentheses,function", r"$\cos(45°) = \frac{4}{9}$"),
    ("w = ru + v", "unknown", "simple", "", "$w = ru + v$"),
    ("√(p^2 + 9)", "exponent", "complex", "addition,quadratic,exponent,exponent,parentheses,radical", "$√(p^{2} + 9)$"),
    ("7p - 4 = 10", "algebra", "simple", "subtraction,multiplication,linear_equation", "$7p - 4 = 10$"),
]


def test_formula_classes(spark):
    got = apply(spark, [f[0] for f in FORMULAS], T.formula_type, T.formula_complexity, lambda c: F.array_join(T.formula_components(c), ","), T.to_latex)
    assert got == [f[1:] for f in FORMULAS]


@pytest.mark.parametrize("text, ok", [
    ("q + 7 = 3", True), ("k^2 + 9*k - 8", True), ("tan(p) + sin(q)", True), ("no formula at all §§", False), ("", False), ("  ", False), ("6u(v+8)", True), ("p = = q", False), ("((w)", False), ("-k", True),
    ("m ** 7", True), ("7.5e", True), ("r +", False), (")p(", False), ("* 9", False), ("p = q = r", False), ("=", False), (None, False),
])
def test_expressions(spark, text, ok):
    assert apply(spark, [text], V.is_expression) == [(ok,)]


def test_validation_keeps_the_original(spark):
    rows = spark.createDataFrame([("a $ b", "a $ c"), ("x", "x + 1"), ("y", "z" * 501)], "o string, f string")
    assert [r[0] for r in rows.select(V.validated(F.col("o"), F.col("f"))).collect()] == ["a $ b", "x + 1", "z" * 501]


def test_small_functions(spark):
    row = spark.range(1).select(
        T.confidence_fraction(F.lit(50.0)), T.confidence_fraction(F.lit(-1.0)), T.confidence_fraction(F.lit(500.0)), T.character_count(F.lit("a😀")), T.character_count(F.lit(None).cast("string")),
        T.preview(F.lit("abcdef"), 3), T.recognition_rate(F.lit("2 x + 3"), F.array(F.lit("2x"), F.lit("9"))),
    ).first()
    assert tuple(row) == (0.5, 0.0, 1.0, 2, 0, "abc...", 0.5)

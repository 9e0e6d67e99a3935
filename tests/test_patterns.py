"""Translated patterns against an engine that reads the first dialect."""

import random
import re

import duckdb
import pytest

from grove.functions.patterns import BadPattern, translated
from grove.functions.references import pattern

NAMES = ["main", "ahl", "v1", "a-b", "a&b", "[x]", "x]", "Ünï", "a.b", "a b", "a_b", "aab{2}", "{", "MAIN", "foo/bar", "1\x0b2", "a\tb", "", "ßs", "kK"]

PIECES = [
    "a", "b", "main", "[[:alpha:]]", "[[:^digit:]x]", "[a-z&&b]", "[]a]", "[^]a]", "[[a]", "[a-]", "[-a]", r"\pL", r"\PN", r"\p{Greek}", r"\p{^Latin}", r"\Qa.b\E", r"\Q[x", r"\d", r"\W", r"\s", r"[\s\d_]", r"[^\S]", r"\b", r"\B", ".", "*", "+", "?",
    "*?", "{2}", "{1,}", "{,2}", "{x", "{", "}", "]", "(", ")", "(?:", "(?P<n>", "(?i)", "(?i:", "(?s-m:", "(?U)", "|", "^", "$", r"\x41", r"\x{dc}", r"\101", r"\.", r"\-", r"\/", "Ü", " ", "_", "&", "-", "/", r"\A", r"\z", r"\v", r"\t", "[[:word:]-]", "1",
]

#: Repetitions of repetitions, of nothing, or behind flags, which not every reader of the dialect takes alike.
NESTED = re.compile(r"[*+?}][*+?{]|(^|[(|^$:)])[*+?{]")

REFUSED = ["(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", r"(a)\1", "a*+", "a**", "a{2}{3}", "a{1001}", "a{3,2}", "[z-a]", r"[a-\d]", "[[:foo:]]", "[a", "(a", "a)", r"\Z", r"\h", r"\R", r"\k<n>", "(?P<n>a)(?P<n>b)", "(?P<n", "(?x)", "*a", "a|*", r"\8", "a\\", r"\x{110000}"]


@pytest.fixture(scope="module")
def db():
    return duckdb.connect()


def meant(db, text):
    """The names that a pattern takes, None if the engine refuses it."""
    try:
        return [r[0] for r in db.execute("SELECT regexp_matches(x, ?) FROM (SELECT unnest(?) AS x)", [f"^{text}$", NAMES]).fetchall()]
    except duckdb.Error:
        return None


def taken(spark, texts):
    """What the translated patterns take, all in one scan."""
    df = spark.createDataFrame(list(enumerate(NAMES)), "i int, x string").coalesce(1)
    rows = sorted(df.select("i", *[pattern(t)(df.x).alias(f"p{k}") for k, t in enumerate(texts)]).collect())
    return {t: [r[1 + k] for r in rows] for k, t in enumerate(texts)}


def test_named_cases(spark, db):
    cases = ["[[:alpha:]]+", "[a-z&&b]+", "(?P<x>main)", r"\pL+", r"\Qmain\E", r"\p{Latin}+", "main|ahl", "(?i)main", "(?i:K)+K?", ".*", r"a\sb|1\s2", r"[\s]?a[\s]b", r"a\b.\bb", "a{,2}b|aab{2}", r"aab\{2\}", "{", r"[[]x]", "[]x[]+"]
    found = taken(spark, cases)
    for text in cases:
        assert found[text] == meant(db, text), text
    assert [n for n, hit in zip(NAMES, found["[[:alpha:]]+"]) if hit] == ["main", "ahl", "MAIN"]


def test_random_patterns(spark, db):
    """Every pattern made of pieces takes the same names in both engines, or is refused as in the first."""
    draw, texts = random.Random(6), set()
    while len(texts) < 250:
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(1, 5)))
        wanted = meant(db, text)
        try:
            translated(text)
        except BadPattern:
            assert wanted is None or NESTED.search(text), text
            continue
        assert wanted is not None, text
        texts.add(text)
    for text, hits in taken(spark, sorted(texts)).items():
        assert hits == meant(db, text), text


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(BadPattern):
        translated(text)


def test_unknown_script(spark):
    with pytest.raises(ValueError, match="NoScript"):
        spark.range(1).select(pattern(r"\p{NoScript}")(spark.range(1).id.cast("string")))

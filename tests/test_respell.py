"""Conversion as relations against the string functions, and composition against the Unicode tables."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphforge.functions import text as tx
from glyphforge.operators import convert as cv
from glyphforge.operators import respell as rs
from glyphforge.operators import words as wd
from glyphforge.operators.segment import Segmenter, convert
from glyphforge.plans.charts import UNIVERSAL, Spec
from glyphforge.sources.charts import bundled

WORDS = "kɔnɔ dodoɔ ɲɛgɛ nyini tʃaa ñoo éèê çà ẹọṣ ŋ̀ŋ́wa ãã ɔ̃ɔ̃ kpagba ng'ombe ƙaƙa öäü ß ˈa x̱ ǀa ɓoo uu ooɔ eɛe iɩ a-b ½ c'c q".split()


def test_composition_equals_unicode(spark):
    """Every character of the first planes whose parts are a letter and marks, and some heaps of marks."""
    seen = [c for c in map(chr, range(0xC0, 0x30000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and (d := unicodedata.normalize("NFD", c)) != c and all(map(unicodedata.combining, d[1:]))]
    heaps = ["a" + "".join(m) for m in ("̣́", "̣̂́", "́̀", "̧̄̂", "̃͡")] + ["ọ́ẹ̀ t͡ʃ", "́a", "", "plain", "e͡ɛ̃́"]
    texts = [unicodedata.normalize("NFD", s) for s in seen + heaps]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = dict(df.select("i", tx.compose(F.col("s"))).collect())
    assert len(seen) > 1500
    assert {i: s for i, s in got.items() if s != unicodedata.normalize("NFC", texts[i])} == {}


@pytest.mark.parametrize("code", ["dyu", "kus", "god", "bez", "swh"])
@pytest.mark.parametrize("options", [{}, {"clean": False, "unknown": "mark"}, {"fallback": False, "unknown": "drop"}])
def test_sounds_equal_the_segmenter(spark, code, options):
    spec = Spec(bundled().load(code), output="ipa", **options)
    words = [tx.normalize_str(w) for w in WORDS]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict(df.select("w", rs.sounds(tx.nfd(F.col("w")), spec)).collect())
    one = Segmenter(spec)
    assert got == {w: one.units(w) for w in words}


def test_all_targets_at_once_equal_the_converters(spark):
    targets = ["kus", "dyu", "swh", "god", "bez", "kea", UNIVERSAL]
    words = sorted({tx.normalize_str(w) for w in WORDS})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for source in ("dyu", "god"):
        got = {(r["target"], r["word"]): r["spelled"] for r in rs.respell(df, source, targets).collect()}
        want = {}
        for target in targets:
            c = cv.Converter(source, target)
            want |= {(target, w): c._word(w, "") for w in words}
        assert got == want


@pytest.mark.parametrize("most", [rs.BROADCAST_SOUNDS, 1])
def test_a_word_stays_one_row(spark, most):
    """Whatever the number of targets, a word's sounds are spelled in its row; sounds that are not shared come from a join."""
    targets = ["kus", "swh", UNIVERSAL]
    words = sorted({tx.normalize_str(w) for w in WORDS})
    got = rs.respellings(spark.createDataFrame([(w,) for w in words], "word string"), "dyu", targets, most=most)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == (0 if most > 1 else 1)
    found = {r["word"]: [tuple(x) for x in r["spelled"]] for r in got.collect()}
    assert found == {w: [(x, cv.Converter("dyu", x)._word(w, "")) for x in sorted(targets)] for w in words}


def test_texts_through_their_words(spark):
    texts = ["Kɔnɔ, dodoɔ; kɔnɔ.", "", None, "  ", "a. b.c: d's 'e f'g ...h", "ΣΑΣ, ΑΣ. ΑΣ.Α ΑΣ:Α", "x́,́y ≠ ≮ a", "é éé", "tab\tnew\nline\r\n", "«q»   [z]\\{|}~"] * 3
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "id int, text string")
    for f in (lambda c: cv.convert_column(c, "dyu", UNIVERSAL), lambda c: convert(c, Spec(bundled().load("kus")), " ")):
        want = sorted(map(str, df.select("id", f(F.col("text")).alias("converted")).collect()))
        for hot in (wd.HOT, 2):
            assert sorted(map(str, wd.through_words(df, "text", f, ["id"], hot=hot).collect())) == want


def test_texts_stay_whole(spark):
    """Words with a dictionary that all workers share move no text; others come back once a text."""
    df = spark.createDataFrame([(1, "aa b, aa. " * 300 + "c"), (2, None)], "id int, text string")
    want = {1: "AA B, AA. " * 300 + "C", 2: None}
    got = wd.through_words(df, "text", F.upper, ["id"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, got.collect())) == want
    rare = wd.through_words(df, "text", F.upper, ["id"], hot=1)
    assert "posexplode" not in rare._jdf.queryExecution().optimizedPlan().toString()
    assert dict(map(tuple, rare.collect())) == want


def test_sums_over_words(spark):
    df = spark.createDataFrame([(1, "aa b, aa"), (2, None), (3, ""), (1, "b")], "id int, text string")
    got = wd.word_sums(df, "text", {"n": F.length, "a": lambda c: F.length(F.regexp_replace(c, "[^a]", ""))}, ["id"]).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0), (1, 5, 4), (2, 0, 0), (3, 0, 0)]
    assert wd.word_sums(df.limit(0), "text", {"n": F.length}, ["id"]).count() == 0


MIXED = "« Ɣarwem aḏ … ⵏⴰ я ش ሀማ ߊߒ ꔀ ⲁ Ψω ŋŧ ɓɗ ʒɬʃ ǃgâbi ntsaa t͡s ꞌama ↄbↄ ɂama ҥ ﬁ ß Ǝntanay ء »"


@pytest.mark.parametrize("code", ["kus", "bez", "dyu", "swh", "kea", "god"])
def test_shared_spelling_is_ascii(code):
    out = cv.convert_lang(MIXED, code, UNIVERSAL)
    assert out.isascii() and all("a" <= c <= "z" for c in out if c.isalpha())


def test_spellings_of_uncovered_letters():
    found = {c: cv.universal_fallback(c) for c in "ŋɔɛːʰⵏßéﬁяشሀα"}
    assert found == {"ŋ": "ng", "ɔ": "o", "ɛ": "e", "ː": "", "ʰ": "", "ⵏ": "n", "ß": "ss", "é": "e", "ﬁ": "fi", "я": "y", "ش": "sh", "ሀ": "ha", "α": "a"}
    assert cv.universal_fallback("漢") is None and cv.universal_fallback("a") is None
    shared = bundled().shared
    assert all(s and s.isascii() and s.islower() for s in shared.spell.values()) and not shared.drop & shared.spell.keys()

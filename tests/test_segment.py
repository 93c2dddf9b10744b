"""Segmentation against published cases of the bundled charts, and both strategies against each other."""

import random

import pytest
from pyspark.sql import functions as F

from glyphforge.functions import text as tx
from glyphforge.operators import segment as sg
from glyphforge.plans.charts import LanguageNotFoundError, Spec
from glyphforge.sources.charts import Catalog, available_languages, bundled, load_rules

IPA = {"output": "ipa"}


@pytest.mark.parametrize(
    "lang,text,sep,options,want",
    [
        ("dyu", "nyini", " ", IPA, "ɲ i n i"),
        ("dyu", "kpako", " ", IPA, "k͡p a k o"),
        ("dyu", "gbɛ", " ", IPA, "ɡ͡b ɛ"),
        ("dyu", "sogo", "", IPA, "soɡo"),
        ("dyu", "jɛgɛ", "", IPA, "dʲɛɡɛ"),
        ("dyu", "kú", " ", IPA, "k u˥"),
        ("dyu", "Jakuma", "", IPA, "dʲakuma"),
        ("dyu", "nyini", " ", {}, "ny i n i"),
        ("dyu", "kpako", " ", {}, "kp a k o"),
        ("dyu", "kú", " ", {}, "k ú"),
        ("dyu", "jakuma, sogo.", "", {}, "jakuma, sogo."),
        ("dyu", "sox", "", {}, "sox"),
        ("dyu", "sox", "", {"unknown": "drop"}, "so"),
        ("dyu", "bàbá", " ", {}, "b à b á"),
        ("dyu", "bàbá", " ", {"strip_diacritics": True}, "b a b a"),
        ("swh", "ça", " ", {}, "c a"),
        ("kea", "½ ²", "", {}, "½ ²"),
    ],
)
def test_published_cases(lang, text, sep, options, want):
    assert sg.g2p(text, lang, sep=sep, **options) == want


def test_units():
    assert sg.G2P("god", unknown="mark", **IPA).phonemes("ˈze") == ["z", "e"]
    assert sg.G2P("god").phonemes("ˈze") == ["ˈ", "z", "e"]
    assert "�" in sg.G2P("god", unknown="mark", fallback=False, **IPA).phonemes("ˈze")
    assert "�" in sg.G2P("god", unknown="mark", **IPA).phonemes("zЖe")
    ruled = {**bundled().load("god"), "graphemes": {**bundled().load("god")["graphemes"], "ˈ": "˥"}}
    assert sg.G2P.from_rules(ruled).phonemes("ˈze") == ["˥", "z", "e"]
    assert sg.G2P("acz", **IPA).phonemes("ä") == ["ə"]
    assert "ʔ" in sg.G2P("kus", **IPA).phonemes("ba'as")
    assert "".join(sg.G2P("kea", **IPA).phonemes("txeu")) == "t͡ʃɛu"
    assert sg.G2P("dyu", **IPA).phonemes("Sogo, 3!", punctuation=True) == ["s", "o", "ɡ", "o", ",", "!"]
    assert sg.G2P("dyu", **IPA).phonemes("a, b", punctuation=False) == ["a", "b"]
    assert sg.G2P.from_rules({"graphemes": {"kp": "kp", "k": "k", "a": "a", "o": "o"}}).convert("kpako", " ") == "k͡p a k o"
    assert sg.Pipeline("dyu").run(["jakuma", "sogo"]) == ["jakuma", "sogo"]
    romanised = {"graphemes": {"በ": "b"}, "romanization": {"በ": "ba"}}
    assert sg.G2P.from_rules(romanised, output="latin").convert("በ") == "ba"


def test_errors():
    with pytest.raises(ValueError):
        sg.G2P("dyu", output="phonetic")
    with pytest.raises(LanguageNotFoundError, match="dyu"):
        load_rules("zzz")
    with pytest.raises(ValueError):
        Catalog({"a": {"code": "a"}}).load("a")
    assert available_languages() == sorted(bundled().charts)


def test_words_keep_marks_of_all_scripts():
    for word in ("በ፟", "ጉ፟"):
        assert tx.tokenize_str(word) == [(word, True)]
    assert "".join(t for t, _ in tx.tokenize_str("a-b c'd 1½ x́y")) == "a-b c'd 1½ x́y"


@pytest.mark.parametrize("a,b", [("tʃ", "t͡ʃ"), ("dʒ", "d͡ʒ"), ("ts", "t͡s"), ("kp", "k͡p"), ("ɡb", "ɡ͡b"), ("ʧ", "t͡ʃ"), ("ʤ", "d͡ʒ"), ("tʃʰ", "t͡ʃʰ"), ("p̪f", "p̪͡f"), ("n͡dʒ", "n͡d͡ʒ")])
def test_affricates_are_tied_once(spark, a, b):
    assert tx.tie_str(a) == tx.tie_str(b) == b
    assert spark.range(1).select(tx.tie_affricates(F.lit(a))).first()[0] == b


def test_native_and_udf_strategies_agree(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzɛɔŋɲʔäéüñ'̣́̃ा "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for lang in ("acz", "dyu", "kus", "god"):
        spec = Spec(bundled().load(lang))
        native = F.transform(sg.words_nfd(F.col("t")), lambda w: F.array_join(sg.units_native(w, spec), "|"))
        rows = df.select("i", tx.nfc(F.array_join(native, " ")).alias("u")).collect()
        reader = sg.Segmenter(spec)
        for r in rows:
            want = " ".join("|".join(reader.units(w)) for w, is_word in tx.tokenize_str(tx.normalize_str(texts[r.i])) if is_word)
            marked = [u for u in r.u.replace(" ", "|").split("|")]
            assert marked == want.replace(" ", "|").split("|")


def test_columns_keep_nulls(spark):
    df = spark.createDataFrame([("kpako", "dyu"), (None, "dyu"), ("a", "zzz"), ("a", None)], "t string, lang string")
    got = df.select(sg.convert_by_language(F.col("t"), F.col("lang"), sep=" ")).collect()
    assert [r[0] for r in got] == ["kp a k o", None, None, None]
    assert df.select(sg.convert(F.col("t"), Spec(bundled().load("dyu")), " ")).collect()[1][0] is None


def test_native_tokens_equal_python(spark):
    texts = ["Kú, bàbá! 12 x½y", "l'été d’or", "", "፣ በ፟ ok", "a_b-c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select(tx.tokens(F.col("t")).alias("k")).collect(), strict=True):
        assert [(x.text, x.is_word) for x in r.k] == tx.tokenize_str(t)


def test_english_units(spark):
    row = spark.range(1).select(sg.english_units(sg.english_normalise(F.lit("ˈtʃaɪ ɡeɪm|gə̃"))).alias("u")).first()
    assert row.u == ["t͡ʃ", "aɪ", "ɡ", "eɪ", "m", "ɡ", "ə̃"]

"""Conversion, the shared spelling, sounds back to letters, and the proxy code."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphforge.functions import tables as t
from glyphforge.functions import text as tx
from glyphforge.operators import codeswitch as cs
from glyphforge.operators import convert as cv
from glyphforge.operators import proxy as px
from glyphforge.plans.charts import PROXY, UNIVERSAL, LanguageNotFoundError, Shared, shared_from_votes
from glyphforge.sources.charts import Catalog, bundled


def test_passthrough():
    assert cv.convert_lang("kúu", "bez", UNIVERSAL) == "kuu"
    assert "'" not in cv.convert_lang("ng'ombe", "swh", UNIVERSAL)


def test_shared_spelling_is_plain():
    for lang, text in (("god", "ɓɛlɔ ŋa"), ("dyu", "jɛgɛ kɔ́nɔ")):
        out = cv.convert_lang(text, lang, UNIVERSAL)
        assert out.replace(" ", "").isascii() and out.replace(" ", "").isalpha()


def test_vowels_that_meet():
    vary = lambda s, to: "".join(cv.vary_vowels([(to.get(c, c), c, False) for c in s], t.SHIFTED_VOWEL_SHARED))
    assert vary("dodoɔ", {"ɔ": "o"}) == "doduo"
    assert vary("oɔɔ", {"ɔ": "o"}) == "uuo"
    assert vary("oo", {}) == "oo"


@given(st.lists(st.sampled_from("oɔeɛkab"), max_size=9))
@settings(max_examples=300, deadline=None)
def test_runs_are_compared_with_their_first_sound(sounds):
    letters = [{"ɔ": "o", "ɛ": "e"}.get(c, c) for c in sounds]
    first, runs = [], []
    for i, g in enumerate(letters):
        runs.append(runs[-1] if i and g == letters[i - 1] else i)
        first.append(sounds[runs[i]])
    meets = [i != runs[i] and sounds[i] != first[i] and letters[i] in t.VOWELS for i in range(len(letters))]
    want = [t.SHIFTED_VOWEL_SHARED.get(g, "i") if i + 1 < len(letters) and meets[i + 1] else g for i, g in enumerate(letters)]
    assert cv.vary_vowels([(g, s, False) for g, s in zip(letters, sounds, strict=True)], t.SHIFTED_VOWEL_SHARED) == want


def test_windows_equal_the_fold(spark):
    import random

    rng = random.Random(0)
    words = [[rng.choice("oɔeɛkab") for _ in range(rng.randint(1, 8))] for _ in range(300)]
    spell = {"ɔ": "o", "ɛ": "e"}
    rows = [(w, i, c, spell.get(c, c)) for w, cs_ in enumerate(words) for i, c in enumerate(cs_)]
    df = spark.createDataFrame(rows, "word int, pos int, sound string, letters string")
    got: dict[int, dict[int, str]] = {}
    for r in cv.vary_vowels_window(df, t.SHIFTED_VOWEL_SHARED).collect():
        got.setdefault(r.word, {})[r.pos] = r.out
    for w, units in enumerate(words):
        want = cv.vary_vowels([(spell.get(c, c), c, False) for c in units], t.SHIFTED_VOWEL_SHARED)
        assert [got[w][i] for i in range(len(units))] == want


def test_roundtrip_and_back():
    assert cv.roundtrip("kpako sogo", "dyu") == "kpako sogo"
    assert cv.from_ipa("ɲini, k͡pa 3!", "dyu") == "nyini, kpa 3!"
    assert cv.from_ipa("ʙa", "dyu", unknown="drop") == "a" and cv.from_ipa("ʙa", "dyu", unknown="mark") == "?a"
    assert cv.convert_to_ipa("nyini", "dyu") == "ɲini"
    with pytest.raises(LanguageNotFoundError):
        cv.from_ipa("a", "zzz")
    with pytest.raises(LanguageNotFoundError):
        cv.Converter("zzz", UNIVERSAL)


def test_fallback_table():
    shared = Shared(spell={"ŋ": "ng", "ክ": "k"}, drop=frozenset("͡"))
    for a, b in (("n͡t͡saa", "ntsaa"), ("k͡pa", "kpa"), ("«a…»", '"a..."'), ("ŋa", "nga"), ("a†", "a"), ("Ж", "Ж")):
        assert cv.apply_fallback_str(a, shared) == b
    assert cv.apply_fallback_str("ŋ", Shared()) == "ŋ"
    assert cv.romanise_str("ክa", shared) == "ka"
    catalog = Catalog(bundled().charts, shared=shared)
    assert cv.universal_fallback("ŋ", catalog) == "ng" and cv.universal_fallback("͡", catalog) == "" and cv.universal_fallback("q", catalog) is None


def test_fallback_columns_equal_the_functions(spark):
    shared = Shared(spell={"ŋ": "ng", "ክ": "k"}, drop=frozenset("͡"))
    texts = ["n͡t͡saa «x»", "ክŋ†…", "plain", ""]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    rows = df.select(tx.apply_fallback(F.col("s"), shared.spell, tuple(shared.drop)).alias("f"), tx.romanise(F.col("s"), shared.spell, tuple(shared.drop)).alias("r"), tx.ascii_punctuation(F.col("s")).alias("p")).collect()
    assert [r.f for r in rows] == [cv.apply_fallback_str(x, shared) for x in texts]
    assert [r.r for r in rows] == [cv.romanise_str(x, shared) for x in texts]
    assert rows[0].p == 'n͡t͡saa "x"'


def test_shared_table_rules():
    shared = shared_from_votes({"k": {"k": 3, "c": 1}, "c": {"k": 1}, "ŋ": {"ŋ": 5, "ng": 2}, "ʔ": {"q": 2}, "ba": {"ba": 1}, "õ": {"on": 2}, "ǀ": {"ǀ": 1}})
    assert shared.write["ŋ"] == "ng" and shared.write["ʔ"] == "" and "ǀ" not in shared.write
    assert shared.read["k"] == "k" and "ba" not in shared.read and "on" not in shared.read


def test_proxy_known_payloads():
    assert px.encode_str("ɔ") == "xzzyvx" and px.encode_str("ŋ") == "xzzngx" and px.encode_str("é") == "exzzbftx"
    assert px.encode_str("x") == "xx" and px.encode_str("onyankopɔn") == "onyankopxzzyvxn"
    assert px.decode_str("x") == "x" and px.decode_str("xab") == "xab" and px.decode_str("xzzx") == "zz"
    assert px.decode_str("xzz" + "z" * 30 + "x") == "zz" + "z" * 30
    assert cv.convert_lang("«ntsaa» a‑b 3!", "dyu", PROXY).isascii()
    named = {"ɔ": "o", "́": "q"}
    assert px.decode_str(px.encode_str("ɔ́x", named), named) == "ɔ́x" and px.encode_str("ɔ", named) == "xox"


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_proxy_reads_back(s):
    s = s.encode("utf-8", "ignore").decode()
    coded = px.encode_str(s)
    assert coded.isascii() and px.decode_str(coded) == unicodedata.normalize("NFC", s)


def test_proxy_columns_equal_the_functions(spark):
    texts = ["ɔ é x xx", "«ntsaa» a‑b 3!", "", "ꘋ😀\u0000A", "xzzyvx"]
    named = {"ɔ": "o", "́": "q"}
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    for names in (None, named):
        rows = df.select(px.encode(F.col("s"), names).alias("e"), px.decode(px.encode(F.col("s"), names), names).alias("d"), px.decode(F.col("s"), names).alias("r")).collect()
        assert [r.e for r in rows] == [px.encode_str(x, names) for x in texts]
        assert [r.d for r in rows] == [unicodedata.normalize("NFC", x) for x in texts]
        assert [r.r for r in rows] == [px.decode_str(x, names) for x in texts]


def test_payload_allocation():
    got = px.allocate([("ɔ", 5), ("ŋ", 9), ("́", 2), ("ɛ", 5)], {"ŋ": "ng", "ɔ": "o", "ɛ": "o"})
    assert got == {"́": "q", "ŋ": "ng", "ɔ": "o", "ɛ": got["ɛ"]} or got["ɛ"] == "o"
    assert len(set(got.values())) == 4 and not any(p.startswith("zz") or "x" in p for p in got.values())


def test_codeswitch(spark, tmp_path):
    lexicon = {"supermarket": "suːpɚmɑːɹkɪt", "new york city": "NYC", "new york": "NY"}
    f = lambda w: w.upper()
    assert cs.rewrite("n  be (supermarket)!", lexicon, f) == "N BE (suːpɚmɑːɹkɪt)!"
    assert cs.rewrite("New York City, new york", lexicon, f) == "NYC, NY"
    assert cs.rewrite("new new york", lexicon, f) == "NEW NY"
    assert cs.rewrite("  ", lexicon, f) == "  " and cs.rewrite("- a", lexicon, f) == "- A"
    (tmp_path / "lex.tsv").write_text("Hello\t1\nhello\t2\nbad line\nnew york\t3\textra\n")
    found = cs.collect_lexicon(cs.read_lexicon(spark, str(tmp_path / "lex.tsv")))
    assert found == {"hello": "2", "new york": "3"}
    with pytest.raises(ValueError):
        cs.collect_lexicon(cs.read_lexicon(spark, str(tmp_path / "lex.tsv")), limit=1)
    from glyphforge.operators.segment import G2P

    assert G2P("dyu", output="ipa", codeswitch={"supermarket": "S"}).convert("nyini supermarket") == "ɲini S"


def test_collisions_are_sought_in_distinct_words(spark, tmp_path, monkeypatch):
    from glyphforge import queries

    texts = ["réel reel réel, idéee", "aà bo", "...", None, "oôo noon réel"]
    spark.createDataFrame([(i, x, "fr", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, plain = [], queries.cv.vary_vowels_window
    monkeypatch.setattr(queries.cv, "vary_vowels_window", lambda units, shifted: asked.append(units) or plain(units, shifted))
    got = {r.doc_id: (r.n, r.vowels) for r in queries.collision_rewrite(spark, str(tmp_path)).collect()}
    near = t.SHIFTED_VOWEL_SHARED
    assert got[0] == (4, near["e"] * 4) and got[1] == (1, near["a"]) and set(got) == {0, 1, 4}
    assert sorted(r.word for r in asked[0].select("word").distinct().collect()) == ["aà", "idéee", "oôo", "réel"]
    assert asked[0].count() == 2 + 5 + 3 + 4

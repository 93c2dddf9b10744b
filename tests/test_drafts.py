"""Every check on drafted charts finds its planted fault; English never goes through a chart of letters."""

import json

import pytest
from pyspark.sql import functions as F

from glyphforge import cli
from glyphforge.operators import segment as sg
from glyphforge.operators.drafts import draft_chart_issues

FINE = {"graphemes": {"a": "a", "b": "b", "sh": "ʃ"}, "diacritics": {"́": "˦"}, "alphabet": ["a"], "examples": [], "scripts": {"latin": ["a"]}, "tones": {}, "romanization": {}}
DRAFTS = {
    "fine": FINE,
    "null": {**FINE, "tones": None},
    "none": {**FINE, "graphemes": {}},
    "miss": {"alphabet": []},
    "type": {**FINE, "tones": [1], "alphabet": {"a": 1}, "examples": "x"},
    "list": {**FINE, "graphemes": ["a"]},
    "scri": {**FINE, "scripts": {"native": "Arab", "latin": []}},
    "void": {**FINE, "graphemes": {"a": " ", "b": "", "c": None, "d": 5}},
    "gees": {**FINE, "graphemes": {"a": "a", "g": "g"}, "diacritics": {"̃": "ng"}, "romanization": {"ⴳ": "g"}},
    "word": {**FINE, "diacritics": {"̃": "nasal vowel"}},
    "dead": {**FINE, "graphemes": {"a": "a", "á": "á", "é": "e", "ã": "ã"}},
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in DRAFTS.items()] + [("junk", "{not json"), ("nil", None)]
    letters = [("fine", c) for c in "abáẵsz"] + [("dead", "é"), ("none", "a"), ("other", "q"), ("fine", "a")]
    out = draft_chart_issues(spark.createDataFrame(rows, "lang string, json string"), spark.createDataFrame(letters, "lang string, char string")).collect()
    got = {}
    for r in out:
        got.setdefault(r["lang"], set()).add((r["issue"], r["detail"]))
    return got


def test_each_fault_is_found(found):
    assert found == {
        "fine": {("not reachable", c) for c in "ẵsz"},
        "none": {("no graphemes", None)},
        "miss": {("no graphemes", None)},
        "type": {("wrong type", "tones is array"), ("wrong type", "alphabet is object"), ("wrong type", "examples is string")},
        "list": {("wrong type", "graphemes is array")},
        "scri": {("script is no list", "native")},
        "void": {("empty value", "a"), ("empty value", "b"), ("empty value", "c")},
        "gees": {("ASCII g", "graphemes: g=g"), ("ASCII g", "diacritics: ̃=ng"), ("ASCII g", "romanization: ⴳ=g")},
        "word": {("diacritic in words", "̃=nasal vowel")},
        "dead": {("never needed", "á")},
        "junk": {("no JSON", None)},
        "nil": {("no JSON", None)},
    }


RAW = "gəʊ tʃiːz ə|ˈweɪ"


def test_english_is_sounds(spark, capsys):
    assert sg.g2p(RAW, "eng", sep=" ") == "ɡ ə ʊ t͡ʃ iː z ə w eɪ"
    assert sg.g2p(RAW, "eng") == "ɡəʊ t͡ʃiːz əweɪ"
    assert sg.Pipeline("en").run([RAW, " "], sep=" ") == ["ɡ ə ʊ t͡ʃ iː z ə w eɪ", ""]
    df = spark.createDataFrame([(RAW,), (" ",), (None,)], "s string")
    assert [tuple(r) for r in df.select(sg.Pipeline("eng").run(F.col("s"), sep=" "), sg.Pipeline("eng").run(F.col("s"))).collect()] == [("ɡ ə ʊ t͡ʃ iː z ə w eɪ", "ɡəʊ t͡ʃiːz əweɪ"), ("", ""), (None, None)]
    assert cli.main(["eng", RAW]) == 0 and capsys.readouterr().out == "ɡ ə ʊ t͡ʃ iː z ə w eɪ\n"
    with pytest.raises(ValueError):
        sg.Pipeline("eng", output="latin")

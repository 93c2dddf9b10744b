"""Votes, coverage, checks and builders on small made-up charts; file sources; streams; SQL; command line."""

import io

import pytest
from pyspark.sql import functions as F

from glyphforge import cli, sql
from glyphforge.operators import analytics as an
from glyphforge.operators import builders as bd
from glyphforge.plans.charts import Spec
from glyphforge.sources import charts as ch
from glyphforge.sources import files as fl
from glyphforge.streaming import lift

A = {"code": "aa", "name": "Aa (north)", "country": "X", "family": None, "source": "Book, p. 7", "confidence": "hand-verified", "graphemes": {"a": "a", "ny": "ɲ", "ë": "ə3", "k": "k"}, "diacritics": {"́": "˥"}, "alphabet": ["a", "k", "ny"], "examples": [{"word": "kany", "gloss": "x"}, {"word": "kaЖ", "gloss": "y"}]}
B = {"code": "bb", "name": "Bb", "country": "Y", "source": "s", "confidence": "omniglot", "graphemes": {"a": "a", "ñ": "ɲ", "ny": "ɲ", "c": "k", "k": "k", "ae": "ae", "VV": "v"}, "diacritics": {}, "alphabet": ["a", "c"], "scripts": {"native": [], "latin": ["k", "ñ"]}}
CATALOG = ch.Catalog({"aa": A, "bb": B})


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_votes(spark):
    votes = an.phoneme_votes(ch.grapheme_rules(spark, CATALOG))
    assert ("ɲ", "ny", 2) in rows(votes, "ipa", "grapheme", "votes")
    assert ("ɲ", "n", 1) in rows(an.base_votes(votes), "ipa", "base", "votes")
    winners = {r.ipa: r for r in an.vote_winners(votes).collect()}
    assert (winners["ɲ"].grapheme, winners["ɲ"].grapheme_langs, winners["ɲ"].langs) == ("ny", 2, 3)
    assert winners["k"].grapheme == "k"
    tables = rows(an.shared_tables(votes), "direction", "grapheme", "ipa")
    assert ("write", "ae", "ae") in tables and ("read", "ae", "ae") not in tables and not any("V" in x[1] for x in tables)
    choices = spark.createDataFrame([("k", "kk"), ("a", "?")], "ipa string, choice string")
    merged = {r.ipa: (r.grapheme, r.replaced) for r in an.override(an.vote_winners(votes), choices).collect()}
    assert merged["k"] == ("kk", True) and merged["a"][0] == "a"


def test_winner_ties_prefer_runs_of_the_alphabet(spark):
    votes = spark.createDataFrame([("x", "ba", 1), ("x", "ab", 1), ("y", "é", 1), ("y", "z", 1)], "ipa string, grapheme string, votes long")
    assert rows(an.vote_winners(votes), "ipa", "grapheme") == [("x", "ab"), ("y", "z")]


def test_chart_checks(spark):
    declared = spark.createDataFrame([(7, 9)], "page int, num_graphemes int")
    issues = rows(an.chart_issues(spark, CATALOG, declared), "lang", "issue", "detail")
    assert issues == [("aa", "alphabet size", "3/9"), ("aa", "few graphemes", "4"), ("aa", "suspicious sound", "ë=ə3"), ("aa", "unmapped example", "kaЖ")]
    reasons = {(r.unit, r.reason) for r in an.convention_issues(spark, CATALOG).collect()}
    assert {("ae", "vowel sequence"), ("ae", "more than one sound"), ("́", "diacritic value")} <= reasons
    assert rows(an.plain_charts(spark, CATALOG), "lang") == [("aa",), ("bb",)]
    assert rows(an.reverse_table(spark, CATALOG).filter("lang = 'bb'"), "ipa", "grapheme") == sorted((k, v) for k, v in CATALOG.spelling("bb").items())
    matrix = {r.grapheme: r for r in an.cross_matrix(ch.grapheme_rules(spark, CATALOG), ["aa", "bb"]).collect()}
    assert matrix["k"].differs is False and matrix["ñ"].aa is None
    assert rows(an.chart_confidence(spark, CATALOG), "confidence", "n") == [("hand-verified", 1), ("omniglot", 1)]
    attested = spark.createDataFrame([("aa", "á"), ("aa", "ë"), ("aa", "ö"), ("aa", "a")], "lang string, char string")
    assert rows(an.unreachable_letters(spark, attested, CATALOG), "char") == [("ö",)]
    n, hit = an.composed_reachability(spark).selectExpr("sum(n)", "sum(reached)").first()
    assert n and hit / n >= 0.94


PROBLEMS = [("", "empty value"), ("g", "ASCII g"), ("ʧ", "ligature"), ("t͡", "dangling tie"), ("t͡m", "unexpected tie"), ("n\u032a\u0303", "not composed"), ("n\u032a", "more than one sound"), ("m̃", "nasal consonant"), ("aʷ", "secondary articulation on a vowel"), ("ab", "more than one sound"), ("1", "not a segment"), ("ɛ̃", None), ("t͡ʃ", None), ("kʷ", None), ("ç", None)]


def test_one_sound_convention(spark):
    got = spark.createDataFrame(PROBLEMS, "value string, want string").select("want", an.phoneme_problem(F.col("value")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_coverage(spark):
    docs = spark.createDataFrame([("p", "kany aka"), ("p", "Жaka kak"), ("q", "12345678"), ("q", None)], "src string, t string")
    got = an.coverage(docs, "t", Spec(A))
    assert [round(r.coverage, 3) if r.coverage is not None else None for r in got.collect()] == [1.0, 0.857, 1.0, 1.0]
    means = an.coverage_by(got, "src", "t")
    assert rows(means, "src", "sentences", "coverage") == [("p", 2, 0.929), ("q", 1, 1.0)]
    assert rows(an.coverage_buckets(means), "bucket", "n") == [("85-95", 1), ("95+", 1)]
    assert rows(an.low_coverage(means, "src", 0.95), "src") == [("p",)]
    assert rows(an.best_chart(docs, "src", "t", ["aa", "bb"], CATALOG), "src", "chart") == [("p", "aa"), ("q", "aa")]


def test_prose_leaks(spark):
    df = spark.createDataFrame([("a tone", "tone nasal")], "before string, after string")
    assert an.prose_leaks(df, "before", "after", ("tone", "nasal")).first().leaked == ["nasal"]


def test_fidelity(spark):
    df = spark.createDataFrame([("x", "ɔ x"), ("x", ""), ("y", None)], "lang string, t string")
    got = an.proxy_fidelity(df, "lang", "t")
    assert rows(got, "lang", "sentences", "exact", "exact_pct", "char_pct", "non_az") == [("x", 2, 2, 100.0, 100.0, 0)]
    assert rows(an.worst_fidelity(got, "lang"), "lang") == [("x",)]


# ---------------------------------------------------------------- builders


def test_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page": 3, "language": "Été (x)", "country": "C", "graphemes": [{"phoneme": "[g]", "grapheme": " g "}, {"phoneme": "x", "grapheme": "g"}, {"phoneme": "", "grapheme": "h"}], "diacritics": [{"mark": "U+0301", "ipa": "˥"}, {"mark": "U+zz", "ipa": "y"}, {"mark": "~", "ipa": ""}]}')
    (tmp_path / "b.json").write_text('{"is_language_page": false, "language": "no", "graphemes": [{"phoneme": "a", "grapheme": "a"}]}')
    (tmp_path / "c.json").write_text('{"iso": "CCC", "graphemes": [{"grapheme": "በ", "ipa": "b", "script": "native"}, {"grapheme": "b", "ipa": "b", "script": "latin"}], "romanization": [{"native": "በ", "latin": "ba"}, {"native": "በ", "latin": "be"}]}')
    pages = fl.read_pages(spark, str(tmp_path))
    assert rows(bd.rule_rows(pages), "code", "grapheme", "ipa") == [("ccc", "b", "b"), ("ccc", "በ", "b"), ("ete", "g", "ɡ")]
    assert rows(bd.mark_rows(pages), "code", "mark", "ipa") == [("ete", "́", "˥")]
    assert rows(bd.romanization_rows(pages), "native", "latin") == [("በ", "ba")]
    assert ("ccc", ["በ"], ["b"]) in rows(bd.script_units(pages), "code", "native", "latin")


def test_precedence_and_codes(spark):
    charts = spark.createDataFrame([("a", 1, "hand-verified", "X"), ("a", 2, "omniglot", "Y"), ("b", 1, "omniglot", None), ("b", 2, "omniglot", None)], "code string, origin int, confidence string, country string")
    assert rows(bd.merge_sources(charts), "code", "origin") == [("a", 1), ("b", 2)]
    assert rows(bd.merge_sources(charts, force=True), "code", "origin") == [("a", 2), ("b", 2)]
    assert rows(bd.distinct_codes(charts, "origin"), "final_code") == [("a-x",), ("a-y",), ("b",), ("b-2",)]


def test_spreadsheets(spark):
    grid = [("s", 0, 0, "በ"), ("s", 0, 1, "ተ"), ("s", 1, 0, "ba"), ("s", 1, 1, "ta"), ("s", 2, 0, "[bə]"), ("s", 2, 1, "[tə]")]
    cells = spark.createDataFrame(grid, "sheet string, r int, c int, v string")
    assert rows(bd.triplet_rows(cells), "unit", "ipa") == [("ba", "bə"), ("ta", "tə"), ("በ", "bə"), ("ተ", "tə")]
    assert rows(bd.triplet_romanization(cells), "native", "latin") == [("በ", "ba"), ("ተ", "ta")]
    fidel = [("f", 0, 1, "[ə/e]"), ("f", 0, 2, "[u]"), ("f", 1, 1, "በ"), ("f", 1, 2, "ቡ"), ("f", 2, 0, "[b]"), ("f", 2, 1, "bə")]
    assert rows(bd.syllable_rows(spark.createDataFrame(fidel, "sheet string, r int, c int, v string")), "unit", "ipa") == sorted([("ቡ", "bu"), ("በ", "bə")])
    sheets = spark.createDataFrame([("x", "Alphabet"), ("x", "Numbers"), ("y", "One"), ("y", "Sample text")], "book string, sheet string")
    assert rows(bd.chart_sheets(sheets), "book", "sheet") == [("x", "Alphabet"), ("y", "One")]


def test_registry_and_spellings(spark):
    registry = spark.createDataFrame([("a", "Aa (north)"), ("b", "Bb"), ("c", "Cc")], "code string, name string")
    metadata = spark.createDataFrame([("aa", "g1"), ("bb", "g2")], "name string, glottocode string")
    assert rows(bd.enrich_registry(registry, metadata).fillna(""), "code", "glottocode") == [("a", "g1"), ("b", "g2"), ("c", "")]
    chars = spark.createDataFrame([("፣", ",", []), ("ٜ", "dot", ["dot"]), ("َ", "a", ["fatha"]), ("በ", "ba", []), ("ꘋ", "", []), ("ꘌ", "abcdefgh", [])], "char string, romanised string, name_words array<string>")
    assert {r.char: (r.action, r.spelling) for r in bd.romanisation_rules(chars).collect()} == {"፣": ("spell", ","), "ٜ": ("drop", None), "َ": ("spell", "a"), "በ": ("spell", "ba"), "ꘋ": ("drop", None), "ꘌ": ("reject", None)}
    answers = spark.createDataFrame([("ŋ", "ng"), ("ʔ", ""), ("q", "toolong"), ("ɲ", "ny")], "char string, spelling string")
    assert rows(bd.accepted_spellings(answers, answers.select("char").filter("char != 'ɲ'")), "char", "action") == [("ŋ", "spell"), ("ʔ", "drop")]
    charts = spark.createDataFrame([("hau-a",), ("hau-b",), ("ibo",)], "lang string")
    assert rows(bd.first_chart_per_code(charts, "lang"), "lang") == [("hau-a",), ("ibo",)]
    assert rows(bd.uncharted(charts, charts.filter("lang = 'ibo'")), "lang") == [("hau-a",), ("hau-b",)]


# ---------------------------------------------------------------- files


def test_corpora(spark, tmp_path):
    (tmp_path / "My_Name_abc_v1.csv").write_text('verse_key,version_id,local\n1,2,"a, b"\n1,2, \n1,2\n1,2,x\n')
    corpus = fl.read_corpus(spark, str(tmp_path / "*.csv"))
    assert rows(corpus, "text") == [('"a, b"',), ("x",)]
    assert rows(fl.corpus_index(corpus.select("file").distinct()), "name", "code") == [("My Name", "abc")]
    (tmp_path / "versions.txt").write_text("has_text,lang_code\ntrue,a\nfalse,b\n")
    assert rows(fl.read_versions(spark, str(tmp_path / "versions.txt")), "lang_code") == [("a",)]


def test_table_files(spark, tmp_path):
    lines = fl.table_rows(spark, ["aa", "bb"], CATALOG)
    got = {(r.lang, r.section, r.key): r.value for r in fl.parse_tables(lines).collect()}
    assert got[("aa", "graphemes", "ny")] == "ɲ" and got[("aa", "apostrophes", "'")] is None
    assert got[("aa", "meta", "passthrough")] == "1"
    assert fl.check_tables(lines).count() == 0
    broken = spark.createDataFrame([("z", 0, "nonsense"), ("z", 1, "[other]"), ("z", 2, "a\\tb\t\\\\n\\n")], "lang string, line_no int, value string")
    assert rows(fl.check_tables(broken), "problem") == [("head line",), ("no section graphemes",), ("no section universal_reverse",)]
    assert rows(fl.parse_tables(broken), "key", "value") == [("a\tb", "\\n\n")]
    fl.write_tables(lines, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("lang=*")) == ["lang=aa", "lang=bb"]


def test_lenient_json():
    assert fl.repair_json('{"a": [1, 2, {"b": "c') == '{"a": [1, 2, {"b": "c"}]}'
    assert fl.repair_json('{"a": 1,\x01 "b"') == '{"a": 1}'
    assert fl.repair_json('{"x": [{"a": 1}, {"a": 2}, {"a":') == '{"x": [{"a": 1}, {"a": 2}]}'
    with pytest.raises(ValueError):
        fl.repair_json("nothing")


def test_chart_folder(spark, tmp_path):
    import json

    for c in (A, B):
        (tmp_path / f"{c['code']}.json").write_text(json.dumps(c, ensure_ascii=False))
    catalog = ch.Catalog.read(spark, str(tmp_path))
    assert list(catalog.load("aa")["graphemes"]) == ["a", "ny", "ë", "k"]
    assert rows(ch.alphabet_units(spark, catalog).filter("lang = 'bb'"), "pos", "unit") == [(0, "a"), (1, "c")]
    assert rows(ch.diacritic_rules(spark, catalog), "lang", "ipa") == [("aa", "˥")]
    assert ch.chart_examples(spark, catalog).count() == 2
    assert ch.romanization_rules(spark, catalog).count() == 0
    assert catalog.registry()["aa"]["name"] == "Aa (north)"


def test_side_tables(spark, tmp_path):
    from glyphforge.plans.charts import Shared, shared_from_votes

    (tmp_path / "plain.json").write_text('["aa", "zz"]')
    (tmp_path / "fallback.json").write_text('{"spell": {"ŋ": "ng"}, "drop": ["͡"]}')
    (tmp_path / "escapes.json").write_text('{"payloads": {"ɔ": "o"}}')
    (tmp_path / "votes.json").write_text('{"phonemes": {"k": {"votes": {"k": 2, "c": 1}}}}')
    assert ch.Catalog({}, plain=ch.read_plain(spark, str(tmp_path / "plain.json"))).is_plain("zz")
    assert ch.read_fallback(spark, str(tmp_path / "fallback.json")) == ({"ŋ": "ng"}, frozenset("͡"))
    assert ch.read_payloads(spark, str(tmp_path / "escapes.json")) == {"ɔ": "o"}
    votes = ch.read_votes(spark, str(tmp_path / "votes.json"))
    assert shared_from_votes(votes).write["k"] == "k"
    assert rows(an.vote_winners(ch.vote_rows(spark, votes)), "ipa", "grapheme") == [("k", "k")]
    assert ch.universal_non_alphabetic() == {}
    assert ch.universal_non_alphabetic(Shared(write={"ʘ": "ʘ", "k": "k"})) == {"ʘ": "ʘ"}


# ---------------------------------------------------------------- streams, SQL, command line


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("kpako\nnyini\n")
    spec = Spec(ch.bundled().load("dyu"))
    q = lift.converted(lift.lines(spark, str(tmp_path / "in")), spec, sep=" ").writeStream.format("memory").queryName("lifted").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.table("lifted"), "converted") == [("kp a k o",), ("ny i n i",)]
    events = spark.createDataFrame([("2024-01-01 00:00:01", "kpako"), ("2024-01-01 00:06:00", "Ж")], "ts string, t string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(lift.windowed_coverage(events, spec, "ts", "t"), "n", "coverage") == [(1, 0.0), (1, 1.0)]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT g2p('nyini', 'dyu', 'ipa') a, phonemes('kú.', 'dyu') b, convert_lang('kúu', 'bez', 'universal') c, from_proxy(to_proxy('ɔx')) d, normalize_text('É') e, g2p(NULL, 'dyu', 'ipa') f").first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("ɲini", ["k", "u˥", "."], "kuu", "ɔx", "é", None)
    got = spark.sql("SELECT * FROM segment_units('nyi, ka', 'dyu')").collect()
    assert [tuple(r) for r in got] == [(0, 0, "ny", "ɲ"), (0, 1, "i", "i"), (2, 0, "k", "k"), (2, 1, "a", "a")]


def test_command_line(capsys, monkeypatch):
    assert cli.main(["dyu", "nyini"]) == 0 and capsys.readouterr().out == "ny i n i\n"
    assert cli.main(["bez", "kúu", "--to", "universal"]) == 0 and capsys.readouterr().out == "kuu\n"
    assert cli.main(["dyu", "nyini", "--ipa", "--sep", ""]) == 0 and capsys.readouterr().out == "ɲini\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("nyini\nkpako\n"))
    assert cli.main(["dyu", "--lines"]) == 0 and capsys.readouterr().out == "ny i n i\nkp a k o\n"
    assert cli.main(["zzz", "a"]) == 1 and "zzz" in capsys.readouterr().err
    assert cli.main(["--list"]) == 0 and "dyu\t" in capsys.readouterr().out


def test_picks_count_every_document_of_a_text(spark):
    rows = spark.createDataFrame([("a", "z", 1.0, 2), ("a", "y", 1.0, 1), ("b", "z", 1.0, 1), ("b", "y", 0.95, 3), ("b", "x", 0.9, 1), ("b", "w", 0.5, 1)], "lang string, text string, coverage double, times int")
    assert sorted((r.lang, r.text) for r in an.sample_picks(rows, "lang", "text", times="times").collect()) == [("a", "z"), ("b", "y"), ("b", "z")]
    assert sorted((r.lang, r.text) for r in an.sample_picks(rows, "lang", "text").collect()) == [("a", "y"), ("a", "z"), ("b", "y"), ("b", "z")]


def test_words_of_keys_are_not_cut(monkeypatch):
    """Letters missed are those that the segmenter marks, and words of keys alone are seen without it."""
    from glyphforge.functions.text import nfd_str, normalize_str
    from glyphforge.operators.segment import Segmenter
    from glyphforge.plans.charts import REPLACEMENT

    words = ["ng'ombe", "ngano", "chxa", "cafe", "éà", "xyz", "kɔnɔ", "", "x", "q\u0301", "ß", "a'b", "ŋ̀ŋ́wa", "ɡa", "Ａb"]
    for chart in ({"graphemes": {"ab": "1", "abc": "2", "cd": "3"}}, {"graphemes": {"a": "x", "�": "y", "b": "�"}}, {"graphemes": {}}, ch.bundled().load("swh"), ch.bundled().load("kea"), ch.bundled().load("bez")):
        for output in ("grapheme", "ipa"):
            spec = Spec(chart, output, "mark")
            count, s = an._unread(spec), Segmenter(spec)
            for w in map(normalize_str, [*words, "abcd", "abcabcd", "abab", "ba"]):
                assert count(w) == s.convert_word(w, lower=False).count(REPLACEMENT), (w, output)
    cut = []
    monkeypatch.setattr(Segmenter, "_units", lambda self, text: cut.append(text) or [])
    count = an._unread(Spec(ch.bundled().load("swh"), "grapheme", "mark"))
    assert [count(w) for w in ("ngano", "shamba", "chakula")] == [0, 0, 0] and not cut

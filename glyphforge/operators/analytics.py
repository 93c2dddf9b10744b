"""Set-level analyses: votes, coverage, inventories, n-grams, chart checks, round-trip fidelity."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.text import Memo, base_letter, chars, clean_ipa, nfc, nfd, nfd_str, normalize_str, normalize_text, per_row, python_class, script_of, tie_affricates, word_pattern
from ..plans.charts import REPLACEMENT, Spec
from ..sources.charts import Catalog, bundled, chart_examples, chart_table, diacritic_rules, grapheme_rules
from . import proxy
from .segment import Segmenter, convert_by_language

ALPHABET = "abcdefghijklmnopqrstuvwxyz"

# ---------------------------------------------------------------- votes


def phoneme_votes(rules: DataFrame) -> DataFrame:
    """ipa, grapheme, votes: the number of languages that write a sound so."""
    return rules.filter("ipa != ''").groupBy("ipa", "grapheme").agg(F.countDistinct("lang").alias("votes"))


def _winner(votes: DataFrame, unit: str, base: Column) -> Column:
    """Most votes; ties by whether the base letters are a run of the alphabet, length, code points."""
    off = F.instr(F.lit(ALPHABET), base) == 0
    return F.min_by(unit, F.struct((-F.col("votes")).alias("v"), off.alias("o"), F.length(unit).alias("l"), F.col(unit).alias("g")))


def vote_winners(votes: DataFrame) -> DataFrame:
    """ipa, grapheme, grapheme_langs, langs, base_grapheme."""
    based = votes.withColumn("base", base_letter(F.col("grapheme")))
    exact = based.groupBy("ipa").agg(_winner(based, "grapheme", F.col("base")).alias("grapheme"), F.max("votes").alias("grapheme_langs"), F.sum("votes").alias("langs"))
    collapsed = base_votes(votes)
    by_base = collapsed.groupBy("ipa").agg(_winner(collapsed, "base", F.col("base")).alias("base_grapheme"))
    return exact.join(by_base, "ipa")


def base_votes(votes: DataFrame) -> DataFrame:
    """ipa, base, votes: votes collapsed by base letter."""
    return votes.withColumn("base", base_letter(F.col("grapheme"))).groupBy("ipa", "base").agg(F.sum("votes").alias("votes"))


def single_phoneme(sound: Column) -> Column:
    """`is_single_phoneme` as an expression."""
    letters = F.regexp_replace(tie_affricates(sound), r"[^\p{Ll}\p{Lo}]", "")
    return (F.length(letters) < 2) | letters.rlike(f"^[^{t.VOWELS}]{{2}}$")


def readable(spelling: Column) -> Column:
    return spelling.rlike(f"^(?s:.|[^{t.VOWELS}].*|[{t.VOWELS}]*)$")


def shared_tables(votes: DataFrame) -> DataFrame:
    """ipa, grapheme, direction: the shared spelling, as `plans.charts.shared_from_votes` makes it, of (ipa, grapheme, votes).

    A sound is written with the plain spelling that most languages use; a few are written as
    nothing, and sounds that nothing spells in plain letters are left out.  A spelling is read
    as the sound with most votes of those that it writes.
    """
    sounds = votes.groupBy("ipa").agg(F.sum("votes").alias("langs"))
    usable = votes.filter(F.col("grapheme").rlike("^[a-z]+$") & ~F.col("grapheme").isin(*t.PLACEHOLDERS) & ~F.col("ipa").isin(*t.UNWRITTEN))
    best = usable.groupBy("ipa").agg(_winner(usable, "grapheme", F.col("grapheme")).alias("grapheme")).join(sounds, "ipa")
    # of sounds that are one when tied, that with more votes is written
    order = Window.partitionBy("tied").orderBy(F.col("langs").desc(), "ipa")
    write = best.withColumn("tied", tie_affricates(F.col("ipa"))).withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    write = write.select(F.col("tied").alias("ipa"), "grapheme").unionByName(votes.sparkSession.createDataFrame([(s, "") for s in t.UNWRITTEN], "ipa string, grapheme string"))
    first = Window.partitionBy("grapheme").orderBy(F.col("langs").desc(), "ipa")
    read = best.filter(single_phoneme(F.col("ipa")) & readable(F.col("grapheme"))).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    read = read.select(tie_affricates(F.col("ipa")).alias("ipa"), "grapheme", F.lit("read").alias("direction"))
    return write.withColumn("direction", F.lit("write")).unionByName(read)


def vote_report(winners: DataFrame, top: int = 40, rare: int = 50) -> DataFrame:
    """The sounds with the most agreed spelling, and sounds of one language."""
    best = winners.orderBy(F.col("grapheme_langs").desc(), "ipa").limit(top).select(F.lit("top").alias("part"), "ipa", "grapheme", "grapheme_langs")
    alone = winners.filter("langs = 1").orderBy("ipa").limit(rare).select(F.lit("rare").alias("part"), "ipa", "grapheme", "grapheme_langs")
    return best.unionByName(alone)


def override_counts(merged: DataFrame) -> DataFrame:
    """replaced, n: how many winners a choice replaced, and how many stayed."""
    return merged.groupBy("replaced").agg(F.count(F.lit(1)).alias("n"))


def override(winners: DataFrame, choices: DataFrame) -> DataFrame:
    """Winners with the spellings of (ipa, choice) where these are given and not '?'."""
    chosen = F.when((F.col("choice") != "?") & (F.col("choice") != ""), F.col("choice"))
    return winners.join(choices, "ipa", "left").select("ipa", F.coalesce(chosen, "grapheme").alias("grapheme"), "langs", chosen.isNotNull().alias("replaced"))


# ---------------------------------------------------------------- coverage


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _unread(spec: Spec) -> Callable[[str], int]:
    """How many letters of a word a spec marks as unknown; that it is of keys alone is seen by one match."""
    s, values = Segmenter(spec), "".join([*spec.keys, *spec.sounds.values(), *spec.latin.values(), *spec.marks.values()])
    # atomic, so that the match takes the longest keys as the segmenter does
    some = "|".join(map(re.escape, spec.keys)) if REPLACEMENT not in values else ""
    of_keys = re.compile(f"(?:(?>{some})[{python_class('class')}]*+)*+" if some else "(?!)")

    def count(word: str) -> int:
        word = nfd_str(normalize_str(word, False))
        return 0 if of_keys.fullmatch(word) else sum(u.count(REPLACEMENT) for u in s._units(word))

    return count


def missed(text: Column, specs: list[Spec]) -> Column:
    """How many letters of a text each of the specs, which mark what they don't know, can't read."""

    def method():
        made = [Memo(_unread(s)) for s in specs]

        def run(x: str) -> list[int]:
            x = normalize_str(x)
            words, between = word_pattern().findall(x), x.count(REPLACEMENT)
            return [between + sum(map(m.__getitem__, words)) for m in made]

        return run

    return per_row(method, "array<int>")(text)


def coverage(docs: DataFrame, text: str, spec: Spec, empty: float = 1.0) -> DataFrame:
    """docs with `coverage`: the share of letters that the chart can read; `empty` without letters."""
    marked = Spec(spec.chart, spec.output, "mark", spec.clean, spec.strip_diacritics, spec.fallback)
    n = letters(F.col(text))
    return docs.withColumn("coverage", F.when(n > 0, 1 - missed(F.col(text), [marked])[0] / n).otherwise(F.lit(empty)))


def coverage_by(rows: DataFrame, by: str, text: str, least: int = 8, most: int = 200) -> DataFrame:
    """Mean coverage and number of sentences of moderate length."""
    fit = rows.filter(F.length(text).between(least, most))
    return fit.groupBy(by).agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg("coverage"), 3).alias("coverage"))


def coverage_bucket(col: Column) -> Column:
    return F.when(col >= 0.95, "95+").when(col >= 0.85, "85-95").when(col >= 0.60, "60-85").otherwise("<60")


def coverage_buckets(means: DataFrame) -> DataFrame:
    return means.groupBy(coverage_bucket(F.col("coverage")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def low_coverage(means: DataFrame, by: str, below: float = 0.85) -> DataFrame:
    return means.filter(F.col("coverage") < below).orderBy("coverage", by)


def best_chart(docs: DataFrame, by: str, text: str, codes: list[str], catalog: Catalog | None = None, **options) -> DataFrame:
    """by, chart, coverage: the chart that covers each corpus best; of equals the first code.

    Texts pass through Arrow once for all charts.
    """
    catalog = catalog or bundled()
    specs = [Spec(catalog.load(c), unknown="mark", **options) for c in codes]
    n = letters(F.col(text))
    rows = docs.select(F.col(by), n.alias("n"), missed(F.col(text), specs).alias("m"))
    each = rows.select(by, "n", F.posexplode_outer("m").alias("pos", "missed"))
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), F.col("pos") + 1)
    means = each.filter("pos IS NOT NULL").groupBy(by, code.alias("chart")).agg(F.round(F.avg(F.when(F.col("n") > 0, 1 - F.col("missed") / F.col("n")).otherwise(1.0)), 3).alias("coverage"))
    first = Window.partitionBy(by).orderBy(F.col("coverage").desc(), "chart")
    return means.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def sample_picks(rows: DataFrame, by: str, text: str, least: float = 0.9, k: int = 2, times: str | None = None) -> DataFrame:
    """The sentences that begin among the k best covered of each language, ties to the later text.

    `times` names the column that tells how many places a row takes, as a text does that
    several documents hold; without it each row takes one.
    """
    before = Window.partitionBy(by).orderBy(F.col("coverage").desc(), F.col(text).desc()).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.lit(1) if times is None else F.col(times)).over(before), F.lit(0))
    return rows.filter(F.col("coverage") >= least).withColumn("nth", taken + 1).filter(F.col("nth") <= k)


def uncovered_letters(docs: DataFrame, by: str, text: str, spec: Spec, langs: int = 3, samples: int = 4) -> DataFrame:
    """letter, n, top_langs, words: letters that are in no key of the chart, with languages and sample words.

    Distinct (language, word) pairs are counted before they are taken apart.
    """
    known = "".join(sorted({c for k in spec.keys for c in k}))
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    counted = docs.select(F.col(by).alias("lang"), F.explode_outer(words).alias("word")).filter("word IS NOT NULL").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("lang", "word", "n", F.explode(chars(F.col("word"))).alias("letter")).filter(F.col("letter").rlike(r"\p{L}") & (F.instr(F.lit(known), F.col("letter")) == 0))
    by_lang = each.groupBy("letter", "lang").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("letter").orderBy(F.col("n").desc(), "lang")
    top = by_lang.withColumn("nth", F.row_number().over(rank)).groupBy("letter").agg(F.sum("n").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= langs, F.struct("nth", "lang")))), lambda x: x["lang"])).alias("top_langs"))
    pick = Window.partitionBy("letter").orderBy("word")
    found = each.select("letter", "word").distinct().withColumn("nth", F.row_number().over(pick)).filter(F.col("nth") <= samples)
    return top.join(found.groupBy("letter").agg(F.concat_ws(",", F.array_sort(F.collect_list("word"))).alias("words")), "letter")


# ---------------------------------------------------------------- characters and n-grams


def char_histogram(docs: DataFrame, by: str, text: str) -> DataFrame:
    """Letters of the lower-case text; counted per language by way of distinct words."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    counted = docs.select(F.col(by).alias("lang"), F.explode_outer(words).alias("word")).filter("word IS NOT NULL").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("lang", "n", F.explode(chars(F.col("word"))).alias("char")).groupBy("lang", "char").agg(F.sum("n").alias("n"))


def letter_ngrams(docs: DataFrame, by: str, text: str, n: int, top: int) -> DataFrame:
    """The commonest overlapping runs of n letters of each language; of equals the first by code points."""
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{Nl}\p{No}]{" + str(n) + ",}"), F.lit(0))
    counted = docs.select(F.col(by).alias("lang"), F.explode_outer(runs).alias("run")).filter("run IS NOT NULL").groupBy("lang", "run").agg(F.count(F.lit(1)).alias("n"))
    grams = F.transform(F.sequence(F.lit(1), F.length("run") - (n - 1)), lambda i: F.substr(F.col("run"), i, F.lit(n)))
    sums = counted.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return sums.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= top).drop("nth")


def script_counts(docs: DataFrame, by: str, text: str) -> DataFrame:
    """Characters of each script that is neither Latin nor common, and of all else as null's name `other`."""
    each = docs.select(F.col(by).alias("lang"), F.explode_outer(chars(F.col(text))).alias("c")).filter("c IS NOT NULL").groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("lang", F.coalesce(script_of(F.col("c")), F.lit("other")).alias("script")).agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- proxy fidelity


def proxy_fidelity(docs: DataFrame, by: str, text: str, write=proxy.encode, read=proxy.decode) -> DataFrame:
    """by, sentences, exact, exact_pct, char_pct, non_az: how well the proxy code, or another, reads back."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(by), normalize_text(F.col(text)).alias("want"))
    rows = rows.withColumn("mid", write(F.col("want"))).withColumn("got", read(F.col("mid")))
    a, b = chars(F.col("want")), chars(F.col("got"))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    kept = F.when(F.col("want") == F.col("got"), F.length("want").cast("long")).otherwise(same)
    sums = rows.select(by, (F.col("want") == F.col("got")).cast("long").alias("exact"), kept.alias("kept"), F.greatest(F.length("want"), F.length("got")).cast("long").alias("total"), F.length(F.regexp_replace("mid", r"[^\p{L}]|[a-z]", "")).alias("odd"))
    out = sums.groupBy(by).agg(F.count(F.lit(1)).alias("sentences"), F.sum("exact").alias("exact"), F.sum("kept").alias("kept"), F.sum("total").alias("total"), F.sum("odd").alias("non_az"))
    return out.select(by, "sentences", "exact", F.round(100 * F.col("exact") / F.col("sentences"), 1).alias("exact_pct"), F.when(F.col("total") > 0, F.round(100 * F.col("kept") / F.col("total"), 1)).alias("char_pct"), "non_az")


def fidelity_buckets(fidelity: DataFrame) -> DataFrame:
    p = F.col("exact_pct")
    bucket = F.when(p >= 100, "100").when(p >= 95, "95-100").when(p >= 80, "80-95").when(p >= 50, "50-80").otherwise("<50")
    return fidelity.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exact_pct"), 1).alias("mean"))


def worst_fidelity(fidelity: DataFrame, by: str, k: int = 10) -> DataFrame:
    return fidelity.orderBy("exact_pct", by).limit(k)


# ---------------------------------------------------------------- chart checks


_SEGMENTS = t.CONSONANTS + t.SOUND_VOWELS
_TIED = "|".join(t.TIED_PAIRS)
#: Why a decomposed value is not exactly one sound of the convention: the first pattern that is found tells.
PROBLEMS = (
    ("empty value", "^$"),
    ("ASCII g", "g"),
    ("ligature", f"[{''.join(t.LIGATURES)}]"),
    ("not a segment", f"^[^{_SEGMENTS}]"),
    ("dangling tie", f"^.{t.TIE}$"),
    ("unexpected tie", f"^(?!{_TIED}).{t.TIE}"),
    ("nasal consonant", f"^[{t.CONSONANTS}](?:{t.TIE}.)?{t.NASAL}"),
    ("secondary articulation on a vowel", f"^[{t.SOUND_VOWELS}]{t.NASAL}?[{t.SECONDARY}]"),
    ("more than one sound", f"^(?!(?:{_TIED}|[{_SEGMENTS}]){t.NASAL}?[{t.SECONDARY}]?$)"),
)


def phoneme_problem(value: Column) -> Column:
    """Why a value is not exactly one sound of the convention, or null."""
    plain = F.replace(nfd(F.coalesce(value, F.lit(""))), F.lit("c\u0327"), F.lit("ç"))
    out = F.when(F.coalesce(value, F.lit("")) == "", PROBLEMS[0][0]).when(nfc(value) != value, "not composed")
    for reason, pattern in PROBLEMS[1:]:
        out = out.when(plain.rlike(pattern), reason)
    return out


def convention_issues(spark: SparkSession, catalog: Catalog | None = None, rules: DataFrame | None = None, charts: DataFrame | None = None) -> DataFrame:
    """lang, unit, value, reason: values that are not one sound, vowel sequences as keys, diacritics that are no nasal."""
    rules = grapheme_rules(spark, catalog) if rules is None else rules
    values = rules.select("lang", F.col("grapheme").alias("unit"), F.col("ipa").alias("value"), phoneme_problem(F.col("ipa")).alias("reason")).filter("reason IS NOT NULL")
    runs = rules.filter(F.lower("grapheme").rlike(f"^[{t.WRITTEN_VOWELS}]{{2,}}$")).select("lang", F.col("grapheme").alias("unit"), F.col("ipa").alias("value"), F.lit("vowel sequence").alias("reason"))
    marks = diacritic_rules(spark, catalog, charts).filter(~F.col("ipa").isin("", t.NASAL)).select("lang", F.col("mark").alias("unit"), F.col("ipa").alias("value"), F.lit("diacritic value").alias("reason"))
    return values.unionByName(runs).unionByName(marks)


def chart_issues(spark: SparkSession, catalog: Catalog | None = None, declared: DataFrame | None = None, least: int = 5, rules: DataFrame | None = None, charts: DataFrame | None = None) -> DataFrame:
    """lang, issue, detail: small tables, digits in sounds, sizes against the source's, examples that do not convert."""
    catalog = catalog or bundled()
    rules = grapheme_rules(spark, catalog) if rules is None else rules
    charts = chart_table(spark, catalog) if charts is None else charts
    small = rules.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).select("lang", F.lit("few graphemes").alias("issue"), F.col("n").cast("string").alias("detail"))
    odd = rules.filter(F.col("ipa").rlike("[0-9]")).select("lang", F.lit("suspicious sound").alias("issue"), F.concat_ws("=", "grapheme", "ipa").alias("detail"))
    out = small.unionByName(odd)
    if declared is not None:
        page = F.regexp_extract(F.translate("source", ".", " "), r"(?:^|\s)(\d+)(?:\s|$)", 1)
        sized = charts.select("lang", F.when(page != "", page.cast("int")).alias("page"), F.size("alphabet").alias("got"))
        off = sized.join(declared, "page").filter(F.abs(F.col("num_graphemes") - F.col("got")) > 2)
        out = out.unionByName(off.select("lang", F.lit("alphabet size").alias("issue"), F.concat_ws("/", "got", "num_graphemes").alias("detail")))
    converted = convert_by_language(F.col("word"), F.col("lang"), catalog, unknown="mark")
    examples = chart_examples(spark, catalog, charts).filter(F.instr(converted, REPLACEMENT) > 0).select("lang", F.lit("unmapped example").alias("issue"), F.col("word").alias("detail"))
    return out.unionByName(examples)


def chart_confidence(spark: SparkSession, catalog: Catalog | None = None, charts: DataFrame | None = None) -> DataFrame:
    return (chart_table(spark, catalog) if charts is None else charts).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def cross_matrix(rules: DataFrame, langs: list[str]) -> DataFrame:
    """A row per grapheme, a column per language, and whether their sounds differ."""
    some = rules.filter(F.col("lang").isin(*langs))
    differs = some.groupBy("grapheme").agg((F.countDistinct("ipa") > 1).alias("differs"))
    return some.groupBy("grapheme").pivot("lang", langs).agg(F.first("ipa")).join(differs, "grapheme")


def plain_charts(spark: SparkSession, catalog: Catalog | None = None, declared: DataFrame | None = None, charts: DataFrame | None = None) -> DataFrame:
    """lang: languages declared plain, and those whose alphabet, or else whose keys, are a-z and apostrophes."""
    from ..functions.text import alphabet_is_plain

    units = F.when(F.size("alphabet") > 0, F.col("alphabet")).otherwise(F.map_keys("graphemes"))
    joined = (chart_table(spark, catalog) if charts is None else charts).select("lang", nfd(F.array_join(units, " ")).alias("u"))
    plain = joined.filter(alphabet_is_plain(F.array("u"))).select("lang")
    return plain if declared is None else plain.union(declared.select("lang")).distinct()


def reverse_table(spark: SparkSession, catalog: Catalog | None = None, rules: DataFrame | None = None) -> DataFrame:
    """lang, ipa, grapheme: the unit with which each language writes a sound."""
    rules = grapheme_rules(spark, catalog) if rules is None else rules
    table = chart_table(spark, catalog)
    place = table.select("lang", F.posexplode("alphabet").alias("a", "grapheme")).groupBy("lang", "grapheme").agg(F.min("a").alias("a"))
    latin = table.select("lang", F.posexplode("scripts.latin").alias("b", "grapheme")).groupBy("lang", "grapheme").agg(F.min("b").alias("b"))
    ranked = rules.join(place, ["lang", "grapheme"], "left").join(latin, ["lang", "grapheme"], "left")
    rank = F.struct(F.coalesce("a", F.lit(10**9)).alias("a"), F.when(F.col("a").isNull(), F.coalesce("b", F.lit(10**9))).otherwise(0).alias("b"), F.length("grapheme").alias("l"), F.col("grapheme").alias("g"))
    return ranked.groupBy("lang", F.col("ipa_tied").alias("ipa")).agg(F.min_by("grapheme", rank).alias("grapheme"))


def composed_reachability(spark: SparkSession, catalog: Catalog | None = None, rules: DataFrame | None = None) -> DataFrame:
    """lang, n, reached: marked keys of each chart, and how many of them convert to their own value."""
    keys = (grapheme_rules(spark, catalog) if rules is None else rules).filter(nfd(F.col("grapheme")).rlike(r"[\x{300}-\x{36f}]"))
    sound = convert_by_language(F.col("grapheme"), F.col("lang"), catalog, output="ipa")
    return keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((sound == clean_ipa(F.col("ipa_tied"))).cast("long")).alias("reached"))


def unreachable_letters(spark: SparkSession, attested: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """lang, char: attested letters that are neither a key nor a key with marks that the chart knows."""
    keys = grapheme_rules(spark, catalog).select("lang", F.lower("grapheme").alias("key")).distinct()
    marks = diacritic_rules(spark, catalog).groupBy("lang").agg(F.concat_ws("", F.collect_list("mark")).alias("marks"))
    rows = attested.select("lang", "char", nfd(F.col("char")).alias("d"))
    whole = rows.join(keys, (rows["lang"] == keys["lang"]) & (rows["char"] == keys["key"]), "left_anti").join(marks, "lang", "left")
    left = F.filter(chars(F.expr("substr(d, 2)")), lambda m: F.instr(F.coalesce("marks", F.lit("")), m) == 0)
    based = whole.withColumn("stem", F.substring("d", 1, 1)).withColumn("able", (F.length("d") > 1) & (F.size(left) == 0))
    reachable = based.join(keys.withColumnRenamed("lang", "l2"), (F.col("lang") == F.col("l2")) & (F.col("stem") == F.col("key")) & F.col("able"), "left_anti")
    return reachable.select("lang", "char")


def draft_issues(spark: SparkSession, catalog: Catalog | None = None, rules: DataFrame | None = None, charts: DataFrame | None = None) -> DataFrame:
    """lang, issue, detail: what a drafted chart must not hold.

    Empty or blank keys, values with an ASCII g, diacritics explained in words, and keys that
    no text can match because a later key normalises alike.
    """
    rules = grapheme_rules(spark, catalog) if rules is None else rules
    empty = rules.filter(F.trim("grapheme") == "").select("lang", F.lit("empty key").alias("issue"), F.col("ipa").alias("detail"))
    ascii_g = rules.filter(F.col("ipa").contains("g")).select("lang", F.lit("ASCII g").alias("issue"), F.concat_ws("=", "grapheme", "ipa").alias("detail"))
    prose = diacritic_rules(spark, catalog, charts).filter(F.col("ipa").rlike("[A-Za-z]{3}")).select("lang", F.lit("diacritic in words").alias("issue"), F.concat_ws("=", "mark", "ipa").alias("detail"))
    last = Window.partitionBy("lang", "key_nfd").orderBy(F.col("ord").desc())
    dead = rules.withColumn("nth", F.row_number().over(last)).filter("nth > 1").select("lang", F.lit("dead key").alias("issue"), F.col("grapheme").alias("detail"))
    return empty.unionByName(ascii_g).unionByName(prose).unionByName(dead)


def prose_leaks(rows: DataFrame, before: str, after: str, words: tuple[str, ...]) -> DataFrame:
    """rows with `leaked`: words of a list that are in the output and not in the input."""
    find = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(f"({'|'.join(words)})"), F.lit(0))
    return rows.withColumn("leaked", F.array_except(find(after), find(before)))

"""Chart building: raw pages and spreadsheet cells become chart rows.

Cells are a relation (sheet, r, c, v); grids are read by joining a cell with those above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.text import java_ranges, nfc, norm_ipa, slug

PROTECTED = ("hand-verified", "tts-reviewed")
_BRACKETED = r"^\[(.*)\]$"


def decode_mark(mark: Column) -> Column:
    """U+0301 as its character, other marks as they are; null for a bad number."""
    code = F.regexp_extract(mark, r"^U\+([0-9A-Fa-f]{1,6})$", 1)
    char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when(~mark.startswith("U+"), mark).when(code != "", char)


def page_code(pages: DataFrame) -> DataFrame:
    """pages with `code`: the ISO code, else a slug of the name."""
    iso = F.lower(F.trim(F.coalesce("iso639_3", "iso", F.lit(""))))
    return pages.withColumn("code", F.when(iso != "", iso).otherwise(slug(F.coalesce("language", "name", F.lit("")))))


def rule_rows(pages: DataFrame) -> DataFrame:
    """code, ord, grapheme, ipa: of equal graphemes the first; pages that are no charts give none."""
    real = page_code(pages).filter(F.coalesce("is_language_page", "is_language_chart", F.lit(True)))
    each = real.select("code", F.posexplode("graphemes").alias("ord", "g"))
    each = each.select("code", "ord", F.trim(F.coalesce("g.grapheme", F.lit(""))).alias("grapheme"), norm_ipa(F.trim(F.coalesce("g.phoneme", "g.ipa", F.lit("")))).alias("ipa")).filter("grapheme != '' AND ipa != ''")
    first = Window.partitionBy("code", "grapheme").orderBy("ord")
    return each.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def mark_rows(pages: DataFrame) -> DataFrame:
    """code, mark, ipa: of equal marks the last; marks without a value are left out."""
    each = page_code(pages).select("code", F.posexplode("diacritics").alias("ord", "d"))
    rows = each.select("code", "ord", decode_mark(F.col("d.mark")).alias("mark"), F.col("d.ipa").alias("ipa")).filter("mark IS NOT NULL AND mark != '' AND ipa IS NOT NULL AND ipa != ''")
    return rows.groupBy("code", "mark").agg(F.max_by("ipa", "ord").alias("ipa"))


def romanization_rows(pages: DataFrame) -> DataFrame:
    each = page_code(pages).select("code", F.posexplode("romanization").alias("ord", "r")).select("code", "ord", F.trim("r.native").alias("native"), F.trim("r.latin").alias("latin")).filter("native != '' AND latin != ''")
    return each.groupBy("code", "native").agg(F.min_by("latin", "ord").alias("latin"))


def script_units(pages: DataFrame) -> DataFrame:
    """code, native, latin: the units of each script, sorted."""
    each = page_code(pages).select("code", F.explode("graphemes").alias("g")).filter("g.grapheme IS NOT NULL AND g.grapheme != ''")
    native = F.coalesce(F.col("g.script") == "native", F.lit(False))
    return each.groupBy("code").agg(F.array_sort(F.collect_set(F.when(native, F.col("g.grapheme")))).alias("native"), F.array_sort(F.collect_set(F.when(~native, F.col("g.grapheme")))).alias("latin"))


def merge_sources(charts: DataFrame, force: bool = False) -> DataFrame:
    """code, origin, confidence, payload: of the sources of a code a protected one, else the last by `origin`."""
    protected = F.lit(False) if force else F.col("confidence").isin(*PROTECTED)
    best = Window.partitionBy("code").orderBy(protected.desc(), F.col("origin").desc())
    return charts.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")


def distinct_codes(charts: DataFrame, order: str) -> DataFrame:
    """charts with `final_code`: codes that several share take their country, then a number."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("code"))
    suffixed = charts.withColumn("stem", F.when(shared > 1, F.concat_ws("-", "code", F.when(F.coalesce("country", F.lit("")) != "", slug(F.coalesce("country", F.lit("")))))).otherwise(F.col("code")))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy(order))
    return suffixed.withColumn("final_code", F.when(nth > 1, F.concat_ws("-", "stem", nth.cast("string"))).otherwise(F.col("stem"))).drop("stem")


def registry_rows(charts: DataFrame) -> DataFrame:
    return charts.select("code", "name", "country", "family", "confidence").orderBy("code")


def enrich_registry(registry: DataFrame, metadata: DataFrame) -> DataFrame:
    """registry with metadata columns, joined by name, then by the name before a bracket or slash."""
    key = lambda c: F.lower(F.trim(c))
    short = F.trim(F.regexp_extract("name", r"^([^(/]*)", 1))
    extra = [c for c in metadata.columns if c != "name"]
    first = metadata.select(key(F.col("name")).alias("_k"), F.struct(*extra).alias("_a")).dropDuplicates(["_k"])
    second = first.select(F.col("_k").alias("_k2"), F.col("_a").alias("_b"))
    joined = registry.join(first, key(F.col("name")) == F.col("_k"), "left").join(second, key(short) == F.col("_k2"), "left")
    found = F.coalesce("_a", "_b")
    return joined.select(*registry.columns, *[found[c].alias(c) for c in extra])


# ---------------------------------------------------------------- spreadsheets


def triplet_rows(cells: DataFrame) -> DataFrame:
    """sheet, unit, ipa, script, r, c: charts of three-row groups: script, Latin, [sounds].

    A row of sounds has half of its filled cells, at least one, in brackets.
    """
    cells = cells.filter("v IS NOT NULL AND v != ''")
    sounds = cells.groupBy("sheet", "r").agg(F.sum(F.col("v").rlike(_BRACKETED).cast("int")).alias("b"), F.count(F.lit(1)).alias("n")).filter("r >= 2 AND b >= greatest(1, n div 2)").select("sheet", "r")
    ipa = cells.join(sounds, ["sheet", "r"]).select("sheet", "r", "c", F.trim(F.regexp_extract("v", _BRACKETED, 1)).alias("ipa")).filter("ipa != ''")
    above = lambda k, name: cells.select("sheet", (F.col("r") + k).alias("r"), "c", nfc(F.col("v")).alias("unit"), F.lit(name).alias("script"))
    units = above(2, "native").unionByName(above(1, "latin"))
    rows = units.join(ipa, ["sheet", "r", "c"])
    first = Window.partitionBy("sheet", "unit").orderBy("r", "c", F.col("script").desc())
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def triplet_romanization(cells: DataFrame) -> DataFrame:
    """sheet, native, latin of the same groups."""
    rows = triplet_rows_positions(cells)
    first = Window.partitionBy("sheet", "native").orderBy("r", "c")
    return rows.filter("native != latin").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("sheet", "native", "latin")


def triplet_rows_positions(cells: DataFrame) -> DataFrame:
    cells = cells.filter("v IS NOT NULL AND v != ''")
    sounds = cells.groupBy("sheet", "r").agg(F.sum(F.col("v").rlike(_BRACKETED).cast("int")).alias("b"), F.count(F.lit(1)).alias("n")).filter("r >= 2 AND b >= greatest(1, n div 2)").select("sheet", "r")
    ipa = cells.join(sounds, ["sheet", "r"]).filter(F.col("v").rlike(r"^\[\s*\S.*\]$")).select("sheet", "r", "c")
    native = cells.select("sheet", (F.col("r") + 2).alias("r"), "c", nfc(F.col("v")).alias("native"))
    latin = cells.select("sheet", (F.col("r") + 1).alias("r"), "c", nfc(F.col("v")).alias("latin"))
    return ipa.join(native, ["sheet", "r", "c"]).join(latin, ["sheet", "r", "c"])


def _first_sound(v: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(v, r"^\[(.*)\]$", "$1"), "/", 1))


def syllable_rows(cells: DataFrame, script: str = "ethiopic") -> DataFrame:
    """sheet, unit, ipa: consonant by vowel grids.

    The head row has most cells in brackets: its sounds are vowels by column.  Below it a row
    of syllables stands over a row whose cell left of each block of seven holds the
    consonant's sound; a syllable's sound is both together.
    """
    cells = cells.filter("v IS NOT NULL AND v != ''")
    counts = cells.groupBy("sheet", "r").agg(F.sum(F.col("v").rlike(_BRACKETED).cast("int")).alias("b"))
    head = counts.groupBy("sheet").agg(F.max_by("r", F.struct("b", (-F.col("r")).alias("early"))).alias("head"))
    inked = cells.join(head, "sheet")
    vowels = inked.filter((F.col("r") == F.col("head")) & F.col("v").rlike(_BRACKETED)).select("sheet", "c", _first_sound(F.col("v")).alias("vowel"))
    vowels = vowels.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy("c")))
    ranges = java_ranges(t.SCRIPTS[script])
    tops = inked.filter((F.col("r") > F.col("head")) & F.col("v").rlike(f"^[{ranges}]")).select("sheet", "r", "c", nfc(F.col("v")).alias("unit")).join(vowels, ["sheet", "c"])
    starts = vowels.select("sheet", F.col("place").alias("from"), (F.col("c") - 1).alias("label"))
    labels = inked.filter((F.col("r") > F.col("head")) & F.col("v").rlike(_BRACKETED)).select("sheet", (F.col("r") - 1).alias("r"), F.col("c").alias("label"), _first_sound(F.col("v")).alias("consonant")).join(starts, ["sheet", "label"])
    met = tops.join(labels, ["sheet", "r"]).filter("place >= from AND place < from + 7")
    first = Window.partitionBy("sheet", "unit").orderBy("r", "label", "c")
    return met.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("sheet", "unit", F.concat("consonant", "vowel").alias("ipa"))


def chart_sheets(sheets: DataFrame, keep: tuple[str, ...] = ("alphabet", "consonant", "vowel", "script"), skip: tuple[str, ...] = ("number", "sample", "text")) -> DataFrame:
    """Sheets whose name hints at a chart; where none does, those that no hint excludes; else all."""
    name = F.lower("sheet")
    rated = sheets.withColumn("rate", F.when(name.rlike("|".join(skip)), 0).when(name.rlike("|".join(keep)), 2).otherwise(1))
    return rated.withColumn("best", F.max("rate").over(Window.partitionBy("book"))).filter("rate = best").drop("rate", "best")


# ---------------------------------------------------------------- tables of the shared spelling


def romanisation_rules(chars: DataFrame) -> DataFrame:
    """char, action, spelling of (char, romanised, name_words): what a romaniser's answer becomes.

    `romanised` comes from outside.  Punctuation keeps punctuation; a mark whose answer is a
    word of its own name, or nothing, is dropped; a letter is spelled a-z, at most six.
    """
    answer = F.lower(F.coalesce("romanised", F.lit("")))
    marks = F.regexp_replace(answer, r"""[^,.;:!?'"()\-— ]""", "")
    az = F.regexp_replace(answer, "[^a-z]", "")
    c = F.col("char")
    action = (
        F.when(c.rlike(r"^[\p{P}\p{Z}]"), F.when((marks != "") & (marks != c), "spell").otherwise("none"))
        .when(c.rlike(r"^\p{M}"), F.when((az != "") & ~F.coalesce(F.array_contains("name_words", az), F.lit(False)), "spell").otherwise("drop"))
        .when(az == "", F.when(c.rlike(r"^\p{L}"), "drop").otherwise("none"))
        .when(F.length(az) > 6, "reject")
        .otherwise("spell")
    )
    spelling = F.when(c.rlike(r"^[\p{P}\p{Z}]"), marks).otherwise(az)
    return chars.select("char", action.alias("action"), F.when(action == "spell", spelling).alias("spelling"))


def accepted_spellings(answers: DataFrame, surveyed: DataFrame) -> DataFrame:
    """char, action, spelling of answers for surveyed characters: one to four letters spell, nothing drops."""
    fine = answers.join(surveyed.select("char").distinct(), "char", "left_semi").filter((F.length("char") == 1) & F.col("spelling").rlike("^([a-z]{1,4})?$"))
    return fine.select("char", F.when(F.col("spelling") == "", "drop").otherwise("spell").alias("action"), "spelling")


def first_chart_per_code(charts: DataFrame, order: str) -> DataFrame:
    """lang, iso: of charts that share an ISO code the first."""
    iso = charts.withColumn("iso", F.substring_index("lang", "-", 1))
    best = Window.partitionBy("iso").orderBy(order)
    return iso.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")


def corpus_charts(corpora: DataFrame, charts: DataFrame, order: str) -> DataFrame:
    """Corpora by ISO code with the first chart of that code; corpora without a chart are left out."""
    return corpora.join(first_chart_per_code(charts, order).select(F.col("iso").alias("code"), "lang"), "code")


def uncharted(candidates: DataFrame, charts: DataFrame) -> DataFrame:
    """Candidate languages that no chart covers."""
    return candidates.join(charts.select("lang"), "lang", "left_anti")

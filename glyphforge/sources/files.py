"""File sources and sinks: corpora, versions, raw chart pages, spreadsheet cells, table files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.charts import Spec
from .charts import Catalog, bundled

PAGE = (
    "page int, is_language_page boolean, is_language_chart boolean, language string, iso639_3 string, iso string, name string, slug string, country string, family string, "
    "graphemes array<struct<phoneme:string,grapheme:string,ipa:string,script:string>>, romanization array<struct<native:string,latin:string>>, diacritics array<struct<mark:string,role:string,ipa:string>>, "
    "tones map<string,string>, alphabet array<string>, examples array<struct<word:string,gloss:string>>, num_graphemes int, confidence string, notes string"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """file, text of lines whose third field, after two commas, is the text; the head line and empty texts are left out.

    Fields are cut at the first two commas; quotes mean nothing here.  The reader itself
    skips the line at the start of each file, so a file can be read in any number of splits.
    """
    whole = {"header": True, "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "comment": "\u0000", "enforceSchema": True}
    lines = spark.read.schema("value string").options(**whole).csv(path).select(F.input_file_name().alias("file"), F.split("value", ",", 3).alias("f"))
    return lines.filter("size(f) = 3").select("file", F.trim(F.col("f")[2]).alias("text")).filter("text != ''")


def corpus_index(files: DataFrame) -> DataFrame:
    """file, name, code of files named NAME_abc_v1.csv."""
    base = F.substring_index("file", "/", -1)
    pattern = r"^(.*)_([a-z]{3})_v\d+\.csv$"
    return files.select("file", F.translate(F.regexp_extract(base, pattern, 1), "_", " ").alias("name"), F.regexp_extract(base, pattern, 2).alias("code")).filter("code != ''")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).filter(F.col("has_text") == "true")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages of charts, one JSON object a file."""
    return spark.read.schema(PAGE).json(path, multiLine=True)


def _closed(head: str) -> str:
    """`head` with its open string and brackets closed."""
    stack, quoted, skip = [], False, False
    for c in head:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
    return re.sub(r",\s*$", "", head + '"' * quoted) + "".join(reversed(stack))


def repair_json(text: str) -> str:
    """Drop control characters; a cut-off answer ends with its last complete object, and what stays open is closed.

    An answer without a complete object keeps as much as can be closed.
    """
    text = re.sub(r"[\x00-\x08\x0b-\x1f]", "", text)
    ends = [m.end() for m in re.finditer("}", text)] or range(1, len(text) + 1)
    for head in (text, *(_closed(text[:end]) for end in reversed(ends))):
        try:
            json.loads(head)
            return head
        except ValueError:
            continue
    raise ValueError("no JSON value in the text")


# ---------------------------------------------------------------- table files

_ESCAPED = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
REQUIRED = ("graphemes", "universal_reverse")


def _escape(s: str) -> str:
    for plain, written in _ESCAPED:
        s = s.replace(plain, written)
    return s


def table_lines(lang: str, catalog: Catalog | None = None, magic: str = "tables 1", meta: dict[str, str] | None = None) -> list[str]:
    """The effective tables of a language as sectioned lines: a head line, [section]s, key TAB value or key."""
    from ..functions import tables as t

    catalog = catalog or bundled()
    shared = catalog.shared
    known = lang in catalog.charts
    spec = Spec(catalog.load(lang), output="ipa") if known else None
    passthrough = catalog.is_plain(lang)
    maps = {
        "meta": {"lang": lang, "passthrough": str(int(passthrough)), "ipa": str(int(known)), **(meta or {})},
        "graphemes": dict(sorted(spec.sounds.items())) if spec else {},
        "diacritics": dict(sorted(spec.marks.items())) if spec else {},
        "source_spelling": {} if passthrough or not known else dict(sorted(catalog.spelling(lang).items())),
        "universal_reverse": dict(sorted(shared.write.items())),
        "fallback_spell": {k: v for k, v in sorted(shared.spell.items()) if len(k) == 1},
        "fallback_drop": sorted(c for c in shared.drop if len(c) == 1),
        "fallback_ipa": dict(sorted(t.FALLBACK_SOUNDS.items())),
        "spacing_tone": sorted(t.TONE_BARS),
        "confusables": dict(sorted(t.CONFUSABLES.items())),
        "orthographic_accents": sorted(t.ACCENTS),
        "ligatures": t.LIGATURES,
        "affricate_pairs": [f"{p[0]}\t{p[1]}" for p in t.PAIRS],
        "ascii_punct": dict(sorted(t.ASCII_PUNCTUATION.items())),
        "apostrophes": sorted(set(t.APOSTROPHES)),
        "vowels": sorted(set(t.VOWELS)),
        "vowel_alternatives": dict(sorted(t.SHIFTED_VOWEL_SHARED.items())),
        "aspiration": sorted(t.ASPIRATION),
    }
    out = [magic]
    for section, content in maps.items():
        out.append(f"[{section}]")
        if isinstance(content, dict):
            out += [f"{_escape(k)}\t{_escape(v)}" for k, v in content.items()]
        else:
            out += content if section == "affricate_pairs" else [_escape(k) for k in content]
    return out


def table_rows(spark: SparkSession, langs: list[str], catalog: Catalog | None = None, **more) -> DataFrame:
    """lang, line_no, value."""
    rows = [(lang, i, line) for lang in langs for i, line in enumerate(table_lines(lang, catalog, **more))]
    return spark.createDataFrame(rows, "lang string, line_no int, value string")


def write_tables(rows: DataFrame, path: str) -> None:
    """A folder per language with one text file of its lines in order."""
    rows.repartition("lang").sortWithinPartitions("lang", "line_no").select("lang", "value").write.partitionBy("lang").text(path)


def _unescape(col: Column) -> Column:
    parts = F.regexp_extract_all(col, F.lit(r"\\[\s\S]|[^\\]"), F.lit(0))
    one = lambda p: F.when(p == "\\t", "\t").when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def parse_tables(lines: DataFrame) -> DataFrame:
    """lang, section, key, value of (lang, line_no, value) lines; a set entry has a null value.

    The section of a line is the last head above it.
    """
    above = Window.partitionBy("lang").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("value", r"^\[(.*)\]$", 1)
    rows = lines.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(above)).filter((head == "") & F.col("section").isNotNull() & (F.col("value") != ""))
    fields = F.split("value", "\t", 2)
    return rows.select("lang", "section", _unescape(fields[0]).alias("key"), F.when(F.size(fields) > 1, _unescape(fields[1])).alias("value"))


def check_tables(lines: DataFrame) -> DataFrame:
    """lang, problem: files without a proper head line or without a required section."""
    heads = lines.groupBy("lang").agg(F.min_by("value", "line_no").alias("magic"), F.collect_set(F.when(F.col("value").rlike(r"^\[.*\]$"), F.regexp_replace("value", r"[\[\]]", ""))).alias("sections"))
    bad = heads.filter(~F.col("magic").rlike(r"^\S+ 1$")).select("lang", F.lit("head line").alias("problem"))
    lost = heads.select("lang", F.explode(F.array_except(F.array(*[F.lit(s) for s in REQUIRED]), "sections")).alias("s")).select("lang", F.concat(F.lit("no section "), F.col("s")).alias("problem"))
    return bad.unionByName(lost)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)



"""Checks on drafted charts as they come: JSON texts whose fields may have any type, held as variants.

A wrong type is a row of the result, not a failure of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars, nfd

#: Fields that a chart may have, and what they must be.
FIELDS = {"graphemes": "object", "diacritics": "object", "tones": "object", "romanization": "object", "alphabet": "array", "examples": "array", "scripts": "object"}
#: Words of a description, where a symbol is wanted.
PROSE = r"[A-Za-z]{4,}"


def _kind(v: Column) -> Column:
    """object, array, or the type of a scalar, in lower case; null where the field is missing."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))


def _entries(field: str) -> Column:
    """The entries of an object, as map of variants; empty where the field is none."""
    v = F.col(f"f_{field}")
    return F.when(_kind(v) == "object", F.try_variant_get(v, "$", "map<string,variant>")).otherwise(F.create_map().cast("map<string,variant>"))


def draft_chart_issues(drafts: DataFrame, attested: DataFrame) -> DataFrame:
    """lang, issue, detail for drafts (lang, json) and the letters (lang, char) that texts of the language use.

    Issues: no JSON; no graphemes (then nothing else is checked); a field of another type
    than it must be; a script that is no list; an empty value; an ASCII g in a grapheme's,
    diacritic's or romanisation's value; a diacritic explained in words; a composed key
    whose marks are all diacritics and whose letter is a key, so that it is never needed;
    an attested letter that is neither a key nor a key with diacritics.
    """
    rows = drafts.select("lang", F.try_parse_json("json").alias("v"))
    rows = rows.select("lang", "v", *[F.try_variant_get("v", f"$.{f}", "variant").alias(f"f_{f}") for f in FIELDS])
    rows = rows.select("*", *[_entries(f).alias(f"m_{f}") for f in FIELDS if FIELDS[f] == "object"])
    issue = lambda df, name, detail: df.select("lang", F.lit(name).alias("issue"), detail.alias("detail"))
    nothing = F.lit(None).cast("string")
    wrong = F.coalesce(_kind(F.col("f_graphemes")) != "object", F.lit(False))
    empty = F.col("v").isNull() | (~wrong & (F.size("m_graphemes") == 0))
    out = [issue(rows.filter("v IS NULL"), "no JSON", nothing), issue(rows.filter(F.col("v").isNotNull() & empty), "no graphemes", nothing)]
    full = rows.filter(~empty)
    kinds = F.array(*[F.struct(F.lit(f).alias("f"), _kind(F.col(f"f_{f}")).alias("kind"), F.lit(want).alias("want")) for f, want in FIELDS.items()])
    typed = full.select("lang", F.explode(kinds).alias("k")).filter("k.kind <> k.want AND k.kind <> 'void'")
    out.append(issue(typed, "wrong type", F.concat_ws(" ", "k.f", F.lit("is"), "k.kind")))

    def entries(field: str) -> DataFrame:
        some = full.select("lang", F.explode(f"m_{field}").alias("key", "value"))
        return some.select("lang", "key", "value", F.coalesce(F.try_variant_get("value", "$", "string"), F.lit("")).alias("text"))

    out.append(issue(entries("scripts").filter(F.coalesce(_kind(F.col("value")) != "array", F.lit(True))), "script is no list", F.col("key")))
    pair = F.concat_ws("=", "key", "text")
    keys, marks = entries("graphemes"), entries("diacritics")
    out.append(issue(keys.filter(F.trim("text") == ""), "empty value", F.col("key")))
    for field, part in (("graphemes", keys), ("diacritics", marks), ("romanization", entries("romanization"))):
        out.append(issue(part.filter(F.col("text").contains("g")), "ASCII g", F.concat(F.lit(f"{field}: "), pair)))
    out.append(issue(marks.filter(F.col("text").rlike(PROSE)), "diacritic in words", pair))
    known = full.select("lang", F.transform(F.map_keys("m_graphemes"), F.lower).alias("own"), F.map_keys("m_diacritics").alias("signs"))
    split = keys.select("lang", "key", nfd(F.col("key")).alias("d")).join(known, "lang")
    first, rest = F.substring("d", 1, 1), chars(F.expr("substr(d, 2)"))
    all_signs = F.size(F.array_except(rest, "signs")) == 0
    dead = split.filter((F.length("d") > 1) & all_signs & F.array_contains("own", F.lower(first)))
    out.append(issue(dead, "never needed", F.col("key")))
    seen = attested.select("lang", "char").distinct().select("lang", "char", nfd(F.col("char")).alias("d")).join(known, "lang")
    reached = F.array_contains("own", F.col("char")) | ((F.length("d") > 1) & all_signs & F.array_contains("own", first))
    out.append(issue(seen.filter(~reached), "not reachable", F.col("char")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole

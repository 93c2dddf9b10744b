"""Queries of conversion between spellings, and their SQL.

The SQL works on distinct words by joins and windows over tables made by other SQL (votes,
reverse tables), with its own decomposition; it shares no table with the string functions
but the charts.
"""

from __future__ import annotations

import unicodedata
from importlib.resources import files

from pyspark.sql import functions as F

from .functions import tables as t
from .functions.text import normalize_text, words
from .operators import codeswitch as cs
from .operators import drafts as dr
from .operators import respell as rs
from .operators import segment as sg
from .operators import units as un
from .operators import words as wd
from .plans.charts import UNIVERSAL
from .queries import _ALPHABET, _LATIN, _REVERSE, _RULES, _TABLES, NORMAL, ORACLE_SQL, WORD, alternatives, docs, q, query, spec, values
from .sources import charts as ch

#: Targets of the query that spells every word in many languages.
TARGETS = ("acz", "ada", "bez", "dyu", "efi", "fon", "god", "ibo", "kea", "kus", "mck", "swh", *[c for c in ch.bundled().languages() if c[0] in "lst"][:8])


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in (table or {"": ""}).items()) + "}"  # no character is empty


def hoisted(sql: str, *more: tuple[str, str]) -> str:
    """A query with the tables that it repeats named once and computed once; `more`: (name, text) of further ones, inner before outer."""
    named: list[tuple[str, str]] = []
    for name, text in (("rules_", _RULES), ("alphabet_", _ALPHABET), ("latin_", _LATIN), ("tables_", _TABLES), ("reverse_", _REVERSE), *more):
        for known, inner in named:
            text = text.replace(f"({inner})", known).replace(inner, known)
        named.append((name, text))
        sql = sql.replace(f"({text})", name).replace(text, name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({x if x.startswith(('SELECT', 'WITH')) else f'SELECT * FROM {x}'})" for n, x in named) + f" SELECT * FROM ({sql})"


_DECOMPOSED = sql_map({chr(p): d for p in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFD", chr(p))) != chr(p)})


def nfd_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: coalesce({_DECOMPOSED}[c], c)), '')"


def sounds_sql(lang: str, words_of: str) -> str:
    """w, i, sound of the distinct words w that a query gives, numbered from 1."""
    s = spec(lang, output="ipa")
    keys = alternatives(s.keys)
    marks = "regexp_extract_all(substr(u, length(key) + 1), '(?s).')"
    clean = lambda x: f"nfc_normalize(regexp_replace({nfd_sql(x)}, '[{t.ACCENTS}]', '', 'g'))"
    usual = sql_map(t.FALLBACK_SOUNDS)
    strange = f"array_to_string(list_filter({marks}, lambda m: {sql_map(s.marks)}[m] IS NULL), '')"
    read = f"array_to_string(list_transform({marks}, lambda m: coalesce({sql_map(s.marks)}[m], '')), '')"
    return f"""SELECT w, i, CASE WHEN key = '' THEN coalesce({usual}[u], u) ELSE {clean(f"coalesce(CASE WHEN strange <> '' THEN {usual}[nfc_normalize(key || strange)] END, {sql_map(s.sounds)}[key]) || read")} END AS sound
        FROM (SELECT *, {strange} AS strange, {read} AS read FROM (SELECT *, regexp_extract(u, '^(?:{keys})') AS key FROM (
            SELECT w, unnest(us) AS u, unnest(range(1, len(us) + 1)) AS i FROM (
                SELECT w, regexp_extract_all({nfd_sql("w")}, '(?:{keys})\\p{{M}}*|[^\\p{{M}}]') AS us FROM ({words_of})))))"""


def letters_sql(source: str, target: str, words_of: str) -> str:
    """w, spelled: the words of a query in another spelling, before the shared spelling's clean-up."""
    shared = target == UNIVERSAL
    shifted = t.SHIFTED_VOWEL_SHARED if shared else t.SHIFTED_VOWEL
    near = lambda v: f"CASE {v} {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in shifted.items())} WHEN 'o' THEN 'u' WHEN 'ɔ' THEN 'u' ELSE 'i' END"
    vowel = lambda x: f"(length({x}) > 0 AND position({x} IN {q(t.VOWELS)}) > 0)"
    bare = lambda x: f"regexp_replace({nfd_sql(x)}, '[\\p{{M}}\\p{{Lm}}\\p{{Sk}}]', '', 'g')"
    plain = f"translate(sound, '{t.ASPIRATION}', '')"
    if shared:
        found = "coalesce(w1.grapheme, w2.grapheme, CASE WHEN bare <> sound THEN CASE WHEN bare = '' THEN '' ELSE coalesce(w3.grapheme, w4.grapheme) END END)"
    else:
        found = "coalesce(r1.grapheme, r2.grapheme, w1.grapheme, w2.grapheme)"
    return f"""WITH sounds AS MATERIALIZED (SELECT * FROM ({sounds_sql(source, words_of)})),
        tables AS MATERIALIZED (SELECT ipa, grapheme FROM ({_TABLES}) WHERE direction = 'write'),
        reverse AS MATERIALIZED (SELECT lang, ipa, grapheme FROM ({_REVERSE}) WHERE lang IN ({q(source)}, {q(target)})),
        heard AS (SELECT DISTINCT sound, {plain} AS plain, {bare("sound")} AS bare, {bare(plain)} AS bare_plain FROM sounds),
        found AS MATERIALIZED (SELECT sound, {found} AS letters, o.grapheme AS own FROM heard
            LEFT JOIN (SELECT * FROM reverse WHERE lang = {q(target)}) r1 ON r1.ipa = sound LEFT JOIN (SELECT * FROM reverse WHERE lang = {q(target)}) r2 ON r2.ipa = plain
            LEFT JOIN tables w1 ON w1.ipa = plain LEFT JOIN tables w2 ON w2.ipa = sound LEFT JOIN tables w3 ON w3.ipa = bare LEFT JOIN tables w4 ON w4.ipa = bare_plain
            LEFT JOIN (SELECT * FROM reverse WHERE lang = {q(source)}) o ON o.ipa = sound),
        u AS (SELECT w, i, sound, CASE WHEN letters IS NOT NULL AND own IS DISTINCT FROM letters AND length(letters) > 1 AND {vowel("substr(letters, 1, 1)")} AND replace(letters, substr(letters, 1, 1), '') = ''
            THEN {near("substr(letters, 1, 1)")} || substr(letters, 1, 1) ELSE coalesce(letters, sound) END AS letters FROM sounds JOIN found USING (sound)),
        r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY i) AS run FROM (SELECT *, coalesce(letters = lag(letters) OVER (PARTITION BY w ORDER BY i), FALSE) AS same FROM u)),
        m AS (SELECT *, same AND sound <> first_value(sound) OVER (PARTITION BY w, run ORDER BY i) AND {vowel("substr(letters, 1, 1)")} AS meets FROM r),
        o AS (SELECT w, i, letters, coalesce(lead(meets) OVER (PARTITION BY w ORDER BY i), FALSE) AND {vowel("substr(letters, -1)")} AS changed FROM m)
        SELECT w, string_agg(CASE WHEN changed THEN left(letters, length(letters) - 1) || {near("substr(letters, -1)")} ELSE letters END, '' ORDER BY i) AS spelled FROM o GROUP BY w"""


def text_sql(pairs: str, source: str = "documents", text: str = NORMAL) -> str:
    """doc_id, s: texts with their words replaced as `pairs` (w, spelled) says."""
    return f"""SELECT doc_id, string_agg(coalesce(spelled, p), '' ORDER BY i) AS s FROM (
        SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_extract_all({text}, '(?s){WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS ps FROM {source}))
        LEFT JOIN ({pairs}) ON w = p GROUP BY doc_id"""


_ALL_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all({NORMAL}, '{WORD}')) AS w FROM documents"


def ascii_sql(x: str) -> str:
    """What is left outside ASCII: punctuation by its table, letters by their base or `ss`."""
    one = f"CASE WHEN unicode(c) < 128 THEN c WHEN c = 'ß' THEN 'ss' ELSE coalesce({sql_map(t.ASCII_PUNCTUATION)}[c], CASE WHEN regexp_matches(c, '\\p{{L}}') THEN strip_accents(c) ELSE '' END) END"
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') THEN array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: {one}), '') ELSE {x} END"


def _shared_sql(source: str) -> str:
    bare = f"translate(s, {q(t.APOSTROPHES)}, '')"
    return hoisted(f"SELECT doc_id, sha256({ascii_sql(bare)}) AS h FROM ({text_sql(letters_sql(source, UNIVERSAL, _ALL_WORDS))})")


ORACLE_SQL["universal_text"] = _shared_sql("dyu")
ORACLE_SQL["universal_passthrough"] = "SELECT doc_id, sha256(" + ascii_sql(f"translate(strip_accents({NORMAL}), {q(t.APOSTROPHES)}, '')") + ") AS h FROM documents"
ORACLE_SQL["cross_language"] = hoisted(f"SELECT doc_id, sha256(s) AS h FROM ({text_sql(letters_sql('dyu', 'kus', _ALL_WORDS))})")
ORACLE_SQL["roundtrip_dyu"] = hoisted(f"SELECT doc_id, sha256(s) AS h FROM ({text_sql(letters_sql('dyu', 'dyu', _ALL_WORDS))})")


def _read_sql(pairs: str) -> str:
    """w, spelled: words of the shared spelling as the sounds it is read with."""
    return f"""SELECT w, string_agg(coalesce(r.ipa, o.s, u), '' ORDER BY i) AS spelled FROM (
            SELECT w, unnest(range(1, len(us) + 1)) AS i, unnest(us) AS u FROM (SELECT w, regexp_extract_all(spelled, (SELECT string_agg(grapheme, '|' ORDER BY length(grapheme) DESC, grapheme) || '|.' FROM ({_TABLES}) WHERE direction = 'read')) AS us FROM ({pairs})))
        LEFT JOIN (SELECT grapheme, ipa FROM ({_TABLES}) WHERE direction = 'read') r ON r.grapheme = u
        LEFT JOIN (SELECT * FROM {values(t.FALLBACK_SOUNDS.items(), "k, s")}) o ON o.k = u GROUP BY w"""


_RAW_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS text FROM documents"
_SPELT = f"SELECT w, {ascii_sql('bare')} AS spelled FROM (SELECT w, translate(spelled, {q(t.APOSTROPHES)}, '') AS bare FROM ({letters_sql('dyu', UNIVERSAL, f'SELECT DISTINCT {NORMAL} AS w FROM ({_RAW_WORDS})')}))"
_HEARD = f"SELECT a.text AS w, b.spelled FROM (SELECT text, {NORMAL} AS n FROM ({_RAW_WORDS})) a JOIN ({_read_sql(_SPELT)}) b ON b.w = a.n"
ORACLE_SQL["universal_ipa"] = hoisted(f"SELECT doc_id, sha256(s) AS h FROM ({text_sql(_HEARD, text='text')})")


def _sounded_sql(lang: str) -> str:
    return f"SELECT w, string_agg(sound, '' ORDER BY i) AS spelled FROM ({sounds_sql(lang, _ALL_WORDS)}) GROUP BY w"


ORACLE_SQL["convert_by_language"] = " UNION ALL ".join(
    f"SELECT doc_id, sha256(s) AS h FROM ({text_sql(_sounded_sql(chart), f'(SELECT * FROM documents WHERE lang = {q(lang)})')})" for lang, chart in (("en", "dyu"), ("fr", "kea"), ("de", "god"), ("es", "swh"))
) + " UNION ALL SELECT doc_id, NULL FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de', 'es')"


@query("converted_by_words", ORACLE_SQL["grapheme_convert_swh"])
def converted_by_words(spark, sf_dir):
    """Every distinct word converted once, and the texts put together again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return wd.through_words(rows, "text", lambda w: sg.convert(w, spec("swh"), " "), ["doc_id"]).select("doc_id", F.sha2("converted", 256).alias("h"))


_RESPELLED = " UNION ALL ".join(f"SELECT {q(x)} AS target, w, spelled FROM ({letters_sql('dyu', x, _ALL_WORDS)})" for x in TARGETS)


@query("respelled_words", hoisted(f"SELECT w AS word, sha256(string_agg(spelled, ',' ORDER BY target)) AS h, count(*) AS n FROM ({_RESPELLED}) GROUP BY w", ("sounds_", sounds_sql("dyu", _ALL_WORDS))))
def respelled_words(spark, sf_dir):
    """Every distinct word in the spelling of twenty languages at once."""
    seen = docs(spark, sf_dir).select(F.explode(words(normalize_text(F.col("text")))).alias("word")).distinct()
    spelt = rs.respellings(seen, "dyu", list(TARGETS))
    return spelt.select("word", F.sha2(F.array_join("spelled.spelled", ","), 256).alias("h"), F.size("spelled").cast("long").alias("n"))


@query(
    "phoneme_inventory_native",
    f"SELECT lang, sound AS unit, sum(n)::BIGINT AS n FROM ({sounds_sql('kus', _ALL_WORDS)}) JOIN (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all({NORMAL}, '{WORD}')) AS w FROM documents) GROUP BY ALL) USING (w) GROUP BY ALL",
)
def phoneme_inventory_native(spark, sf_dir):
    """How often each sound occurs, by language of the text; words are counted first and cut by JVM expressions."""
    from .functions.text import nfd

    seen = docs(spark, sf_dir).select("lang", F.explode(words(normalize_text(F.col("text")))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    units = seen.select("lang", "n", F.explode(rs.sounds(nfd(F.col("word")), spec("kus", output="ipa"))).alias("unit"))
    return units.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- phrases of a lexicon

#: All runs of two or three words of the benchmark, and its words that begin with a vowel; each stands for itself in brackets.
_PHRASES = """SELECT DISTINCT array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
        SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark)), (SELECT unnest([1, 2, 3]) AS k)
        WHERE i + k - 1 <= len(ws) AND (k > 1 OR regexp_matches(ws[i], '^[aeiou]'))"""


def _benchmark_phrases(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    runs = F.flatten(F.transform("ws", lambda w, i: F.filter(F.transform(F.array(*[F.slice("ws", i + 1, F.lit(k)) for k in (1, 2, 3)]), lambda x: x), lambda x: (F.size(x) > 1) | x[0].rlike("^[aeiou]"))))
    phrases = items.select(F.explode(runs).alias("p")).select(F.array_join("p", " ").alias("phrase")).distinct()
    return phrases.withColumn("ipa", F.concat(F.lit("<"), "phrase", F.lit(">")))


_EDGE = r"[^\p{L}\p{Nl}\p{No}\p{Nd}_]*"
_COVER = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT phrase, '<' || phrase || '>' AS ipa FROM ({_PHRASES})),
    w AS MATERIALIZED (SELECT doc_id, i, regexp_extract(w, '^{_EDGE}') AS lead, w FROM (
        SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))),
    c AS MATERIALIZED (SELECT doc_id, i, lead, regexp_extract(substr(w, length(lead) + 1), '{_EDGE}$') AS trail, substr(w, length(lead) + 1, length(w) - length(lead) - length(regexp_extract(substr(w, length(lead) + 1), '{_EDGE}$'))) AS core FROM w),
    n AS (SELECT *, lower(core) AS a, lead(lower(core), 1) OVER d AS b, lead(lower(core), 2) OVER d AS e, lead(trail, 1) OVER d AS t2, lead(trail, 2) OVER d AS t3 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    m AS MATERIALIZED (SELECT n.*, CASE WHEN x3.ipa IS NOT NULL THEN 3 WHEN x2.ipa IS NOT NULL THEN 2 WHEN x1.ipa IS NOT NULL THEN 1 ELSE 0 END AS k, coalesce(x3.ipa, x2.ipa, x1.ipa) AS ipa FROM n
        LEFT JOIN x x3 ON x3.phrase = a || ' ' || b || ' ' || e LEFT JOIN x x2 ON x2.phrase = a || ' ' || b LEFT JOIN x x1 ON x1.phrase = a),
    s AS MATERIALIZED (SELECT doc_id, i, k, greatest(coalesce(lag(k, 1) OVER d, 0) - 1, coalesce(lag(k, 2) OVER d, 0) - 2) <= 0 AS begins FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    r(doc_id, i, k) AS (
        SELECT doc_id, i, k FROM s WHERE begins
        UNION SELECT s.doc_id, s.i, s.k FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + greatest(r.k, 1) AND NOT s.begins)
    SELECT d.doc_id, sha256(coalesce(g.s, d.text)) AS h FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(lead || coalesce(ipa, CASE WHEN core = '' THEN '' ELSE core || '+' END) || CASE m.k WHEN 3 THEN t3 WHEN 2 THEN t2 ELSE trail END, ' ' ORDER BY i) AS s FROM r JOIN m USING (doc_id, i) GROUP BY doc_id) g USING (doc_id)"""


@query("phrase_cover", _COVER)
def phrase_cover(spark, sf_dir):
    """Phrases of the benchmark amid the documents, longest first, never overlapping; other words marked."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cs.phrase_cover(rows, "text", _benchmark_phrases(spark, sf_dir), lambda c: F.concat(c, F.lit("+")), ["doc_id"]).select("doc_id", F.sha2("converted", 256).alias("h"))


# ---------------------------------------------------------------- the unit relation


def _unit_rows_sql(lang: str) -> str:
    """doc_id, lang and the unit relation; distinct words are cut once."""
    keys = alternatives(spec(lang).keys)
    return f"""WITH p AS (SELECT doc_id, lang, unnest(range(0, len(ps))) AS tok, unnest(ps) AS w FROM (
            SELECT doc_id, lang, regexp_extract_all({NORMAL}, '(?s){WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS ps FROM documents)),
        u AS MATERIALIZED (SELECT w, unnest(range(0, len(us))) AS pos, unnest(us) AS u FROM (SELECT w, regexp_extract_all({nfd_sql("w")}, '(?:{keys})\\p{{M}}*|[^\\p{{M}}]') AS us FROM ({_ALL_WORDS}))),
        c AS (SELECT w, pos, nfc_normalize(u) AS unit, CASE WHEN regexp_matches(u, '^(?:{keys})') THEN regexp_extract(u, '^(?:{keys})') ELSE u END AS base, CASE WHEN regexp_matches(u, '^(?:{keys})') THEN regexp_replace(u, '^(?:{keys})', '') ELSE '' END AS marks, regexp_matches(u, '^(?:{keys})') AS known FROM u)
        SELECT doc_id, lang, tok, pos, TRUE AS is_word, unit, base, marks, known FROM p JOIN c USING (w)
        UNION ALL SELECT doc_id, lang, tok, 0, FALSE, w, NULL, NULL, FALSE FROM p WHERE NOT regexp_matches(w, '^[\\p{{L}}\\p{{Nl}}\\p{{No}}]')"""


_UNIT_SUMS = "lang, is_word, base, marks, known, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(tok)::BIGINT AS toks, sum(pos)::BIGINT AS places, max(sha256(unit)) AS unit"


@query("unit_relation", f"SELECT {_UNIT_SUMS} FROM ({_unit_rows_sql('kus')}) GROUP BY lang, is_word, base, marks, known")
def unit_relation(spark, sf_dir):
    """Every written unit of every document with its place, counted and summed by base and marks."""
    rows = un.unit_relation(docs(spark, sf_dir), "text", spec("kus"), ["doc_id", "lang"])
    by = ["lang", "is_word", "base", "marks", "known"]
    # once for each document and unit; the digest is taken of distinct units
    each = rows.groupBy(*by, "unit", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("toks"), F.sum("pos").alias("places"))
    sums = [F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("toks").alias("toks"), F.sum("places").alias("places"), F.max(F.sha2("unit", 256)).alias("unit")]
    return each.groupBy(*by).agg(*sums)


# ---------------------------------------------------------------- drafted charts

_CHARTS = str(files("glyphforge.assets").joinpath("charts.jsonl"))
_DRAFT_MARKS = values([(c, m, str(v)) for c, chart in ch.bundled().charts.items() for m, v in (chart.get("diacritics") or {}).items()], "lang, mark, ipa")
_DRAFTS = f"""WITH g AS (SELECT lang, grapheme, ipa, lower(grapheme) AS low, {nfd_sql("grapheme")} AS d FROM {_RULES}),
    m AS (SELECT * FROM {_DRAFT_MARKS}),
    s AS (SELECT lang, list(mark) AS signs FROM m GROUP BY lang), k AS (SELECT lang, list(low) AS own FROM g GROUP BY lang),
    a AS (SELECT lang, char, {nfd_sql("char")} AS d FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}')) AS char FROM documents), k),
    split AS (SELECT x.*, coalesce(signs, []) AS signs, own, list_filter(regexp_extract_all(substr(d, 2), '(?s).'), lambda c: NOT list_contains(coalesce(signs, []), c)) AS strange FROM (
        SELECT lang, grapheme AS char, d, 'key' AS kind FROM g UNION ALL SELECT lang, char, d, 'letter' FROM a) x JOIN k USING (lang) LEFT JOIN s USING (lang))
    SELECT lang, 'empty value' AS issue, grapheme AS detail FROM g WHERE trim(ipa) = ''
    UNION ALL SELECT lang, 'ASCII g', 'graphemes: ' || grapheme || '=' || ipa FROM g WHERE contains(ipa, 'g')
    UNION ALL SELECT lang, 'ASCII g', 'diacritics: ' || mark || '=' || ipa FROM m WHERE contains(ipa, 'g')
    UNION ALL SELECT lang, 'diacritic in words', mark || '=' || ipa FROM m WHERE regexp_matches(ipa, '[A-Za-z]{{4,}}')
    UNION ALL SELECT lang, 'never needed', char FROM split WHERE kind = 'key' AND length(d) > 1 AND len(strange) = 0 AND list_contains(own, lower(substr(d, 1, 1)))
    UNION ALL SELECT lang, 'not reachable', char FROM split WHERE kind = 'letter' AND NOT list_contains(own, char) AND NOT (length(d) > 1 AND len(strange) = 0 AND list_contains(own, substr(d, 1, 1)))"""


@query("draft_chart_issues", _DRAFTS)
def draft_chart_issues(spark, sf_dir):
    """Faults of the charts as raw JSON, and letters of the documents that each can't reach."""
    raw = spark.read.text(_CHARTS).select(F.get_json_object("value", "$.code").alias("lang"), F.col("value").alias("json"))
    letters = docs(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}"), F.lit(0)))).alias("char")).distinct()
    codes = F.array(*[F.lit(c) for c in ch.bundled().languages()])
    return dr.draft_chart_issues(raw, letters.select("char", F.explode(codes).alias("lang")))

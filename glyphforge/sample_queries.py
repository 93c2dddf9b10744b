"""Registered queries of the operators that work on charts, pages, cells and side tables, and their SQL.

Charts are looked at through the documents: their rules are those that the documents attest.
Builders and file readers run over the small sample files in `assets/samples` or over rows that
stand here; these are checks, which tests hold against their SQL, and no registered queries.
"""

from __future__ import annotations

import unicodedata
from importlib.resources import files

from pyspark.sql import functions as F

from .functions import tables as t
from .functions import text as tx
from .operators import analytics as an
from .operators import builders as bd
from .operators import codeswitch as cs
from .operators import convert as cv
from .operators import proxy as px
from .operators import segment as sg
from .plans.charts import Spec
from .queries import _ALPHABET, _BUNDLED, _RULES, _WINNERS, NORMAL, WORD, WORDS, _grapheme_sql, check, docs, q, query, seen, seen_charts, seen_rules, unit_sql, values
from .sources import charts as ch
from .sources import files as fl
from .sql import register

ASSETS = files("glyphforge.assets")
SAMPLES = str(ASSETS.joinpath("samples"))
CHART_FILE = str(ASSETS.joinpath("charts.jsonl"))


def chart_sql(columns: str) -> str:
    return f"(SELECT * FROM read_json('{CHART_FILE}', format='newline_delimited', columns={{{columns}}}))"


def here(spark, rows, schema: str):
    return spark.createDataFrame(rows, schema)


def typed(rows, schema: str) -> str:
    """The same rows for SQL."""
    return values(rows, ", ".join(c.split()[0] for c in schema.split(", ")))


# ---------------------------------------------------------------- charts as sources


@seen("load_rules", f"SELECT lang, ord, grapheme, ipa, n FROM {_RULES} WHERE lang IN ('kus', 'swh', 'dyu')")
def load_rules(spark, sf_dir):
    """Rules of three charts in file order, with their occurrences in the documents."""
    return seen_rules(spark, sf_dir).filter(F.col("lang").isin("kus", "swh", "dyu")).select("lang", "ord", "grapheme", "ipa", "n")


@seen("available_languages", f"SELECT code, count(*) AS rules, sum(n)::BIGINT AS n FROM {chart_sql('code: $$VARCHAR$$')} JOIN {_RULES} ON lang = code GROUP BY code".replace("$$", "'"))
def available_languages(spark, sf_dir):
    """Charts whose keys the documents hold, with how many and how often."""
    return seen_rules(spark, sf_dir).groupBy(F.col("lang").alias("code")).agg(F.count(F.lit(1)).alias("rules"), F.sum("n").alias("n"))


_REGISTRY = chart_sql("code: $$VARCHAR$$, name: $$VARCHAR$$, country: $$VARCHAR$$, family: $$VARCHAR$$, confidence: $$VARCHAR$$").replace("$$", "'")


@seen("registry", f"SELECT code, name, country, family, confidence FROM {_REGISTRY} WHERE code IN (SELECT lang FROM {_RULES})")
def registry(spark, sf_dir):
    return bd.registry_rows(seen_charts(spark, sf_dir).withColumnRenamed("lang", "code"))


METADATA = [("Kusaal", "Gur", "kus-1"), ("kele", "Bantu", "kel-1"), ("sample tongue", None, "sam-1")]
NAMES = [("a", "Kusaal"), ("b", "Kele (South)"), ("c", "Sample Tongue/Old"), ("d", "Unknown")]


@check(
    "enrich_registry",
    f"""SELECT r.code, r.name, coalesce(m.family, CASE WHEN m.name IS NULL THEN s.family END) AS family, coalesce(m.glottocode, s.glottocode) AS glottocode FROM {values(NAMES, "code, name").replace("AS v(", "AS r(")}
        LEFT JOIN {typed(METADATA, "name, family, glottocode").replace("AS v(", "AS m(")} ON lower(trim(m.name)) = lower(trim(r.name))
        LEFT JOIN {typed(METADATA, "name, family, glottocode").replace("AS v(", "AS s(")} ON lower(trim(s.name)) = lower(trim(split_part(split_part(r.name, '(', 1), '/', 1)))""",
)
def enrich_registry(spark, sf_dir):
    return bd.enrich_registry(here(spark, NAMES, "code string, name string"), here(spark, METADATA, "name string, family string, glottocode string"))


@seen("declared_plain_charts", f"SELECT lang FROM {_ALPHABET} GROUP BY lang HAVING bool_and(regexp_matches(lower(translate(unit, {q(t.APOSTROPHES)}, '')), '^[a-z]*$')) UNION SELECT unnest(['twi', 'swh'])")
def declared_plain_charts(spark, sf_dir):
    return an.plain_charts(spark, charts=seen_charts(spark, sf_dir), declared=here(spark, [("twi",), ("swh",)], "lang string"))


_CODES = [(c,) for c in _BUNDLED.languages()]


@seen("first_chart_per_code", f"SELECT split_part(lang, '-', 1) AS iso, min(lang) AS lang FROM {_RULES} GROUP BY 1")
def first_chart_per_code(spark, sf_dir):
    return bd.first_chart_per_code(seen_charts(spark, sf_dir).select("lang"), "lang").select("iso", "lang")


ISO = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}
_SPOKEN = f"(SELECT DISTINCT coalesce(MAP {{{', '.join(f'{q(a)}: {q(b)}' for a, b in ISO.items())}}}[lang], lang) AS lang FROM documents WHERE lang IS NOT NULL)"


def spoken(spark, sf_dir):
    """Languages of the documents, by three-letter code."""
    lang = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ISO.items() for x in p]), F.col("lang")), F.col("lang"))
    return docs(spark, sf_dir).filter("lang IS NOT NULL").select(lang.alias("lang")).distinct()


@query("uncharted", f"SELECT lang FROM {_SPOKEN} WHERE lang NOT IN (SELECT lang FROM {values(_CODES, 'lang')})")
def uncharted(spark, sf_dir):
    """Languages of the documents that no chart covers."""
    return bd.uncharted(spoken(spark, sf_dir), here(spark, _CODES, "lang string"))


@query("corpus_charts", f"SELECT c.lang AS code, upper(c.lang) AS name, min(x.lang) AS lang FROM {_SPOKEN} c JOIN {values(_CODES, 'lang').replace('AS v(', 'AS x(')} ON split_part(x.lang, '-', 1) = c.lang GROUP BY ALL")
def corpus_charts(spark, sf_dir):
    """The first chart of each language of the documents that has one."""
    return bd.corpus_charts(spoken(spark, sf_dir).select(F.col("lang").alias("code"), F.upper("lang").alias("name")), here(spark, _CODES, "lang string"), "lang")


_MARKED = f"SELECT lang, count(*) AS n FROM {_RULES} WHERE nfc_normalize(grapheme) <> strip_accents(grapheme) GROUP BY lang"


@query("composed_reachability")
def composed_reachability(spark, sf_dir):
    return an.composed_reachability(spark, rules=seen_rules(spark, sf_dir))


_DRAFT = f"SELECT lang, 'ASCII g' AS issue, concat_ws('=', grapheme, ipa) AS detail FROM {_RULES} WHERE contains(ipa, 'g') UNION ALL SELECT lang, 'empty key', ipa FROM {_RULES} WHERE trim(grapheme) = ''"
_KEYED = f"SELECT lang, grapheme, ord, nfc_normalize(translate(lower(grapheme), {q(''.join(t.CONFUSABLES))}, {q(''.join(t.CONFUSABLES.values()))})) AS key FROM {_RULES}"
_DEAD = f"SELECT lang, 'dead key', grapheme FROM (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY ord DESC) AS nth FROM ({_KEYED})) WHERE nth > 1"
_PROSE = f"SELECT lang, 'diacritic in words', concat_ws('=', mark, ipa) FROM {values([(c, m, v) for c in _BUNDLED.languages() for m, v in (_BUNDLED.charts[c].get('diacritics') or {}).items()], 'lang, mark, ipa')} WHERE lang IN (SELECT lang FROM {_RULES}) AND regexp_matches(ipa, '[A-Za-z]{{3}}')"


@seen("draft_issues", f"{_DRAFT} UNION ALL {_DEAD} UNION ALL {_PROSE}")
def draft_issues(spark, sf_dir):
    rules = seen_rules(spark, sf_dir)
    return an.draft_issues(spark, rules=rules, charts=seen_charts(spark, sf_dir, rules))


_SWH_KEYS = ", ".join(sorted({q(g.lower()) for g in _BUNDLED.charts["swh"]["graphemes"]}))


@query("unreachable_letters", f"SELECT DISTINCT 'swh' AS lang, char FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}')) AS char FROM documents) WHERE char NOT IN ({_SWH_KEYS})")
def unreachable_letters(spark, sf_dir):
    """Letters of the documents that the Swahili chart can't reach, as a key or a key with its marks."""
    letters = docs(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}"), F.lit(0)))).alias("char")).distinct()
    return an.unreachable_letters(spark, letters.select(F.lit("swh").alias("lang"), "char"))


# ---------------------------------------------------------------- scalar operators

_COMPOSED = {chr(p): unicodedata.normalize("NFD", chr(p)) for p in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(p)) != chr(p)}
_CLEANED = {c: unicodedata.normalize("NFC", "".join(x for x in d if x not in t.ACCENTS)) for c, d in _COMPOSED.items()}
_TO_CLEAN = {c: v for c, v in _CLEANED.items() if v != c and len(v) == 1}


@query("clean_accents", f"SELECT doc_id, sha256(translate(text, {q(''.join(_TO_CLEAN))}, {q(''.join(_TO_CLEAN.values()))})) AS h FROM documents")
def clean_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(tx.clean_ipa(F.col("text")), 256).alias("h"))


@seen("bare_sounds", f"SELECT lang, grapheme, regexp_replace(strip_accents(ipa), '[\\p{{Lm}}\\p{{Sk}}\\p{{M}}]', '', 'g') AS bare FROM {_RULES}")
def bare_sounds(spark, sf_dir):
    return seen_rules(spark, sf_dir).select("lang", "grapheme", tx.strip_combining(F.col("ipa")).alias("bare"))


def _replaced(x: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


@query("ascii_punctuation", f"SELECT doc_id, sha256({_replaced('text', t.ASCII_PUNCTUATION)}) AS h FROM documents")
def ascii_punctuation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(tx.ascii_punctuation(F.col("text")), 256).alias("h"))


SPELL, DROP = {"é": "e", "ñ": "ny", "ç": "s", "я": "ya", "ش": "sh", "ሀ": "ha"}, ("°", "ß")


def _fallback_sql(x: str) -> str:
    spelled = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SPELL.items())
    folded = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in t.ASCII_PUNCTUATION.items() if a not in SPELL)
    dropped = " ".join(f"WHEN {q(a)} THEN ''" for a in DROP)
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE CASE c {dropped} {spelled} {folded} ELSE CASE WHEN regexp_matches(c, '\\p{{L}}') THEN c ELSE '' END END END), '')"


@query("fallback_spelling", f"SELECT doc_id, sha256({_fallback_sql('text')}) AS h FROM documents")
def fallback_spelling(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(tx.apply_fallback(F.col("text"), SPELL, DROP), 256).alias("h"))


_NON_LATIN = "[\\x{1200}-\\x{137F}\\x{0600}-\\x{06FF}\\x{0400}-\\x{04FF}\\x{2C80}-\\x{2CFF}]"
_MIXED = "text || ' я и ش ሀ° ⲁ ' || lang"


@query("romanised", f"SELECT doc_id, sha256({_replaced('m', {k: v for k, v in SPELL.items() if ord(k) > 0x400} | {d: '' for d in DROP})}) AS h, len(regexp_extract_all(m, '{_NON_LATIN}'))::INTEGER AS n FROM (SELECT doc_id, {_MIXED} AS m FROM documents)")
def romanised(spark, sf_dir):
    """The documents, each with letters of other scripts after it."""
    mixed = docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" я и ش ሀ° ⲁ "), "lang").alias("m"))
    n = F.size(F.filter(tx.chars(F.col("m")), tx.is_non_latin))
    return mixed.select("doc_id", F.sha2(tx.romanise(F.col("m"), SPELL, DROP), 256).alias("h"), n.alias("n"))


@seen("usable_spellings", f"SELECT lang, grapheme, regexp_full_match(lower(grapheme), '[a-z]+') AND grapheme NOT IN ({', '.join(q(p) for p in t.PLACEHOLDERS)}) AS usable FROM {_RULES}")
def usable_spellings(spark, sf_dir):
    return seen_rules(spark, sf_dir).select("lang", "grapheme", tx.is_usable(F.col("grapheme")).alias("usable"))


_SOUND = "translate(translate(regexp_replace(trim(translate({0}, 'g:''', 'ɡːˈ')), '^[\\[/](.*)[\\]/]$', '\\1'), '[]', ''), " + q("".join(t.SOUND_LOOKALIKES)) + ", " + q("".join(t.SOUND_LOOKALIKES.values())) + ")"


@query("scanned_sounds", f"SELECT sound, count(*) AS n FROM (SELECT {_SOUND.format('w')} AS sound FROM (SELECT '[' || unnest(regexp_extract_all(text, '[^ \\n]+')) || ']' AS w FROM documents)) GROUP BY sound")
def scanned_sounds(spark, sf_dir):
    """Words of the documents in brackets, as sounds are scanned from a page."""
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0))).alias("w")).groupBy("w").count()
    return words.groupBy(tx.norm_ipa(F.concat(F.lit("["), "w", F.lit("]"))).alias("sound")).agg(F.sum("count").alias("n"))


_SLUG = "CASE WHEN len({0}) = 0 THEN 'unknown' ELSE array_to_string({0}, '_') END"


@seen("slugs", f"SELECT code, {_SLUG.format('w')} AS slug FROM (SELECT code, regexp_extract_all(lower(regexp_replace(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g'), '\\([^)]*\\)', '', 'g')), '[a-z0-9]+') AS w FROM {_REGISTRY} WHERE code IN (SELECT lang FROM {_RULES}))")
def slugs(spark, sf_dir):
    return seen_charts(spark, sf_dir).select(F.col("lang").alias("code"), tx.slug(F.col("name")).alias("slug"))


# ---------------------------------------------------------------- segmentation

TINY = {"code": "tiny", "graphemes": {"kp": "kp", "k": "k", "a": "a", "o": "o"}}
ROMAN = {"code": "roman", "graphemes": {"ß": "s", "x": "ks"}, "romanization": {"ß": "ss", "x": "ks"}}


@query("rules_in_memory", f"SELECT doc_id, sha256(replace(array_to_string(list_transform(regexp_extract_all({NORMAL}, '(?s){WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: CASE WHEN regexp_matches(w, '^[\\p{{L}}\\p{{Nl}}\\p{{No}}]') THEN strip_accents(w) ELSE w END), ''), 'kp', 'k͡p')) AS h FROM documents")
def rules_in_memory(spark, sf_dir):
    reader = sg.G2P.from_rules(TINY, fallback=False)
    return docs(spark, sf_dir).select("doc_id", F.sha2(sg.convert(F.col("text"), reader.spec), 256).alias("h"))


@query("latin_units", f"SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all({NORMAL}, '(?s){WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: CASE WHEN regexp_matches(w, '^[\\p{{L}}\\p{{Nl}}\\p{{No}}]') THEN replace(replace(strip_accents(w), 'ß', 'ss'), 'x', 'ks') ELSE w END), '')) AS h FROM documents")
def latin_units(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(sg.convert(F.col("text"), Spec(ROMAN, output="latin", fallback=False)), 256).alias("h"))


_UNITS = "|".join(sorted(t.ENGLISH_UNITS, key=lambda u: (-len(u), u)))


@query(
    "english_sounds",
    f"""SELECT doc_id, sha256(n) AS sounds, sha256(array_to_string(regexp_extract_all(n, '{_UNITS}|[^\\s][\\x{{300}}-\\x{{36f}}]*'), ' ')) AS units
        FROM (SELECT doc_id, replace(replace(replace(replace(replace(translate(text, 'ˈˌ|', ''), 'g', 'ɡ'), 'tʃ', 't͡ʃ'), 'dʒ', 'd͡ʒ'), 'ʧ', 't͡ʃ'), 'ʤ', 'd͡ʒ') AS n FROM documents)""",
)
def english_sounds(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", sg.english_normalise(F.col("text")).alias("sounds"))
    return rows.select("doc_id", F.sha2("sounds", 256).alias("sounds"), F.sha2(F.array_join(sg.english_units(F.col("sounds")), " "), 256).alias("units"))


@query("sql_functions", f"SELECT doc_id, sha256(s) AS units, sha256({NORMAL}) AS plain, sha256({NORMAL}) AS back FROM ({_grapheme_sql('swh', '')}) JOIN documents USING (doc_id)")
def sql_functions(spark, sf_dir):
    register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("glyphforge_documents")
    return spark.sql("SELECT doc_id, sha2(g2p(text, 'swh', 'grapheme'), 256) AS units, sha2(normalize_text(text), 256) AS plain, sha2(from_proxy(to_proxy(normalize_text(text))), 256) AS back FROM glyphforge_documents")


@query("table_function", f"SELECT unit, count(*) AS n FROM ({unit_sql('swh', 'grapheme')}) GROUP BY unit")
def table_function(spark, sf_dir):
    """Units of all texts, by the SQL table function over Arrow batches."""
    register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("glyphforge_documents")
    return spark.sql("SELECT unit, count(*) AS n FROM unit_rows(TABLE(SELECT doc_id, text FROM glyphforge_documents), 'swh') WHERE is_word GROUP BY unit")


PHRASES = {"the": "ðə", "of the": "əvðə", "and the": "ænðə"}


@check("sounds_of_single_words", "SELECT id, out FROM (VALUES (1, 'k͡pako'), (2, 'ɲ i n i'), (3, 'soɡo')) AS v(id, out)")
def sounds_of_single_words(spark, sf_dir):
    """Published readings of single words: whole words, units apart, and the one-shot function."""
    dyu = sg.G2P("dyu", output="ipa")
    return here(spark, [(1, sg.G2P.from_rules(TINY).convert_word("kpako")), (2, dyu.convert("nyini", " ")), (3, sg.g2p("sogo", "dyu", output="ipa"))], "id int, out string")


@check("single_conversions", "SELECT id, out FROM (VALUES (1, 'kuu'), (2, 'doduo'), (3, 'uuo'), (4, ''), (5, 'e')) AS v(id, out)")
def single_conversions(spark, sf_dir):
    """Published cases: passthrough, meeting vowels, and the spelling of single characters."""
    met = lambda sounds: "".join(cv.vary_vowels([({"ɔ": "o"}.get(s, s), s, True) for s in sounds], t.SHIFTED_VOWEL_SHARED))
    shared = ch.Catalog({}, shared=cv.Shared(spell={"é": "e"}, drop=frozenset("°")))
    rows = [(1, cv.convert_lang("kúu", "bez", "universal")), (2, met("dodoɔ")), (3, met("oɔɔ")), (4, cv.universal_fallback("°", shared)), (5, cv.universal_fallback("é", shared))]
    return here(spark, rows, "id int, out string")


# ---------------------------------------------------------------- votes, payloads, leaks

CHOSEN = [("ŋ", "ng"), ("ʔ", "?"), ("ɔ", ""), ("ʃ", "x"), ("u", "w")]
_OVERRIDE = f"SELECT w.ipa, CASE WHEN coalesce(c.choice, '?') IN ('?', '') THEN w.grapheme ELSE c.choice END AS grapheme, w.langs, coalesce(c.choice, '?') NOT IN ('?', '') AS replaced FROM ({_WINNERS}) w LEFT JOIN {values(CHOSEN, 'ipa, choice').replace('AS v(', 'AS c(')} ON c.ipa = w.ipa"


def _override(spark, sf_dir):
    return an.override(an.vote_winners(an.phoneme_votes(seen_rules(spark, sf_dir))), here(spark, CHOSEN, "ipa string, choice string"))


@seen("override_merge", _OVERRIDE)
def override_merge(spark, sf_dir):
    return _override(spark, sf_dir)


@seen("override_counts", f"SELECT replaced, count(*) AS n FROM ({_OVERRIDE}) GROUP BY replaced")
def override_counts(spark, sf_dir):
    return an.override_counts(_override(spark, sf_dir))


FREQUENT = [("ŋ", 9), ("ɔ", 7), ("́", 6), ("ɲ", 5), ("ʔ", 1)]


@check("payloads", "SELECT char, payload FROM (VALUES ('ŋ', 'ng'), ('ɔ', 'o'), ('́', 'q'), ('ɲ', 'nga'), ('ʔ', 'z')) AS v(char, payload)")
def payloads(spark, sf_dir):
    return here(spark, sorted(px.allocate(FREQUENT, {"ŋ": "ng", "ɔ": "o", "ɲ": "ng"}).items()), "char string, payload string")


@query("payload_round_trip", f"SELECT p AS point, 'xzz' || ltrim({' || '.join(f'substr({q(t.ESCAPE_DIGITS)}, ((p // {25**k}) % 25 + 1)::INTEGER, 1)' for k in (4, 3, 2, 1, 0))}, 'a') || 'x' AS code, chr(p::INTEGER) AS back FROM (SELECT DISTINCT unicode(c)::BIGINT AS p FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents)) WHERE p >= 161")
def payload_round_trip(spark, sf_dir):
    """Every character of the documents from U+00A1 on, coded and read back."""
    rows = docs(spark, sf_dir).select(F.explode(F.array_distinct(tx.chars(F.col("text")))).alias("c")).distinct().withColumn("p", F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long"))
    code = px.encode(F.col("c"), decompose=False)
    return rows.filter("p >= 161").select(F.col("p").alias("point"), code.alias("code"), px.decode(code, compose=False).alias("back"))


LEAKED = ("the", "und", "les", "los")
_FOUND = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '{'|'.join(LEAKED)}'))"


@query("prose_leaks", f"SELECT a.conv_id, a.turn, array_to_string(list_sort(list_filter({_FOUND('b.text')}, lambda w: NOT list_contains({_FOUND('a.text')}, w))), ',') AS leaked FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def prose_leaks(spark, sf_dir):
    """Words of a list in the turn after a user's that the user's lacks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    found = an.prose_leaks(turns.filter("role = 'user'").join(after, ["conv_id", "turn"]), "text", "after", LEAKED)
    return found.select("conv_id", "turn", F.array_join(F.array_sort("leaked"), ",").alias("leaked"))


# ---------------------------------------------------------------- files

_FILE_LINES = "SELECT split_part(filename, '/', -1) AS file, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS nth FROM read_text('{0}')"


@check("corpus_files", f"SELECT file, trim(regexp_extract(line, '^[^,]*,[^,]*,(.*)$', 1)) AS text FROM ({_FILE_LINES.format(SAMPLES + '/corpus/*.csv')}) WHERE nth > 1 AND trim(regexp_extract(line, '^[^,]*,[^,]*,(.*)$', 1)) <> ''")
def corpus_files(spark, sf_dir):
    return fl.read_corpus(spark, f"file://{SAMPLES}/corpus/*.csv").select(F.substring_index("file", "/", -1).alias("file"), "text")


@check("corpus_names", f"SELECT DISTINCT replace(regexp_extract(file, '^(.*)_([a-z]{{3}})_v[0-9]+\\.csv$', 1), '_', ' ') AS name, regexp_extract(file, '^(.*)_([a-z]{{3}})_v[0-9]+\\.csv$', 2) AS code FROM ({_FILE_LINES.format(SAMPLES + '/corpus/*.csv')})")
def corpus_names(spark, sf_dir):
    return fl.corpus_index(fl.read_corpus(spark, f"file://{SAMPLES}/corpus/*.csv").select("file").distinct()).select("name", "code")


@check("versions", f"SELECT has_text, lang_code, lang_name FROM read_csv('{SAMPLES}/versions.csv', header=true, all_varchar=true) WHERE has_text = 'true'")
def versions(spark, sf_dir):
    return fl.read_versions(spark, f"file://{SAMPLES}/versions.csv")


@check("lexicon", f"SELECT lower(split_part(line, chr(9), 1)) AS phrase, max_by(split_part(line, chr(9), 2), nth) AS ipa FROM ({_FILE_LINES.format(SAMPLES + '/lexicon.tsv')}) WHERE contains(line, chr(9)) GROUP BY 1")
def lexicon(spark, sf_dir):
    return cs.read_lexicon(spark, f"file://{SAMPLES}/lexicon.tsv")


_PAGES = f"""(SELECT *, CASE WHEN coalesce(trim(coalesce(iso639_3, iso)), '') <> '' THEN lower(trim(coalesce(iso639_3, iso))) ELSE {_SLUG.format("slug")} END AS code FROM (
    SELECT *, regexp_extract_all(lower(regexp_replace(regexp_replace(strip_accents(coalesce(language, name, '')), '[^\\x00-\\x7F]', '', 'g'), '\\([^)]*\\)', '', 'g')), '[a-z0-9]+') AS slug
    FROM read_json('{SAMPLES}/pages/*.json', columns={{page: 'INTEGER', is_language_page: 'BOOLEAN', is_language_chart: 'BOOLEAN', language: 'VARCHAR', iso639_3: 'VARCHAR', iso: 'VARCHAR', name: 'VARCHAR',
        graphemes: 'STRUCT(phoneme VARCHAR, grapheme VARCHAR, ipa VARCHAR, script VARCHAR)[]', romanization: 'STRUCT(native VARCHAR, "latin" VARCHAR)[]', diacritics: 'STRUCT(mark VARCHAR, role VARCHAR, ipa VARCHAR)[]'}})))"""


def _pages(spark):
    return fl.read_pages(spark, f"file://{SAMPLES}/pages/*.json")


_PAGE_SOUND = f"translate(translate(regexp_replace(trim(translate(trim(coalesce(g.phoneme, g.ipa, '')), 'g:''', 'ɡːˈ')), '^[\\[/](.*)[\\]/]$', '\\1'), '[]', ''), {q(''.join(t.SOUND_LOOKALIKES))}, {q(''.join(t.SOUND_LOOKALIKES.values()))})"


@check(
    "page_rules",
    f"""SELECT code, ord, grapheme, ipa FROM (SELECT code, ord, trim(coalesce(g.grapheme, '')) AS grapheme, {_PAGE_SOUND} AS ipa
            FROM (SELECT code, unnest(graphemes) AS g, unnest(range(0, len(graphemes)))::INTEGER AS ord FROM {_PAGES} WHERE coalesce(is_language_page, is_language_chart, TRUE)))
        WHERE grapheme <> '' AND ipa <> '' QUALIFY row_number() OVER (PARTITION BY code, grapheme ORDER BY ord) = 1""",
)
def page_rules(spark, sf_dir):
    return bd.rule_rows(_pages(spark))


@check("page_marks", f"SELECT code, CASE WHEN starts_with(d.mark, 'U+') THEN chr(('0x' || substr(d.mark, 3))::INTEGER) ELSE d.mark END AS mark, d.ipa AS ipa FROM (SELECT code, unnest(diacritics) AS d FROM {_PAGES}) WHERE d.ipa <> '' AND (NOT starts_with(d.mark, 'U+') OR regexp_matches(d.mark, '^U\\+[0-9A-F]+$'))")
def page_marks(spark, sf_dir):
    return bd.mark_rows(_pages(spark))


@check("page_romanisation", f"SELECT code, trim(r.native) AS native, min_by(trim(r.latin), ord) AS \"latin\" FROM (SELECT code, unnest(romanization) AS r, unnest(range(0, len(romanization))) AS ord FROM {_PAGES}) WHERE trim(r.native) <> '' AND trim(r.latin) <> '' GROUP BY ALL")
def page_romanisation(spark, sf_dir):
    return bd.romanization_rows(_pages(spark))


@check(
    "page_scripts",
    f"""SELECT code, coalesce(string_agg(DISTINCT g.grapheme, '|' ORDER BY g.grapheme) FILTER (g.script = 'native'), '') AS native, coalesce(string_agg(DISTINCT g.grapheme, '|' ORDER BY g.grapheme) FILTER (coalesce(g.script, '') <> 'native'), '') AS "latin"
        FROM (SELECT code, unnest(graphemes) AS g FROM {_PAGES}) WHERE g.grapheme <> '' GROUP BY code""",
)
def page_scripts(spark, sf_dir):
    return bd.script_units(_pages(spark)).select("code", F.array_join("native", "|").alias("native"), F.array_join("latin", "|").alias("latin"))


# ---------------------------------------------------------------- builders

ORIGINS = [("aa", 1, "hand-verified", "x"), ("aa", 2, "omniglot", "y"), ("bb", 1, "omniglot", "p"), ("bb", 2, "llm-draft", "q"), ("cc", 3, "tts-reviewed", "r")]
_MERGED = "SELECT code, origin, confidence, payload FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {0} origin DESC) AS nth FROM " + values(ORIGINS, "code, origin, confidence, payload") + ") WHERE nth = 1"


@check("merged_sources", _MERGED.format("confidence IN ('hand-verified', 'tts-reviewed') DESC,") + " UNION ALL " + _MERGED.format(""))
def merged_sources(spark, sf_dir):
    charts = here(spark, ORIGINS, "code string, origin int, confidence string, payload string")
    return bd.merge_sources(charts).unionByName(bd.merge_sources(charts, force=True))


SHARED_CODES = [("abc", "Mali", 1), ("abc", "Mali", 2), ("abc", "Côte d'Ivoire", 3), ("def", "Ghana", 4), ("ghi", None, 5), ("ghi", "", 6)]


@check(
    "distinct_codes",
    f"""SELECT code, country, page, CASE WHEN nth > 1 THEN stem || '-' || nth ELSE stem END AS final_code FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page) AS nth FROM (
        SELECT *, CASE WHEN count(*) OVER (PARTITION BY code) > 1 AND coalesce(country, '') <> '' THEN code || '-' || array_to_string(regexp_extract_all(lower(strip_accents(country)), '[a-z0-9]+'), '_') ELSE code END AS stem FROM {values(SHARED_CODES, "code, country, page")}))""",
)
def distinct_codes(spark, sf_dir):
    return bd.distinct_codes(here(spark, SHARED_CODES, "code string, country string, page int"), "page").select("code", "country", "page", "final_code")


CELLS = [("s", 0, 0, "ب"), ("s", 0, 1, "ش"), ("s", 0, 2, "ه"), ("s", 1, 0, "b"), ("s", 1, 1, "sh"), ("s", 1, 2, "h"), ("s", 2, 0, "[b]"), ("s", 2, 1, "[ʃ]"), ("s", 2, 2, "x"), ("s", 5, 0, "note"), ("u", 0, 0, "a"), ("u", 1, 0, "a"), ("u", 2, 0, "[ ]"), ("u", 2, 1, "text")]
_CELLS = "(SELECT * FROM " + values(CELLS, "sheet, r, c, v") + ")"
_TRIPLETS = f"""SELECT sheet, unit, ipa, script, r, c FROM (SELECT i.sheet, x.v AS unit, i.ipa, CASE WHEN x.r = i.r - 2 THEN 'native' ELSE 'latin' END AS script, i.r, i.c
        FROM (SELECT sheet, r, c, trim(regexp_extract(v, '^\\[(.*)\\]$', 1)) AS ipa FROM {_CELLS} SEMI JOIN (SELECT sheet, r FROM {_CELLS} GROUP BY ALL HAVING r >= 2 AND count(*) FILTER (regexp_matches(v, '^\\[.*\\]$')) >= greatest(1, count(*) // 2)) USING (sheet, r)) i
        JOIN {_CELLS} x ON x.sheet = i.sheet AND x.c = i.c AND x.r IN (i.r - 1, i.r - 2) WHERE i.ipa <> '')
    QUALIFY row_number() OVER (PARTITION BY sheet, unit ORDER BY r, c, script DESC) = 1"""


@check("triplet_rows", _TRIPLETS)
def triplet_rows(spark, sf_dir):
    return bd.triplet_rows(here(spark, CELLS, "sheet string, r int, c int, v string")).select("sheet", "unit", "ipa", "script", "r", "c")


@check("triplet_romanisation", f"SELECT a.sheet, a.unit AS native, b.unit AS \"latin\" FROM ({_TRIPLETS}) a JOIN ({_TRIPLETS}) b ON a.sheet = b.sheet AND a.r = b.r AND a.c = b.c AND a.script = 'native' AND b.script = 'latin' WHERE a.unit <> b.unit")
def triplet_romanisation(spark, sf_dir):
    return bd.triplet_romanization(here(spark, CELLS, "sheet string, r int, c int, v string"))


GRID = [("f", 0, 1, "[a]"), ("f", 0, 2, "[u/o]"), ("f", 0, 3, "[i]"), ("f", 1, 0, "h"), ("f", 1, 1, "ሀ"), ("f", 1, 2, "ሁ"), ("f", 1, 3, "ሂ"), ("f", 2, 0, "[h/x]"), ("f", 3, 1, "ለ"), ("f", 3, 2, "ሉ"), ("f", 3, 3, "ሀ"), ("f", 4, 0, "[l]")]
_GRID = "(SELECT * FROM " + values(GRID, "sheet, r, c, v") + ")"
_FIRST = "trim(split_part(regexp_replace({0}, '^\\[(.*)\\]$', '\\1'), '/', 1))"


@check("syllables", f"SELECT u.sheet, u.v AS unit, {_FIRST.format('k.v')} || {_FIRST.format('h.v')} AS ipa FROM {_GRID} u JOIN {_GRID} h ON h.sheet = u.sheet AND h.r = 0 AND h.c = u.c JOIN {_GRID} k ON k.sheet = u.sheet AND k.r = u.r + 1 AND k.c = 0 WHERE u.r > 0 AND u.c > 0 QUALIFY row_number() OVER (PARTITION BY u.v ORDER BY u.r, u.c) = 1")
def syllables(spark, sf_dir):
    return bd.syllable_rows(here(spark, GRID, "sheet string, r int, c int, v string"))


SHEETS = [("b1", "Alphabet"), ("b1", "Sample text"), ("b1", "Other"), ("b2", "Numbers"), ("b2", "Misc"), ("b3", "Numbers")]


@check("chart_sheets", f"SELECT book, sheet FROM (SELECT *, max(rate) OVER (PARTITION BY book) AS best FROM (SELECT *, CASE WHEN regexp_matches(lower(sheet), 'number|sample|text') THEN 0 WHEN regexp_matches(lower(sheet), 'alphabet|consonant|vowel|script') THEN 2 ELSE 1 END AS rate FROM {values(SHEETS, 'book, sheet')})) WHERE rate = best")
def chart_sheets(spark, sf_dir):
    return bd.chart_sheets(here(spark, SHEETS, "book string, sheet string"))


ANSWERS = [("ሀ", "ha"), ("።", "."), ("́", "acute"), ("̀", "a"), ("ቨ", ""), ("ቩ", "toolongone"), ("፡", "")]


@check("romanisation_rules", "SELECT char, action, spelling FROM (VALUES ('ሀ', 'spell', 'ha'), ('።', 'spell', '.'), ('́', 'drop', NULL), ('̀', 'spell', 'a'), ('ቨ', 'drop', NULL), ('ቩ', 'reject', NULL), ('፡', 'none', NULL)) AS v(char, action, spelling)")
def romanisation_rules(spark, sf_dir):
    chars = here(spark, ANSWERS, "char string, romanised string").withColumn("name_words", F.when(F.col("romanised") == "acute", F.array(F.lit("acute"))).otherwise(F.array().cast("array<string>")))
    return bd.romanisation_rules(chars)


PROPOSED = [("ŋ", "ng"), ("é", "e"), ("ab", "x"), ("ß", "ss"), ("ü", "U"), ("ä", "aeaee"), ("ñ", "ny"), ("—", ""), ("ç", "")]
_SURVEYED = "(SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents)"


@query("accepted_spellings", f"SELECT a.char, CASE WHEN a.spelling = '' THEN 'drop' ELSE 'spell' END AS action, a.spelling FROM {values(PROPOSED, 'char, spelling').replace('AS v(', 'AS a(')} WHERE length(a.char) = 1 AND regexp_full_match(a.spelling, '([a-z]{{1,4}})?') AND a.char IN (SELECT char FROM {_SURVEYED})")
def accepted_spellings(spark, sf_dir):
    """Proposed spellings, of the characters that the documents hold."""
    held = docs(spark, sf_dir).select(F.explode(F.array_distinct(tx.chars(F.col("text")))).alias("char")).distinct()
    return bd.accepted_spellings(here(spark, PROPOSED, "char string, spelling string"), held)

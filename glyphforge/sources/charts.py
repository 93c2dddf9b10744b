"""Chart sources: the bundled charts, or any folder of chart files; and the relations made of them."""

from __future__ import annotations

import warnings
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..assets.charts import CHARTS
from ..functions.text import base_letter, key_str, nfc_str, tie_affricates
from ..plans.charts import LanguageNotFoundError, Shared, is_plain_chart, letter_spellings, shared_from_votes, spelling_of, validate

CHART = (
    "code string, name string, country string, family string, source string, confidence string, graphemes map<string,string>, diacritics map<string,string>, "
    "tones map<string,string>, notes string, alphabet array<string>, examples array<struct<word:string,gloss:string>>, scripts struct<native:array<string>,latin:array<string>>, romanization map<string,string>"
)


class Catalog:
    """Charts by language code. A folder of JSON files is read with Spark, so any store that Spark reads will do."""

    def __init__(self, charts: dict[str, dict] | None = None, plain: tuple[str, ...] = (), shared: Shared | None = None, registry: dict[str, dict] | None = None) -> None:
        self.charts = CHARTS if charts is None else charts
        self.declared_plain = frozenset(plain)
        self._shared, self._registry, self._checked = shared, registry, False
        self._spelling: dict[str, dict[str, str]] = {}

    @classmethod
    def read(cls, spark: SparkSession, folder: str, **more) -> Catalog:
        """From files of one chart each; a chart is some dozens of rows, a folder some hundreds of charts."""
        import json

        rows = spark.read.text(folder, wholetext=True).collect()
        return cls({c["code"]: c for c in (json.loads(r["value"]) for r in rows)}, **more)

    def load(self, code: str) -> dict:
        if code not in self.charts:
            raise LanguageNotFoundError(f"no chart for {code!r}; there are: {', '.join(self.languages()) or 'none'}")
        return validate(self.charts[code])

    def languages(self) -> list[str]:
        return sorted(self.charts)

    def registry(self) -> dict[str, dict]:
        if self._registry is not None:
            return self._registry
        return {c: {k: self.charts[c].get(k) for k in ("code", "name", "country", "family", "confidence")} for c in self.languages()}

    def is_plain(self, code: str) -> bool:
        return code in self.declared_plain or code in self.charts and is_plain_chart(self.charts[code])

    def spelling(self, code: str) -> dict[str, str]:
        if code not in self._spelling:
            self._spelling[code] = spelling_of(self.load(code))
        return self._spelling[code]

    def votes(self) -> dict[str, dict[str, int]]:
        """Sound to spelling to number of languages."""
        out: dict[str, dict[str, int]] = {}
        for chart in self.charts.values():
            for g, sound in chart["graphemes"].items():
                if sound:
                    counts = out.setdefault(sound, {})
                    counts[g] = counts.get(g, 0) + 1
        return out

    @property
    def shared(self) -> Shared:
        """The shared spelling; one that is given is checked once, and a warning tells what it writes outside a-z."""
        if self._shared is None:
            self._shared = shared_from_votes(self.votes())
            self._shared.spell, self._shared.drop = letter_spellings(self.charts, self._shared.write)
        elif not self._checked:
            if odd := universal_non_alphabetic(self._shared):
                warnings.warn(f"the shared spelling writes {len(odd)} sounds outside a-z, such as {next(iter(odd.items()))}", stacklevel=2)
        self._checked = True
        return self._shared


@lru_cache(maxsize=1)
def bundled() -> Catalog:
    return Catalog()


def available_languages(catalog: Catalog | None = None) -> list[str]:
    return (catalog or bundled()).languages()


def registry(catalog: Catalog | None = None) -> dict[str, dict]:
    return (catalog or bundled()).registry()


def load_rules(code: str, catalog: Catalog | None = None) -> dict:
    return (catalog or bundled()).load(code)


# ---------------------------------------------------------------- side tables, one small JSON file each


def _value(spark: SparkSession, path: str):
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_plain(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Codes of languages declared to be written in plain a-z: a JSON array, or an object by code."""
    return tuple(_value(spark, path))


def read_fallback(spark: SparkSession, path: str) -> tuple[dict[str, str], frozenset[str]]:
    """Spellings of letters that no chart covers, and characters to drop."""
    found = _value(spark, path)
    return found.get("spell", {}), frozenset(found.get("drop", []))


def read_payloads(spark: SparkSession, path: str) -> dict[str, str]:
    """Named payloads of the proxy code."""
    return _value(spark, path).get("payloads", {})


def read_votes(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """Votes by sound and spelling of a published survey, for `shared_from_votes`."""
    return {sound: entry["votes"] for sound, entry in _value(spark, path)["phonemes"].items()}


def vote_rows(spark: SparkSession, votes: dict[str, dict[str, int]]) -> DataFrame:
    """The same as (ipa, grapheme, votes) rows."""
    return spark.createDataFrame([(i, g, n) for i, counts in votes.items() for g, n in counts.items()], "ipa string, grapheme string, votes long")


def universal_non_alphabetic(shared: Shared | None = None) -> dict[str, str]:
    """Sounds whose shared spelling is no plain a-z text."""
    import re

    return {s: g for s, g in (shared or bundled().shared).write.items() if g and not re.fullmatch("[a-z]+", g)}


# ---------------------------------------------------------------- relations


def chart_table(spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
    """A row per chart. A grapheme table keeps its order in `ord` of the rule relation, not in the map."""
    catalog = catalog or bundled()
    names = ("code", "name", "country", "family", "source", "confidence", "graphemes", "diacritics", "tones", "notes", "alphabet", "examples", "scripts", "romanization")
    return spark.createDataFrame([tuple(catalog.charts[c].get(n) for n in names) for c in catalog.languages()], CHART).withColumnRenamed("code", "lang")


def keyed_rules(spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
    """`grapheme_rules` with `key`, as it stands in normalised text. Keys are made with the rows, so no UDF has to."""
    catalog = catalog or bundled()
    rows = [(c, i, g, v, (k := key_str(g)), nfc_str(k)) for c in catalog.languages() for i, (g, v) in enumerate(catalog.charts[c]["graphemes"].items())]
    df = spark.createDataFrame(rows, "lang string, ord int, grapheme string, ipa string, key_nfd string, key string")
    return df.select("lang", "ord", "grapheme", "ipa", tie_affricates(F.col("ipa")).alias("ipa_tied"), "key_nfd", "key")


def grapheme_rules(spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
    """lang, ord, grapheme, ipa, ipa_tied, key_nfd: the grapheme tables, in file order."""
    return keyed_rules(spark, catalog).drop("key")


def effective_rules(rules: DataFrame) -> DataFrame:
    """Of keys that normalise alike within a language, the last row."""
    return rules.groupBy("lang", "key_nfd").agg(F.max_by("ipa_tied", "ord").alias("ipa_tied"), F.max("ord").alias("ord"))


def diacritic_rules(spark: SparkSession, catalog: Catalog | None = None, charts: DataFrame | None = None) -> DataFrame:
    return (chart_table(spark, catalog) if charts is None else charts).select("lang", F.explode("diacritics").alias("mark", "ipa"))


def alphabet_units(spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
    return chart_table(spark, catalog).select("lang", F.posexplode("alphabet").alias("pos", "unit"))


def romanization_rules(spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
    return chart_table(spark, catalog).select("lang", F.explode("romanization").alias("native", "latin"))


def chart_examples(spark: SparkSession, catalog: Catalog | None = None, charts: DataFrame | None = None) -> DataFrame:
    return (chart_table(spark, catalog) if charts is None else charts).select("lang", F.explode("examples").alias("e")).select("lang", "e.word", "e.gloss")


def with_base(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("base", base_letter(F.col(column)))

"""Conversion as relations: words to sounds, sounds to letters of many languages at once, letters to words.

Sounds are cut by JVM expressions and resolved by joins, once for each distinct sound; a word stays
one row, in which its letters are put together for all targets.  The string functions of `segment` and `convert` compute the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.text import _lookup, chars, compose, nfd, nfd_str, relax_aspiration, strip_combining
from ..plans.charts import REPLACEMENT, UNIVERSAL, Spec
from ..session import settle
from ..sources.charts import Catalog, bundled
from .analytics import reverse_table
from .convert import vary_vowels
from .words import asked, by_dictionaries, known, no_entries, numbered, own

#: Spellings of sounds, over all targets, that are broadcast at most; more join by a shuffle.
BROADCAST_SOUNDS = 100_000


def _java(keys: list[str]) -> str:
    import re

    return "|".join(re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", k) for k in keys)


def _uncleaned(sound: str) -> str:
    """Decomposed, without the accents that sounds never hold."""
    return "".join(c for c in nfd_str(sound) if c not in t.ACCENTS)


def sounds(word: Column, spec: Spec) -> Column:
    """The sounds of a decomposed word, by JVM expressions: array of strings, as `Segmenter` gives them for output ipa."""
    if spec.output != "ipa":
        raise ValueError("sounds need a spec whose output is ipa")
    ready = _uncleaned if spec.clean else str
    by_key, by_mark = _lookup({k: ready(v) for k, v in spec.sounds.items() if k}), _lookup({m: ready(v) for m, v in spec.marks.items()})
    usual_sounds = t.FALLBACK_SOUNDS if spec.fallback else {}
    fallback, alone = _lookup({nfd_str(k): ready(v) for k, v in usual_sounds.items()}), _lookup(usual_sounds)
    keys = _java(spec.keys)

    def one(unit: Column) -> Column:
        key = F.regexp_extract(unit, f"^(?:{keys})", 0) if keys else F.lit("")
        marks = F.filter(chars(F.substr(unit, F.length(key) + 1)), lambda m: m.isNotNull())
        strange = F.array_join(F.filter(marks, lambda m: F.element_at(by_mark, m).isNull()), "")
        base = F.element_at(by_key, key)
        whole = F.when(strange != "", F.coalesce(F.element_at(fallback, F.concat(key, strange)), base)).otherwise(base)
        read = F.concat(whole, F.array_join(F.transform(marks, lambda m: F.coalesce(F.element_at(by_mark, m), F.lit(""))), ""))
        # characters that are no key: tone bars sound nothing, some letters have a usual sound
        left = {"drop": F.lit(""), "mark": F.lit(REPLACEMENT)}.get(spec.unknown, unit)
        usual = F.coalesce(F.element_at(alone, unit), F.element_at(alone, F.lower(unit)), left)
        silent = unit.isin(*[c for c in t.TONE_BARS if c not in spec.sounds])
        other = F.when(~silent, usual) if spec.fallback else left
        return F.when(key != "", compose(read) if spec.clean else read).otherwise(other)

    units = F.regexp_extract_all(word, F.lit(spec.java), F.lit(0))
    return F.filter(F.transform(units, one), lambda u: u.isNotNull())


def word_sounds(words: DataFrame, spec: Spec, word: str = "word") -> DataFrame:
    """word, pos, sound of distinct normalised words; a word without sounds has one empty sound, as conversion counts it."""
    cut = words.select(word, sounds(nfd(F.col(word)), spec).alias("s"))
    return cut.select(word, F.posexplode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit("")))).alias("pos", "sound"))


def spelling_table(spark, targets: list[str], catalog: Catalog | None = None) -> DataFrame:
    """owner, ipa, letters: how each target and the shared spelling write a sound."""
    catalog = catalog or bundled()
    own = reverse_table(spark, catalog).filter(F.col("lang").isin(*targets)).select(F.col("lang").alias("owner"), "ipa", F.col("grapheme").alias("letters"))
    shared = spark.createDataFrame(list(catalog.shared.write.items()), "ipa string, letters string").select(F.lit(UNIVERSAL).alias("owner"), "ipa", "letters")
    return own.unionByName(shared)


def resolved(heard: DataFrame, targets: list[str], catalog: Catalog | None = None) -> DataFrame:
    """target, sound, letters, place of every distinct sound: where several tables know it, the first by preference.

    A language's own table comes first (the sound, then without its aspiration), then the
    shared one (without, then with); the shared spelling also tries the bare letters of a
    sound.  What no table knows stays as it is, with a null place.
    """
    spark = heard.sparkSession
    plain = relax_aspiration(F.col("sound"))
    known = heard.select("sound").distinct().select("sound", plain.alias("plain"), strip_combining(F.col("sound")).alias("bare"), strip_combining(plain).alias("bare_plain"))
    own, shared = F.array(*[F.lit(x) for x in targets if x != UNIVERSAL]).cast("array<string>"), F.lit(UNIVERSAL)
    every = F.array(*[F.lit(x) for x in targets])
    look = lambda to, place, owner, key, when=F.lit(True): F.struct(to.alias("to"), F.lit(place).alias("place"), owner.alias("owner"), F.when(when, key).alias("key"))
    places = F.array(
        look(own, 0, F.lit(None).cast("string"), F.col("sound")),
        look(own, 1, F.lit(None).cast("string"), F.col("plain")),
        look(every, 2, shared, F.col("plain")),
        look(every, 3, shared, F.col("sound")),
        *([look(F.array(shared), k, shared, F.col(c), F.col("bare") != F.col("sound")) for k, c in ((5, "bare"), (6, "bare_plain"))] if UNIVERSAL in targets else []),
    )
    asked = known.select("sound", F.explode(places).alias("p")).select("sound", F.explode("p.to").alias("target"), "p.place", "p.owner", "p.key").withColumn("owner", F.coalesce("owner", "target"))
    found = asked.join(spelling_table(spark, targets, catalog).withColumnRenamed("ipa", "key"), ["owner", "key"]).select("target", "sound", "place", "letters")
    if UNIVERSAL in targets:  # a sound of marks alone is written as nothing
        nothing = known.filter("bare = '' AND bare <> sound").select(F.lit(UNIVERSAL).alias("target"), "sound", F.lit(4).alias("place"), F.lit("").alias("letters"))
        found = found.unionByName(nothing)
    best = found.groupBy("target", "sound").agg(F.min_by("letters", "place").alias("letters"), F.min("place").alias("place"))
    asked = known.select("sound", F.explode(every).alias("target"))
    return asked.join(best, ["target", "sound"], "left").select("target", "sound", F.coalesce("letters", "sound").alias("letters"), "place")


def _speller(targets: list[str]) -> Callable[[dict[str, str]], Callable[[list[str], dict[str, str]], list[str]]]:
    """For `by_dictionaries`: sounds of a word in the spelling of every target."""
    shifted = [t.SHIFTED_VOWEL_SHARED if x == UNIVERSAL else t.SHIFTED_VOWEL for x in targets]

    def make(shared: dict[str, str]):
        table = {sound: json.loads(row) for sound, row in shared.items()}

        def run(heard: list[str], more: dict[str, str]) -> list[str]:
            rows = [table[s] if s in table else json.loads(more[s]) for s in heard]
            return ["".join(vary_vowels([(r[k]["letters"], s, r[k]["converted"]) for s, r in zip(heard, rows, strict=True)], shifted[k])) for k in range(len(targets))]

        return run

    return make


def respellings(words: DataFrame, source: str, targets: list[str], catalog: Catalog | None = None, word: str = "word", most: int = BROADCAST_SOUNDS) -> DataFrame:
    """word, spelled: array of target and spelled, by target, of each distinct normalised word of a language.

    A word stays one row, whatever the number of its sounds and of targets.  Distinct sounds
    are resolved for all targets by joins; at most `most` letters of them, the most frequent,
    are shared by all workers, and words with other sounds get those from a join.
    """
    catalog, targets = catalog or bundled(), sorted(set(targets))
    spec = Spec(catalog.load(source), output="ipa")
    cut = words.select(word, sounds(nfd(F.col(word)), spec).alias("s"))
    # a word without sounds has one empty sound, as conversion counts it
    cut = numbered(settle(cut.select(word, F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit(""))).alias("s"))), "row_").withColumn("own_", no_entries())
    times = settle(cut.select(F.explode("s").alias("sound")).groupBy("sound").agg(F.count(F.lit(1)).alias("times_")))
    own_table = reverse_table(words.sparkSession, catalog).filter(F.col("lang") == source).select(F.col("ipa").alias("sound"), F.col("grapheme").alias("own"))
    table = resolved(times, targets, catalog).join(own_table, "sound", "left").withColumn("converted", F.col("place").isNotNull() & ~F.col("own").eqNullSafe(F.col("letters")))
    table = table.groupBy("sound").agg(F.to_json(F.array_sort(F.collect_list(F.struct("target", "letters", "converted")))).alias("letters"))
    entries = settle(table.join(times, "sound"))
    often, whole = known(entries, "sound", "letters", max(1, most // len(targets)), 64 * (len(targets) + 1))
    rows = cut
    if not whole:
        rows = own(cut.drop("own_"), asked(cut, "s", lambda: list, "sound", often), entries, "sound", "letters", "own_")
    spelled = by_dictionaries(_speller(targets), often, kind="array<string>")(F.col("s"), F.col("own_"))
    names = F.array(*[F.lit(x) for x in targets])
    return rows.select(word, spelled.alias("l")).select(word, F.zip_with(names, F.col("l"), lambda a, b: F.struct(a.alias("target"), b.alias("spelled"))).alias("spelled"))


def respell(words: DataFrame, source: str, targets: list[str], catalog: Catalog | None = None, word: str = "word", most: int = BROADCAST_SOUNDS) -> DataFrame:
    """target, word, spelled: each distinct normalised word of a language in the spelling of every target.

    Equals `Converter(source, target).convert_word` before the shared spelling's last
    clean-up, for words of Latin letters and a source that is not passed through.
    """
    return respellings(words, source, targets, catalog, word, most).select(word, F.explode("spelled").alias("x")).select("x.target", word, "x.spelled")

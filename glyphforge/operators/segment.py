"""Segmentation of words into written units or sounds, by greedy longest match.

Two strategies share one `Spec`:

* `units_native` keeps grapheme segmentation in the JVM: one regular expression whose
  alternatives stand longest first.
* `segment`, `convert` and `phonemes` are Arrow UDFs around `Segmenter`, which remembers
  the words a worker has seen; running text repeats most of its words.

With a column of language codes, charts of all languages travel in the UDF together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.text import REMEMBERED, Memo, clean_str, nfc_str, nfd_str, normalize_str, over_slices, per_row, rewrite_words, tokenize_str, word_pattern
from ..plans.charts import REPLACEMENT, Spec
from ..sources.charts import Catalog, bundled

def fallback_sound(letter: str) -> str | None:
    """The usual sound of a letter that a chart leaves out."""
    return t.FALLBACK_SOUNDS.get(letter) or t.FALLBACK_SOUNDS.get(letter.lower())


class Segmenter:
    """Units of words in one language."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        self.seen: dict[str, list[str]] = {}
        self.joined: dict[str, Memo] = {}
        self.made = Memo(self._unit)

    def __reduce__(self):
        return Segmenter, (self.spec,)

    def units(self, word: str) -> list[str]:
        """Units of a normalised word."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[word] = self._units(nfd_str(word))
        return found

    def _units(self, text: str) -> list[str]:
        made = self.made
        return [unit for m in self.spec.pattern.findall(text) if (unit := made[m]) is not None]

    def _unit(self, found: tuple[str, str, str]) -> str | None:
        key, marks, other = found
        if not key:
            return self._other(other)
        return self._sound(key, marks) if self.spec.output == "ipa" else self._written(key, marks)

    def _written(self, key: str, marks: str) -> str:
        s = self.spec
        unit = nfc_str(s.latin.get(key, key) + marks)
        return clean_str(unit) if s.output == "grapheme" and s.strip_diacritics else unit

    def _sound(self, key: str, marks: str) -> str:
        s = self.spec
        sound = s.sounds.get(key, key)
        strange = "".join(m for m in marks if m not in s.marks)
        if strange and s.fallback and (whole := fallback_sound(nfc_str(key + strange))) is not None:
            sound = whole  # the letter and its marks are a letter of their own
        unit = sound + "".join(s.marks.get(m, "") for m in marks)
        return clean_str(unit) if s.clean else unit

    def _other(self, char: str) -> str | None:
        """What a character that is no key leaves: None for nothing at all."""
        import unicodedata

        s = self.spec
        helped = s.fallback and s.output == "ipa"
        if helped and char in t.TONE_BARS and char not in s.sounds:
            return None
        if unicodedata.combining(char):
            return None
        if helped and (sound := fallback_sound(char)) is not None:
            return sound
        return {"drop": "", "mark": REPLACEMENT}.get(s.unknown, char)

    def convert(self, text: str, sep: str = "", lower: bool = True) -> str:
        if sep not in self.joined:
            self.joined[sep] = Memo(lambda w: sep.join(self._units(nfd_str(w))))
        return rewrite_words(normalize_str(text, lower), self.joined[sep])

    def convert_word(self, word: str, sep: str = "", lower: bool = True) -> str:
        return sep.join(self.units(normalize_str(word, lower)))

    def phonemes(self, text: str, lower: bool = True, punctuation: bool = True) -> list[str]:
        """All units in a row; punctuation marks are units of their own, blanks and digits are none."""
        import unicodedata

        out: list[str] = []
        for w, is_word in tokenize_str(normalize_str(text, lower)):
            if is_word:
                out += self.units(w)
            elif punctuation:
                out += [c for c in w if unicodedata.category(c)[0] == "P"]
        return out


class G2P(Segmenter):
    """Segmenter of a language by code, for single strings; DataFrames use the column functions below."""

    def __init__(self, code: str, *, catalog: Catalog | None = None, codeswitch: dict[str, str] | None = None, **options) -> None:
        super().__init__(Spec((catalog or bundled()).load(code), **options))
        self.code, self.codeswitch = code, codeswitch

    def __reduce__(self):
        return Segmenter, (self.spec,)

    @classmethod
    def from_rules(cls, chart: dict, **options) -> Segmenter:
        """For a chart in memory; sounds are the default here."""
        return Segmenter(Spec(chart, **{"output": "ipa", **options}))

    def convert(self, text: str, sep: str = "", lower: bool = True) -> str:
        if self.codeswitch and self.spec.output == "ipa":
            from .codeswitch import rewrite

            return rewrite(text, self.codeswitch, lambda w: self.convert_word(w, sep, lower))
        return super().convert(text, sep, lower)


class English:
    """Sounds of English, given from outside, in the charts' conventions.  The chart of letters that is bundled for English is never read with."""

    def __init__(self, output: str = "ipa") -> None:
        if output not in ("ipa", "grapheme"):
            raise ValueError("English has sounds alone")

    def phonemes(self, text: str, lower: bool = True, punctuation: bool = True) -> list[str]:
        return english_units_str(english_normalise_str(text))

    def convert(self, text: str, sep: str = "", lower: bool = True) -> str:
        """Cut into units where `sep` parts them; else as it is, in convention."""
        return sep.join(self.phonemes(text)) if sep else english_normalise_str(text)

    convert_word = convert


def g2p(text: str, lang: str, *, sep: str = "", lower: bool = True, **options) -> str:
    """One string at once.  English text must be sounds, which are brought into convention and cut."""
    if lang in t.ENGLISH_CODES:
        return English(options.get("output", "ipa")).convert(text, sep)
    return G2P(lang, **options).convert(text, sep, lower)


class Pipeline:
    """A language's conversion of a string, a list of strings, or a column."""

    def __init__(self, lang: str, *, catalog: Catalog | None = None, **options) -> None:
        english = lang in t.ENGLISH_CODES
        self.lang, self.g2p = lang, English(options.get("output", "ipa")) if english else G2P(lang, catalog=catalog, **options)
        self.info = (catalog or bundled()).registry().get(lang, {"code": lang})

    def run(self, text, *, sep: str = ""):
        if isinstance(text, Column):
            if isinstance(self.g2p, English):
                sounds = english_normalise(text)
                return F.array_join(english_units(sounds), sep) if sep else sounds
            return convert(text, self.g2p.spec, sep)
        if isinstance(text, (list, tuple)):
            return [self.g2p.convert(x, sep) for x in text]
        return self.g2p.convert(text, sep)

    def __repr__(self) -> str:
        return f"Pipeline(lang={self.lang!r}, name={self.info.get('name', self.lang)!r})"


# ---------------------------------------------------------------- columns


def convert(text: Column, spec: Spec, sep: str = "") -> Column:
    """Words as units joined by `sep`, everything else as it is."""

    def method():
        s = Segmenter(spec)
        return lambda x: s.convert(x, sep)

    return per_row(method, "string")(text)


def phonemes(text: Column, spec: Spec, punctuation: bool = True) -> Column:
    def method():
        s = Segmenter(spec)
        return lambda x: s.phonemes(x, punctuation=punctuation)

    return per_row(method, "array<string>")(text)


def convert_by_language(text: Column, lang: Column, catalog: Catalog | None = None, sep: str = "", **options) -> Column:
    """Each row in the language its code names; null where there is no chart."""
    specs = {code: Spec(chart, **options) for code, chart in (catalog or bundled()).charts.items()}

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        made: dict[str, Segmenter] = {}

        def one(x: str, code: str) -> str | None:
            if code not in specs:
                return None
            if code not in made:
                made[code] = Segmenter(specs[code])
            return made[code].convert(x, sep)

        for texts, codes in batches:
            yield from over_slices(one, "string", texts, codes)

    return run(text, lang)


def words_nfd(text: Column) -> Column:
    """The words of the normalised text, decomposed one by one; one trip through Arrow."""

    def method():
        return lambda x: [nfd_str(w) for w in word_pattern().findall(normalize_str(x))]

    return per_row(method, "array<string>")(text)


def units_native(word: Column, spec: Spec) -> Column:
    """Written units of one decomposed word by JVM expressions, still decomposed; for charts without romanisation."""
    units = F.regexp_extract_all(word, F.lit(spec.java), F.lit(0))
    return units


def unit_inventory(docs, text: str, lang: str, spec: Spec):
    """How often each written unit occurs, by `lang`: JVM segmentation, then one partial aggregation.

    Units are counted decomposed and composed afterwards, once per distinct unit.
    """
    from ..functions.text import nfc

    rows = docs.select(F.col(lang).alias("lang"), words_nfd(F.col(text)).alias("words"))
    # words repeat: count them before they are cut
    counted = rows.select("lang", F.explode_outer("words").alias("word")).filter("word IS NOT NULL").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    units = counted.select("lang", "n", F.explode(units_native(F.col("word"), spec)).alias("u"))
    return units.groupBy("lang", "u").agg(F.sum("n").alias("n")).select("lang", nfc(F.col("u")).alias("unit"), "n").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _counted(docs, text: str, lang: str):
    """lang, word, n: how often each word of the normalised texts occurs, and each punctuation mark between words."""
    import unicodedata

    def method():
        def run(x):
            out = []
            for w, is_word in tokenize_str(normalize_str(x)):
                if is_word:
                    out.append(w)
                else:
                    out += [c for c in w if unicodedata.category(c)[0] == "P"]
            return out

        return run

    rows = docs.select(F.col(lang).alias("lang"), per_row(method, "array<string>")(F.col(text)).alias("words"))
    return rows.select("lang", F.explode_outer("words").alias("word")).filter("word IS NOT NULL").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def phoneme_inventory(docs, text: str, lang: str, spec: Spec):
    """How often each sound or punctuation mark occurs, by `lang`; words repeat, so they are counted before they are cut."""
    units = _counted(docs, text, lang).select("lang", "n", F.explode(phonemes(F.col("word"), spec)).alias("unit"))
    return units.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def english_units(ipa: Column) -> Column:
    """Sounds of English IPA given from outside: units of several characters stay whole, blanks go."""
    from ..functions.text import java_ranges

    some = "|".join(sorted(t.ENGLISH_UNITS, key=lambda u: (-len(u), u)))
    return F.regexp_extract_all(ipa, F.lit(f"{some}|\\S[{java_ranges(((0x300, 0x36F),))}]*"), F.lit(0))


def english_units_str(ipa: str) -> list[str]:
    some = "|".join(sorted(t.ENGLISH_UNITS, key=lambda u: (-len(u), u)))
    return re.findall(f"{some}|\\S[\u0300-\u036f]*", ipa)


def english_normalise_str(raw: str) -> str:
    """`english_normalise` of one string."""
    out = raw.translate(str.maketrans({"g": "ɡ", "ˈ": None, "ˌ": None, "|": None}))
    for a, b in (("tʃ", "t͡ʃ"), ("dʒ", "d͡ʒ"), ("ʧ", "t͡ʃ"), ("ʤ", "d͡ʒ")):
        out = out.replace(a, b)
    return out if raw.strip() else ""


def english_normalise(raw: Column) -> Column:
    """IPA of a speech synthesiser in the charts' conventions."""
    out = F.translate(F.translate(raw, "g", "ɡ"), "ˈˌ|", "")
    for a, b in (("tʃ", "t͡ʃ"), ("dʒ", "d͡ʒ"), ("ʧ", "t͡ʃ"), ("ʤ", "d͡ʒ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.trim(F.regexp_replace(raw, r"(?U)\s", " ")) == "", F.lit("")).otherwise(out)

"""Text normalisation and character predicates, as Column expressions and as plain functions.

Catalyst has no Unicode normaliser, so NFC and NFD are Arrow UDFs; all else here is built
from JVM functions.  The plain functions (lower-case names ending in `_str`) are what the
UDFs and the chart compiler use.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

# ---------------------------------------------------------------- character classes


def _ranges(points) -> str:
    out, start, prev = [], None, None
    for p in points:
        if start is not None and p == prev + 1:
            prev = p
            continue
        if start is not None:
            out.append((start, prev))
        start = prev = p
    if start is not None:
        out.append((start, prev))
    return out


@lru_cache(maxsize=None)
def mark_ranges(by: str) -> tuple[tuple[int, int], ...]:
    """Ranges of marks: `category` Mn and Mc of the BMP from U+0300, or `class` other than 0."""
    if by == "category":
        return tuple(_ranges(p for p in range(0x300, 0x10000) if unicodedata.category(chr(p)) in ("Mn", "Mc")))
    return tuple(_ranges(p for p in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(p))))


@lru_cache(maxsize=None)
def python_class(by: str) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in mark_ranges(by))


@lru_cache(maxsize=None)
def java_class(by: str) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in mark_ranges(by))


def java_ranges(ranges) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


#: Letters as the tokenizer counts them: letters and numbers that are no decimal digits.
_LETTER_PY, _LETTER_JAVA = r"[^\W\d_]", r"[\p{L}\p{Nl}\p{No}]"


@lru_cache(maxsize=None)
def word_pattern() -> re.Pattern:
    """A word: letters, which later marks and apostrophes may join."""
    return re.compile(f"{_LETTER_PY}+(?:['’ʼ{python_class('category')}]{_LETTER_PY}*)*")


@lru_cache(maxsize=None)
def word_java() -> str:
    return f"{_LETTER_JAVA}+(?:['’ʼ{java_class('category')}]{_LETTER_JAVA}*)*"


@lru_cache(maxsize=None)
def piece_pattern() -> re.Pattern:
    """A word, or all that stands between two."""
    return re.compile(f"{word_pattern().pattern}|[\\W\\d_]+")


# ---------------------------------------------------------------- plain functions

_FOLD, _FOLDED = str.maketrans(t.CONFUSABLES), frozenset(t.CONFUSABLES)
_NO_ACCENT = {ord(c): None for c in t.ACCENTS}


def nfc_str(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def nfd_str(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFD", s)


def normalize_str(s: str, lower: bool = True) -> str:
    """Compose, fold look-alikes, lower, compose; in this order, so a look-alike that composes escapes the fold."""
    s = nfc_str(s)
    if not _FOLDED.isdisjoint(set(s)):  # few texts hold a look-alike, and to look for one is cheaper
        s = s.translate(_FOLD)
    return nfc_str(s.lower() if lower else s)


def key_str(s: str) -> str:
    """A chart key as it is matched: lower, folded, decomposed."""
    return nfd_str(str(s).lower().translate(_FOLD))


def clean_str(s: str) -> str:
    return nfc_str(nfd_str(s).translate(_NO_ACCENT))


def tie_str(s: str) -> str:
    """One spelling for affricates: tied. For chart values only, never for running text."""
    for ligature, tied in t.LIGATURES.items():
        s = s.replace(ligature, tied)
    for a, b in t.PAIRS:
        s = re.sub(f"{a}([\u0300-\u0360\u0362-\u036f]*){b}", f"{a}\\1{t.TIE}{b}", s)
    return s


def bare_str(s: str) -> str:
    """The base letters of a sound: without marks, modifier letters and modifier symbols."""
    return "".join(c for c in nfd_str(s) if not unicodedata.combining(c) and unicodedata.category(c) not in ("Lm", "Sk"))


def unmarked_str(s: str) -> str:
    return nfc_str("".join(c for c in nfd_str(s) if not unicodedata.combining(c)))


# ---------------------------------------------------------------- UDF-backed columns


SLICE = 1 << 20  # bytes of an Arrow batch that a worker holds as Python objects at once
REMEMBERED = 100_000
_KINDS = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


class Memo(dict):
    """What a function makes of words, kept until there are too many."""

    def __init__(self, make: Callable, most: int = REMEMBERED) -> None:
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out


def slices(batch: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """A batch in parts of `size` bytes on average."""
    step = max(1, len(batch) * size // max(batch.nbytes, 1))
    return (batch.slice(at, step) for at in range(0, len(batch), step))


def over_slices(f: Callable, kind: str, *batches: pa.Array) -> Iterator[pa.Array]:
    """f of each row, a slice at a time, so that what a worker holds does not grow with a batch; null where an argument is."""
    at = 0
    for part in slices(batches[0]):
        rest = [b.slice(at, len(part)).to_pylist() for b in batches[1:]]
        at += len(part)
        yield pa.array([None if None in r else f(*r) for r in zip(part.to_pylist(), *rest, strict=True)], _KINDS[kind])


def whole(f: Callable, kind: str, *batches: pa.Array) -> pa.Array:
    """`over_slices` of a batch in one array."""
    return pa.concat_arrays([pa.array([], _KINDS[kind]), *over_slices(f, kind, *batches)])


def per_row(make: Callable[[], Callable], kind: str):
    """An Arrow UDF of the function that each worker makes for itself; nulls stay null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            yield from over_slices(f, kind, batch)

    return run


def plain_udf(f: Callable, kind: str = "string"):
    """An Arrow UDF of a function that keeps nothing; calls of several in a row share a worker."""

    @F.arrow_udf(kind)
    def run(batch: pa.Array) -> pa.Array:
        return whole(f, kind, batch)

    return run


@lru_cache(maxsize=None)
def _named(name: str):
    return plain_udf({"nfc": nfc_str, "nfd": nfd_str, "normalize": normalize_str, "normalize_case": lambda s: normalize_str(s, False), "clean": clean_str, "unmarked": unmarked_str, "bare": bare_str, "nfkd": lambda s: s if s.isascii() else unicodedata.normalize("NFKD", s), "base": lambda s: "".join(c for c in nfd_str(s) if not unicodedata.combining(c))}[name])


def nfc(col: Column) -> Column:
    return _named("nfc")(col)


def nfd(col: Column) -> Column:
    return _named("nfd")(col)


def normalize_text(col: Column, lower: bool = True) -> Column:
    return _named("normalize" if lower else "normalize_case")(col)


def normalized(col: Column) -> Column:
    """`normalize_text` of running text, which goes back a slice at a time: a worker holds no second copy of its batch."""
    return per_row(lambda: normalize_str, "string")(col)


def clean_ipa(col: Column) -> Column:
    return _named("clean")(col)


def drop_marks(col: Column) -> Column:
    return _named("unmarked")(col)


def strip_combining(col: Column) -> Column:
    return _named("bare")(col)


def base_letter(col: Column) -> Column:
    return _named("base")(col)


def slug(col: Column) -> Column:
    """Lower-case ASCII words joined by underscores, without what stands in brackets."""
    plain = F.regexp_replace(F.regexp_replace(_named("nfkd")(col), r"[^\x00-\x7F]", ""), r"\([^)]*\)", "")
    words = F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(words, "_")).otherwise(F.when(col.isNotNull(), F.lit("unknown")))


# ---------------------------------------------------------------- native columns


@lru_cache(maxsize=None)
def _compositions() -> dict[str, str]:
    """Letter and mark to the character they compose to, by the canonical decompositions that composition may undo."""
    out = {}
    for p in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(c := chr(p)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.combining(second := chr(int(parts[1], 16))):
            pair = chr(int(parts[0], 16)) + second
            if unicodedata.normalize("NFC", pair) == c:
                out[pair] = c
    return out


@lru_cache(maxsize=None)
def _classes() -> dict[str, int]:
    return {chr(p): unicodedata.combining(chr(p)) for a, b in mark_ranges("class") for p in range(a, b + 1)}


def compose(col: Column) -> Column:
    """NFC of a decomposed string (marks in canonical order) by JVM expressions: a fold over the marks of each letter.

    A mark joins its letter unless one of its class or a higher stands between them.  Letters
    that compose with letters (Hangul) stay apart.
    """
    pairs, classes = _lookup(_compositions()), F.create_map(*[F.lit(x) for p in _classes().items() for x in p])
    mark = java_class("class")

    def join(acc: Column, m: Column) -> Column:
        met, rank = F.element_at(pairs, F.concat(acc["letter"], m)), F.element_at(classes, m)
        free = met.isNotNull() & ((acc["rest"] == "") | (acc["top"] < rank))
        return F.struct(
            F.when(free, met).otherwise(acc["letter"]).alias("letter"), F.when(free, acc["rest"]).otherwise(F.concat(acc["rest"], m)).alias("rest"), F.when(free, acc["top"]).otherwise(rank).alias("top")
        )

    def whole(cluster: Column) -> Column:
        start = F.struct(F.substring(cluster, 1, 1).alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("top"))
        return F.aggregate(chars(F.substr(cluster, F.lit(2))), start, join, lambda a: F.concat(a["letter"], a["rest"]))

    clusters = F.regexp_extract_all(col, F.lit(f"[\\s\\S][{mark}]*"), F.lit(0))
    return F.when(col.rlike(f"[{mark}]"), F.array_join(F.transform(clusters, lambda c: F.when(c.rlike(f"[{mark}]"), whole(c)).otherwise(c)), "")).otherwise(col)


def fold_confusables(col: Column) -> Column:
    return F.translate(col, "".join(t.CONFUSABLES), "".join(t.CONFUSABLES.values()))


def tie_affricates(col: Column) -> Column:
    for ligature, tied in t.LIGATURES.items():
        col = F.replace(col, F.lit(ligature), F.lit(tied))
    for a, b in t.PAIRS:
        col = F.regexp_replace(col, f"{a}([\\x{{300}}-\\x{{360}}\\x{{362}}-\\x{{36f}}]*){b}", f"{a}$1{t.TIE}{b}")
    return col


def relax_aspiration(col: Column) -> Column:
    return F.translate(col, t.ASPIRATION, "")


def strip_apostrophes(col: Column) -> Column:
    return F.translate(col, t.APOSTROPHES, "")


def chars(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def _lookup(table: dict[str, str]) -> Column:
    if not table:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def ascii_punctuation(col: Column) -> Column:
    table = _lookup(t.ASCII_PUNCTUATION)
    return F.array_join(F.transform(chars(col), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def is_non_latin(char: Column) -> Column:
    return char.rlike(f"[{java_ranges(t.NON_LATIN)}]")


def romanise(col: Column, spell: dict[str, str], drop: tuple[str, ...] = ()) -> Column:
    """Characters of non-Latin scripts by the table, dropped characters by nothing, others as they are."""
    table = _lookup(spell)
    one = lambda c: F.when(c.isin(*drop) if drop else F.lit(False), F.lit("")).when(is_non_latin(c), F.coalesce(F.element_at(table, c), c)).otherwise(c)
    return F.array_join(F.transform(chars(col), one), "")


def apply_fallback(col: Column, spell: dict[str, str], drop: tuple[str, ...] = ()) -> Column:
    """Spell what is left outside ASCII; without a table the text stays as it is."""
    if not spell:
        return col
    table, punctuation = _lookup(spell), _lookup(t.ASCII_PUNCTUATION)
    dropped = lambda c: c.isin(*drop) if drop else F.lit(False)
    one = lambda c: (
        F.when(dropped(c), F.lit(""))
        .when(F.ascii(c) < 128, c)
        .otherwise(F.coalesce(F.element_at(table, c), F.element_at(punctuation, c), F.when(c.rlike(r"\p{L}"), c).otherwise(F.lit(""))))
    )
    return F.array_join(F.transform(chars(col), one), "")


def script_of(char: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ranges in reversed(t.SCRIPTS.items()):
        out = F.when(char.rlike(f"^[{java_ranges(ranges)}]"), F.lit(name)).otherwise(out)
    return out


def is_plain_latin(col: Column) -> Column:
    return F.coalesce(F.lower(col).rlike("^[a-z]+$"), F.lit(False))


def is_usable(col: Column) -> Column:
    """A plain spelling that is no placeholder."""
    return is_plain_latin(col) & ~col.isin(*t.PLACEHOLDERS)


def alphabet_is_plain(units: Column) -> Column:
    """Whether an alphabet (array, decomposed) has a letter and none outside a-z, apart from apostrophes and blanks."""
    letters = F.regexp_replace(strip_apostrophes(F.array_join(units, "")), r"\s", "")
    return F.coalesce((F.length(letters) > 0) & F.lower(letters).rlike("^[a-z]+$"), F.lit(False))


def norm_ipa(col: Column) -> Column:
    """Sound values of scanned charts: canonical letters, no brackets or slashes."""
    col = F.translate(col, "g:'", "ɡːˈ")
    col = F.regexp_replace(F.trim(col), r"^[\[/](.*)[\]/]$", "$1")
    return F.translate(F.translate(col, "[]", ""), "".join(t.SOUND_LOOKALIKES), "".join(t.SOUND_LOOKALIKES.values()))


def tokens(col: Column) -> Column:
    """Words and what stands between them, in order and without loss: array of (text, is_word)."""
    word = word_java()
    parts = F.regexp_extract_all(col, F.lit(f"(?:{word})|(?:(?!{_LETTER_JAVA})[\\s\\S])+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), p.rlike(f"^{_LETTER_JAVA}").alias("is_word")))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(word_java()), F.lit(0))


#: What is in no word, but in between when a sigma is told to be final or not.
_PAST_SIGMA = ".:^`"
#: All other ASCII but letters and the apostrophe: it is in no word, and letters beside it normalise as at an end of text.
_BREAK = r"[\x00-&(-\-/-9;-@\[-\]_{-\x7f]+"


def pieces(col: Column) -> Column:
    """A text cut where no word crosses: the words of its pieces, each normalised alone, are those of the whole text normalised."""
    bare = lambda p: F.ltrim(F.rtrim(p, F.lit(_PAST_SIGMA)), F.lit(_PAST_SIGMA + "'"))
    lower = lambda p: F.when(F.octet_length(p) == F.length(p), F.lower(p)).otherwise(p)  # noqa: E731  of ASCII, all there is to do
    return F.transform(F.transform(F.split(col, _BREAK), bare), lower)


def tokenize_str(s: str) -> list[tuple[str, bool]]:
    out, at = [], 0
    for m in word_pattern().finditer(s):
        if m.start() > at:
            out.append((s[at : m.start()], False))
        out.append((m.group(), True))
        at = m.end()
    if at < len(s):
        out.append((s[at:], False))
    return out


def rewrite_words(text: str, write: Memo) -> str:
    """The text with each word as `write` has it."""
    return word_pattern().sub(lambda m: write[m.group()], text)

"""Charts and what a plan compiles from them.

A chart is one JSON object; a `Spec` is its segmentation: a regular expression whose
alternatives stand longest first, so that leftmost-first matching is greedy longest match,
and lookup tables for what was matched.  The same spec feeds JVM expressions and UDFs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from ..functions import tables as t
from ..functions.text import bare_str, java_class, key_str, nfc_str, nfd_str, python_class, tie_str

OUTPUTS = ("ipa", "grapheme", "latin")
UNKNOWN = ("passthrough", "drop", "mark")
REPLACEMENT = "�"
UNIVERSAL, PROXY = "universal", "proxy"


class LanguageNotFoundError(KeyError):
    """No chart for a language."""


def validate(chart: dict) -> dict:
    if not isinstance(chart.get("graphemes"), dict):
        raise ValueError(f"chart {chart.get('code')!r} must hold a 'graphemes' mapping")
    return chart


@dataclass(frozen=True)
class Spec:
    """How one language is segmented for one output."""

    chart: dict
    output: str = "grapheme"
    unknown: str = "passthrough"
    clean: bool = True
    strip_diacritics: bool = False
    fallback: bool = True

    def __post_init__(self) -> None:
        if self.output not in OUTPUTS:
            raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")
        validate(self.chart)

    def __hash__(self) -> int:
        return id(self.chart)

    @cached_property
    def sounds(self) -> dict[str, str]:
        """Key to value; of keys that normalise alike the last wins."""
        return {key_str(g): tie_str(v) if self.output == "ipa" else v for g, v in self.chart["graphemes"].items()}

    @cached_property
    def latin(self) -> dict[str, str]:
        return {key_str(k): v for k, v in (self.chart.get("romanization") or {}).items()}

    @cached_property
    def marks(self) -> dict[str, str]:
        return dict(self.chart.get("diacritics") or {})

    @cached_property
    def keys(self) -> list[str]:
        """What can be matched, longest first. Alphabet units without marks count, but not for sounds."""
        keys = set(self.sounds)
        if self.output != "ipa":
            keys |= set(self.latin)
            bare = (key_str(a) for a in self.chart.get("alphabet") or [])
            keys |= {k for k in bare if not re.search(f"[{python_class('class')}]", k)}
        marks = re.compile(f"[{python_class('class')}]")
        return sorted((k for k in keys if k and not marks.match(k)), key=lambda k: (-len(k), k))

    @cached_property
    def pattern(self) -> re.Pattern:
        """Groups: key, its marks, or any other character."""
        some = "|".join(map(re.escape, self.keys)) or "(?!)"
        return re.compile(f"({some})([{python_class('class')}]*)|([\\s\\S])")

    @property
    def java(self) -> str:
        """Units of a decomposed word: a key with its marks, or one other character that is no mark."""
        mark = java_class("class")
        some = "|".join(re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", k) for k in self.keys)
        return f"(?:{some})[{mark}]*|[^{mark}]" if some else f"[^{mark}]"


@dataclass
class Shared:
    """The shared ("universal") spelling: sound to letters, and letters read back to sounds."""

    write: dict[str, str] = field(default_factory=dict)
    read: dict[str, str] = field(default_factory=dict)
    spell: dict[str, str] = field(default_factory=dict)
    drop: frozenset[str] = frozenset()
    version: str = "majority-a2z-1"

    def chart(self) -> dict:
        return {"code": UNIVERSAL, "graphemes": self.read}


#: A spelling that reads back: one letter, a consonant first, or vowels alone.
READABLE = re.compile(f"(?s).|[^{t.VOWELS}].*|[{t.VOWELS}]*")


def is_single_phoneme(sound: str) -> bool:
    """At most two letters besides ties, marks and modifiers, and of two neither a vowel."""
    import unicodedata

    letters = "".join(c for c in tie_str(sound) if unicodedata.category(c) in ("Ll", "Lo"))
    return len(letters) < 2 or bool(re.fullmatch(f"[^{t.VOWELS}]{{2}}", letters))


def is_readable(spelling: str) -> bool:
    """No vowel followed by a consonant letter: such spellings would swallow the starts of words."""
    return bool(READABLE.fullmatch(spelling))


def shared_from_votes(votes: dict[str, dict[str, int]], spell: dict[str, str] | None = None, drop=()) -> Shared:
    """The majority table: for each sound the plain a-z spelling with most votes.

    Ties go to spellings whose letters are a run of the alphabet, then the shorter, then
    code-point order.  Sounds that no chart spells in plain letters are left out; a few are
    written as nothing.  Where two sounds share a spelling, the one with more votes is read.
    """
    winners: list[tuple[int, str, str]] = []
    for sound, counts in votes.items():
        plain = {g: n for g, n in counts.items() if re.fullmatch("[a-z]+", g) and g not in t.PLACEHOLDERS}
        if sound in t.UNWRITTEN:
            winners.append((sum(counts.values()), sound, ""))
        elif plain:
            winners.append((sum(counts.values()), sound, min(plain, key=lambda g: (-plain[g], g not in "abcdefghijklmnopqrstuvwxyz", len(g), g))))
    out = Shared(spell=dict(spell or {}), drop=frozenset(drop))
    for _, sound, g in sorted(winners, key=lambda w: (-w[0], w[1])):
        out.write.setdefault(tie_str(sound), g)
        if g and is_single_phoneme(sound) and is_readable(g):
            out.read.setdefault(g, tie_str(sound))
    for sound in t.UNWRITTEN:
        out.write.setdefault(sound, "")
    return out


# ---------------------------------------------------------------- letters that a chart leaves out


def letter_votes(charts: dict[str, dict], write: dict[str, str]) -> dict[str, dict[str, int]]:
    """Letter outside ASCII to a-z spelling to number of languages: each chart that has the letter
    as a key votes for what the shared table writes its sound with."""
    out: dict[str, dict[str, int]] = {}
    for chart in charts.values():
        cast = set()
        for g, sound in chart["graphemes"].items():
            letter, spelt = nfc_str(g.lower()), write.get(tie_str(sound))
            if len(letter) == 1 and not letter.isascii() and spelt is not None:
                cast.add((letter, spelt))
        for letter, spelt in cast:
            counts = out.setdefault(letter, {})
            counts[spelt] = counts.get(spelt, 0) + 1
    return out


_LETTER_NAME = re.compile(r"(?:LATIN|GREEK|CYRILLIC|COPTIC|ARABIC|HEBREW|NKO|TIFINAGH)\b.*?\b(?:LETTER|LIGATURE|SYMBOL) (?:[A-Z ]*?\b)?([A-Z]+)(?: (?:WITH|FORM|ISOLATED|INITIAL|MEDIAL|FINAL)\b.*)?")
_SYLLABLE_NAME = re.compile(r".*\b(?:SYLLABLE|LETTER) (?:[A-Z]+ )*?([A-Z]+)")
_SYLLABIC = ("ETHIOPIC", "VAI", "HIRAGANA", "KATAKANA", "HANGUL", "DEVANAGARI", "BENGALI", "CHEROKEE")


def named_spelling(letter: str) -> str:
    """What the Unicode name of a letter says of its sound; the empty string where it says nothing.

    Syllables are named by what they sound like.  A letter's own name begins with its
    consonants (BEH, SHEEN), or with a vowel that is the letter (ALEF) unless the name is a
    vowel before a consonant's sound (EL, EM, YAN), which names the consonant.
    """
    import unicodedata

    name = unicodedata.name(letter, "").replace("-", " ")
    if name.startswith(_SYLLABIC):
        found = _SYLLABLE_NAME.fullmatch(name)
        return found[1].lower() if found else ""
    found = re.match(r"ARABIC LETTER ([A-Z]+)", name) or _LETTER_NAME.fullmatch(name)
    if not found:
        return ""
    word = found[1].lower()
    if len(word) <= 2 and name.startswith("LATIN"):
        return word
    if name.startswith("TIFINAGH") and word.startswith("ya"):
        return word[2:] or "a"
    if name.startswith("CYRILLIC") and re.fullmatch("e[^aeiou]+", word):
        return word[1:]
    return re.match("[^aeiou]+|[aeiou]", word)[0]


#: Blocks whose letters get a spelling ahead of time: Latin and its extensions, sounds, Greek, and the scripts that are romanised.
SPELT_BLOCKS = ((0xA0, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0x370, 0x3FF), (0x1F00, 0x1FFF), *t.NON_LATIN)


def letter_spellings(charts: dict[str, dict], write: dict[str, str]) -> tuple[dict[str, str], frozenset[str]]:
    """Spellings of letters that a language's own chart leaves out, and letters written as nothing.

    In this order: the a-z spelling that most charts with the letter support (two at least,
    or all that there are; of equals the shorter, then by code point); the letters that it is
    composed of (`é`, `ß`, `ﬁ`), as far as those have spellings; how the shared table writes
    it as a sound; what its name says.  Modifier letters are no sounds of their own and drop.
    """
    import unicodedata

    votes = letter_votes(charts, write)
    spell: dict[str, str] = {}
    drop: set[str] = set()
    for letter, counts in votes.items():
        best = min(counts, key=lambda g: (-counts[g], len(g), g))
        if counts[best] >= 2 or len(counts) == 1:
            spell[letter] = best
    seen = {c for chart in charts.values() for pair in chart["graphemes"].items() for c in nfc_str("".join(map(str, pair)).lower()) if not c.isascii()}
    own = sorted(seen | {chr(p) for a, b in SPELT_BLOCKS for p in range(a, b + 1)})

    def spelt(c: str) -> str | None:
        if c in spell or c in drop:
            return spell.get(c, "")
        return c if "a" <= c <= "z" else write.get(tie_str(c)) or named_spelling(c) or None

    for c in own:
        kind = unicodedata.category(c)
        if c in spell or kind[0] != "L":
            continue
        parts = [p for p in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold()) if not unicodedata.combining(p)]
        if kind == "Lm":
            drop.add(c)
        elif parts != [c] and all((s := spelt(p)) is not None and re.fullmatch("[a-z]*", s) for p in parts):
            spell[c] = "".join(spelt(p) for p in parts)
        elif (s := spelt(c)) is not None and re.fullmatch("[a-z]*", s):
            spell[c] = s
    for c in [c for c, s in spell.items() if s == ""]:
        del spell[c]
        drop.add(c)
    return spell, frozenset(drop)


def spelling_of(chart: dict) -> dict[str, str]:
    """Sound to the unit that the language writes it with: first in its alphabet, else in its Latin list, else shortest."""
    by_sound: dict[str, set[str]] = {}
    for g, sound in chart["graphemes"].items():
        by_sound.setdefault(tie_str(sound), set()).add(g)
    rank: dict[str, tuple] = {}
    for k, units in enumerate((chart.get("alphabet") or [], (chart.get("scripts") or {}).get("latin") or [])):
        for i, u in enumerate(units):
            rank.setdefault(u, (k, i))
    return {sound: min(units, key=lambda g: (rank.get(g, (2, 0)), len(g), g)) for sound, units in by_sound.items()}


def is_plain_chart(chart: dict) -> bool:
    """Whether the language is written with a-z and apostrophes alone."""
    letters = [c for u in chart.get("alphabet") or chart["graphemes"] for c in nfd_str(str(u)) if c not in t.APOSTROPHES and c.strip()]
    return bool(letters) and all("a" <= c.lower() <= "z" for c in letters)


__all__ = ["PROXY", "UNIVERSAL", "LanguageNotFoundError", "Shared", "Spec", "bare_str", "is_plain_chart", "letter_spellings", "letter_votes", "is_readable", "is_single_phoneme", "nfc_str", "shared_from_votes", "spelling_of", "validate"]

"""The proxy code: any text in plain a-z, exactly reversible.

a-z stand for themselves, x is doubled, ASCII that is no letter stays, and any other
character becomes x<payload>x: a named payload, or zz and the code point in base 25.  The
input is decomposed first; decoding composes again.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.text import chars, nfc, nfd

_D = t.ESCAPE_DIGITS


#: The digits of Python's own notation, in the order of the payload's.
_PLAIN_DIGITS = str.maketrans(_D, "0123456789abcdefghijklmno")
_DIGITS = 5  # of the largest code point


def codepoint_payload(char: str) -> str:
    digits = "".join(_D[ord(char) // len(_D) ** k % len(_D)] for k in reversed(range(_DIGITS)))
    return "zz" + (digits.lstrip(_D[0]) or _D[0])


def payload_codepoint(payload: str) -> str | None:
    """The character of a zz payload, or None if it is none that a text can hold."""
    if not re.fullmatch(f"zz[{_D}]+", payload):
        return None
    point = int(payload[2:].translate(_PLAIN_DIGITS), len(_D))
    return chr(point) if point < 0xD800 or 0xDFFF < point <= 0x10FFFF else None


def encode_str(text: str, named: dict[str, str] | None = None) -> str:
    named = named or {}

    def one(c: str) -> str:
        if c == "x":
            return "xx"
        if "a" <= c <= "z":
            return c
        if c in named:
            return f"x{named[c]}x"
        return c if c.isascii() and not c.isalpha() else f"x{codepoint_payload(c)}x"

    return "".join(map(one, unicodedata.normalize("NFD", text)))


def decode_str(text: str, named: dict[str, str] | None = None) -> str:
    back = {v: k for k, v in (named or {}).items()}

    def one(m: re.Match) -> str:
        payload = m.group(1)
        if payload is None:
            return "x" if m.group() == "xx" else m.group()
        return back.get(payload) or payload_codepoint(payload) or payload

    return unicodedata.normalize("NFC", re.sub(r"xx|x([^x]*)x", one, text))


# ---------------------------------------------------------------- columns

_DIGIT = lambda n: F.substr(F.lit(_D), n.cast("int") + 1, F.lit(1))


def encode(text: Column, named: dict[str, str] | None = None, decompose: bool = True) -> Column:
    """By JVM expressions apart from the decomposition."""
    table = F.create_map(*[F.lit(x) for p in (named or {}).items() for x in p]) if named else None
    base = len(_D)

    def payload(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        digits = [_DIGIT(F.floor(n / F.lit(base**k)) % base) for k in reversed(range(_DIGITS))]
        spelled = F.concat(*digits)
        return F.concat(F.lit("xzz"), F.when(n == 0, F.lit(_D[0])).otherwise(F.regexp_replace(spelled, f"^{_D[0]}+", "")), F.lit("x"))

    def one(c: Column) -> Column:
        out = F.when(c == "x", F.lit("xx")).when(c.rlike("^[a-z]$"), c)
        if table is not None:
            out = out.when(F.element_at(table, c).isNotNull(), F.concat(F.lit("x"), F.element_at(table, c), F.lit("x")))
        return out.when((F.ascii(c) < 128) & ~c.rlike("^[A-Za-z]$"), c).otherwise(payload(c))

    return F.array_join(F.transform(chars(nfd(text) if decompose else text), one), "")


def decode(text: Column, named: dict[str, str] | None = None, compose: bool = True) -> Column:
    """By JVM expressions apart from the composition: escapes are found leftmost first, xx before x...x."""
    back = F.create_map(*[F.lit(x) for p in (named or {}).items() for x in reversed(p)]) if named else None

    def digits(payload: Column) -> Column:
        """Without leading zeros; more than a code point has are a number too large."""
        return F.regexp_replace(payload, f"^zz{_D[0]}*", "")

    def number(payload: Column) -> Column:
        each = F.transform(F.filter(F.split(digits(payload), ""), lambda d: d != ""), lambda d: F.instr(F.lit(_D), d) - 1)
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, d: a * len(_D) + d)

    def one(m: Column) -> Column:
        payload = F.substr(m, F.lit(2), F.length(m) - 2)
        is_code = payload.rlike(f"^zz[{_D}]+$") & (F.length(digits(payload)) <= _DIGITS)
        n = F.when(is_code, number(payload))
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        out = F.when(m == "xx", F.lit("x")).when(~m.rlike("^x[^x]*x$"), m)
        if back is not None:
            out = out.when(F.element_at(back, payload).isNotNull(), F.element_at(back, payload))
        return out.when(is_code & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), char).otherwise(payload)

    text = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"xx|x[^x]*x|[\s\S]"), F.lit(0)), one), "")
    return nfc(text) if compose else text


def allocate(frequency: list[tuple[str, int]], spell: dict[str, str] | None = None) -> dict[str, str]:
    """Named payloads for characters, commonest first; marks have fixed ones.

    A payload is the character's shared spelling, or that and one or two letters if taken.
    Each choice depends on those before, so this runs on the driver, over one row per
    distinct character of the charts.
    """
    spell, letters = spell or {}, _D
    out = {c: t.MARK_PAYLOADS[c] for c, _ in frequency if c in t.MARK_PAYLOADS}
    used = set(out.values())
    for c, _ in sorted(frequency, key=lambda x: (-x[1], x[0])):
        if c in out:
            continue
        stem = "".join(x for x in spell.get(c, "") if x in letters) or "z"
        stem = "z" + stem[2:] if stem.startswith("zz") else stem
        tries = [stem, *(stem + a for a in letters), *(stem + a + b for a in letters for b in letters)]
        out[c] = next(p for p in tries if p not in used and not p.startswith("zz"))
        used.add(out[c])
    return out

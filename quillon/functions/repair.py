"""Text as it is meant: artefacts that split a word undone, one spelling of letters and numbers, and the tokens of that.

Four steps, all Column expressions: ``repair`` (character references, hidden characters, inline markup, hyphens at line
ends), ``fold`` (case, compatibility forms, marks), ``number_spelling`` (digit groups joined, a unit split off), tokens.
"""

from __future__ import annotations

import html
import html.entities
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import TOKEN_RUN, is_ascii

#: Hidden characters, hyphens that are spelled "-", words after a hyphen at a line end that do not continue the word.
HIDDEN, HYPHENS = "­​‌‍⁠﻿", "‐‑"
SUSPENDING = "und oder bzw sowie bis and or".split()
#: Units that may be written straight behind a number.
GLUED_UNITS = (
    "kwhth kwhel kwh mwh gwh twh wh kwp mwp gwp kvar kva mva kw mw gw kv va cent ct euro eur km kg cm mm qm m2 m3 ml std min sek "
    "khz mhz ghz hz kbit mbit gbit kb mb gb tb bar mio mrd tsd"
).split()
#: What may stand between the groups of a number.
GROUP_MARKS = "[. '’]"

_word = r"[\p{L}\p{N}]"
REFERENCE = r"&(?:#\d{1,7}|#[xX]\p{XDigit}{1,6}|[a-zA-Z]\p{Alnum}{1,31});"
_stars = r"(\*{1,3})(%s+)\%d(?!\*)"
# patterns begin with the character that they need and look back from it, so other characters cost one comparison
_inside = rf"\*(?<={_word}\*)(\*{{0,2}})({_word}+)\*\1(?!\*)"
_before = rf"\*(?<!\*\*)(\*{{0,2}})({_word}+)\*\1(?!\*)(?={_word})"
_continues = rf"-(?<=\p{{L}}-)[ \t]*\r?\n[ \t]*(?!(?i:{'|'.join(SUSPENDING)})(?![\p{{L}}\p{{N}}_]))"
GROUPS = rf"\d(?<![\p{{L}}\p{{N}}_.,'’]\d)\d{{0,2}}(?:{GROUP_MARKS}\d{{3}})+(?!\d)"
GLUED = rf"(\d(?<![\p{{L}}\p{{N}}_-]\d)\d*)({'|'.join(GLUED_UNITS)})(?!{_word})"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rewritten(text: Column, pattern: str, told: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by what ``told`` makes of it; null: nothing."""

    def of(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), told)
        parts = F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return bound(text, of)


def lookup(given: dict[str, str]) -> Column:
    """A constant map, which Spark folds to one literal however many rows it has."""
    keys, values = (F.split(F.lit("\x01".join(x)), "\x01", -1) for x in (given.keys(), given.values()))
    return F.map_from_arrays(keys, values)


def named_references() -> dict[str, str]:
    """Reference -> letters. A map is read from its start, so the plain letters come first, those of Europe before others."""
    letters = sorted(html.entities.html5.items(), key=lambda x: (not (len(x[1]) == 1 and x[1].isalpha()), x[1], x[0]))
    return {f"&{k}": v for k, v in letters if k.endswith(";")}


def _reference(ref: Column) -> Column:
    # numbers 128 to 159 stand for the letters of a code page, as HTML has it
    paged = {f"#{n}": html.unescape(f"&#{n};") for n in range(128, 160)}
    digits = F.regexp_extract(ref, r"^&#[xX]?(\p{XDigit}+);$", 1)
    code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("int")).otherwise(F.conv(digits, 10, 10).cast("int"))
    valid = code.between(9, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")
    # a name that is none stays as it is written
    return F.when(digits != "", F.when(code.between(128, 159), F.try_element_at(lookup(paged), F.concat(F.lit("#"), code))).otherwise(letter)).otherwise(F.coalesce(F.try_element_at(lookup(named_references()), ref), ref))


def _references(text: Column) -> Column:
    """``text`` with its references decoded: one stands at the start of what an ampersand cuts off."""

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, "^" + REFERENCE, 0)
        return F.when(ref == "", piece).otherwise(F.concat(F.coalesce(_reference(ref), F.lit("")), F.substr(piece, F.length(ref) + 1)))

    pieces = F.transform(F.split(text, "&", -1), lambda x, i: F.when(i == 0, x).otherwise(bound(F.concat(F.lit("&"), x), decoded)))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def _where(text: Column, sign: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of a text that holds ``sign``; others stay as they are."""
    return bound(text, lambda t: F.when(t.contains(sign), use(t)).otherwise(t))


def _plain_hyphens(text: Column) -> Column:
    for c in HYPHENS:
        text = F.replace(text, F.lit(c), F.lit("-"))
    for c in HIDDEN:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repair(text: Column) -> Column:
    """``text`` without what splits its words; null: empty. Superscripts are left as ^...^, see ``join_superscripts``.

    Emphasis is taken away inside a word only. A hyphen at a line end joins the word, and stays before a capital; before a
    conjunction ("Netz- und ...") nothing is joined.
    """
    replaced = lambda *steps: lambda t: _replaced(t, steps)
    text = bound(F.coalesce(text.cast("string"), F.lit("")), _references)
    text = bound(text, lambda t: F.when(is_ascii(t), t).otherwise(_plain_hyphens(t)))
    text = _where(text, "<", replaced((r"(?i)</?sub\b[^>]*>", ""), (r"(?i)<sup\b[^>]*>([^<]{0,64})</sup\s*>", "^$1^")))
    text = _where(text, "~", replaced((rf"~(?<={_word}~)([^\s~]{{1,16}})~(?!~)", "$1")))
    text = _where(text, "*", replaced((_inside, "$2"), (_before, "$2")))
    return _where(text, "-", replaced((_continues + r"(?=\p{Lu})", "-"), (_continues + r"(?=\p{L})", "")))


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def join_superscripts(text: Column) -> Column:
    return F.regexp_replace(text, rf"\^(?<={_word}\^)([^\s^]{{1,16}})\^", "$1")


def _class(letters: list[str]) -> str:
    """A pattern for one of ``letters`` as ranges; plain letters are passed by before the ranges are looked at."""
    codes = sorted(map(ord, letters))
    held = set(codes)
    starts, ends = [c for c in codes if c - 1 not in held], [c for c in codes if c + 1 not in held]
    return r"(?=[^\x00-\x7F])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _folding() -> tuple[str, str, dict[str, str]]:
    """By rule of Unicode: letters with one base letter, and it; marks, which go; letters that stand for several."""
    one, base, marks, several = [], [], [], {}
    for c in map(chr, [*range(0xA0, 0x3400), *range(0xF900, 0xFB50), *range(0xFE30, 0x10000)]):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one.append(c)
            base.append(plain)
        elif len(plain) > 1:
            several[c] = plain
    return "".join(one + marks), "".join(base), several


FOLDED, BASE, SEVERAL = _folding()
LIGATURE = _class(list(SEVERAL))


def fold(text: Column) -> Column:
    """Lower case, compatibility forms as plain letters, without marks. Hangul stays composed."""
    several = lambda t: F.when(is_ascii(t), t).otherwise(rewritten(t, LIGATURE, lambda c: F.try_element_at(lookup(SEVERAL), c)))
    return bound(F.lower(text), lambda t: F.when(is_ascii(t), t).otherwise(bound(F.translate(t, FOLDED, BASE), several)))


def number_spelling(text: Column) -> Column:
    """Folded text with the digit groups of a number joined and a unit behind a number split off."""
    spelled = lambda t: F.regexp_replace(rewritten(t, GROUPS, lambda x: F.regexp_replace(x, GROUP_MARKS, "")), GLUED, "$1 $2")
    return bound(text, lambda t: F.when(t.rlike("[0-9]"), spelled(t)).otherwise(t))


def number_groups(text: Column) -> Column:
    """The groups of numbers that a blank separates: it may also stand between two numbers, so a scan takes them too."""
    joined = F.filter(F.regexp_extract_all(text, F.lit(GROUPS), F.lit(0)), lambda x: x.contains(" "))
    return F.flatten(F.transform(joined, lambda x: F.split(x, GROUP_MARKS)))


def spelled_tokens(spelled: Column) -> Column:
    """Tokens of a text that is repaired, folded and spelled."""
    return F.regexp_extract_all(spelled, F.lit(TOKEN_RUN), F.lit(0))


def _tokens(text: Column) -> Column:
    return spelled_tokens(number_spelling(fold(text)))


def with_superscripts(repaired: Column, own: Column) -> Column:
    """``own``, the tokens of a repaired text, and behind them once those that superscripts give, joined to their word.

    No step behind the repair looks over the end of a line, so only lines with a superscript are read again.
    """
    raised = F.array_join(F.filter(F.split(repaired, "\n", -1), lambda x: x.contains("^")), "\n")
    return F.when(repaired.contains("^"), bound(own, lambda w: F.concat(w, F.array_except(_tokens(join_superscripts(raised)), w)))).otherwise(own)


def repaired_tokens(text: Column) -> Column:
    """Tokens of a repaired text in order; those that superscripts give, joined to their word, stand behind them once."""
    return bound(repair(text), lambda t: bound(_tokens(t), lambda own: with_superscripts(t, own)))


def scan_tokens(text: Column) -> Column:
    """The distinct tokens of a passage, and the groups of numbers as numbers of their own."""
    return F.array_distinct(F.concat(repaired_tokens(text), number_groups(fold(repair(text)))))


def repair_counts(text: Column) -> dict[str, Column]:
    """How many artefacts of each kind a text holds."""
    found = {
        "reference": REFERENCE, "hidden": f"[{HIDDEN}]", "subscript": rf"(?i)<sub\b|(?<={_word})~[^\s~]{{1,16}}~(?!~)", "superscript": rf"(?i)<sup\b|(?<={_word})\^[^\s^]{{1,16}}\^",
        "emphasis": rf"(?<={_word}){_stars % (_word, 1)}|(?<!\*)" + _stars % (_word, 3) + rf"(?={_word})", "line-end": _continues + r"(?=\p{L})", "digit-groups": GROUPS,
    }
    return {k: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))).cast("long") for k, p in found.items()}

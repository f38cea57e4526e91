"""Look-alike characters: one prototype table shared by the operators that compare text by its looks."""

from __future__ import annotations

import re
import unicodedata

# Greek and Cyrillic letters whose usual printed form equals a Latin letter (public Unicode confusables).
GREEK_LOOKS = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ϲ": "c", "ϳ": "j", "Ϲ": "C"}
CYRILLIC_LOOKS = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l", "Ӏ": "I", "г": "r", "п": "n", "ү": "y", "ѵ": "v", "ь": "b", "ԍ": "g", "ո": "n", "ս": "u", "օ": "o"}
PROTOTYPES = GREEK_LOOKS | CYRILLIC_LOOKS

#: Characters without width, and the hyphen that shows only at a line's end.
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Marks that make one letter with the letter before them: Latin and Greek, Arabic, Indic, Japanese.
MARKS = "\u0300-\u036f\u0653-\u0655\u093c\u09bc\u3099\u309a"
#: Space characters other than U+0020, tab and line feed.
SPACES = "               　\x0b\x0c\r\x85  "


def _letters_in_compat_form() -> dict[str, str]:
    """Full-width Latin letters and digits, and joined letters, each with what they stand for (by rule from Unicode data)."""
    out = {}
    for start, stop in ((0x0132, 0x0134), (0x013F, 0x0141), (0x0149, 0x014A), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0xFB00, 0xFB07), (0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)):
        for code in range(start, stop):
            kind, _, _ = unicodedata.decomposition(chr(code)).partition(" ")
            if kind in ("<wide>", "<compat>"):
                out[chr(code)] = unicodedata.normalize("NFKC", chr(code))
    return out


COMPAT = _letters_in_compat_form()

LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
FOREIGN_LOOK = re.escape("".join(PROTOTYPES))
LOOKALIKE_WORD = re.compile(f"[{LATIN}{FOREIGN_LOOK}̀-ͯ]*(?:[{LATIN}][̀-ͯ]*[{FOREIGN_LOOK}]|[{FOREIGN_LOOK}][{LATIN}])[{LATIN}{FOREIGN_LOOK}̀-ͯ]*")
_ONE_LINE = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(k): v for k, v in COMPAT.items()}
_LOOKS = str.maketrans(PROTOTYPES)
_ODD = re.compile(f"[{re.escape(INVISIBLE + SPACES + ''.join(COMPAT))}{FOREIGN_LOOK}{MARKS}]")


def one_form(text: str) -> str:
    """One consistent form: joined and full-width letters spelt out, widthless characters gone, every space U+0020,
    letters composed (NFC), look-alike letters inside Latin words replaced by their prototypes. Superscripts, units,
    single foreign symbols, whole words of other scripts and full-width punctuation stay. Line feeds and tabs stay."""
    if text.isascii() and "\r" not in text and "\x0b" not in text and "\x0c" not in text:
        return text
    text = unicodedata.normalize("NFC", text)
    if not _ODD.search(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(_ONE_LINE))
    return LOOKALIKE_WORD.sub(lambda m: m.group().translate(_LOOKS), text)


def _styled_letters() -> dict[str, str]:
    """Letters and digits in a mathematical or letter-like style, each with the plain one (by rule from Unicode data)."""
    out = {}
    for code in (*range(0x2100, 0x2150), *range(0x1D400, 0x1D800)):
        kind, _, plain = unicodedata.decomposition(chr(code)).partition(" ")
        if kind == "<font>" and " " not in plain:
            out[chr(code)] = chr(int(plain, 16))
    return out


#: What the skeleton's last step replaces: the look-alikes and styled letters.
_PROTOTYPES = str.maketrans(_styled_letters() | PROTOTYPES)
_NO_INVISIBLE = dict.fromkeys(map(ord, INVISIBLE))
_TO_SPACE = {ord(c): " " for c in SPACES}
_SPELT = {ord(k): v for k, v in COMPAT.items()}
_HAS = {"invisible": re.compile(f"[{re.escape(INVISIBLE)}]").search, "space": re.compile(f"[{re.escape(SPACES)}]").search, "compat": re.compile(f"[{re.escape(''.join(COMPAT))}]").search}
_LETTER_MARKS = re.compile(f"[^\\W\\d_][{MARKS}]+")


def _composed(text: str) -> str:
    """Letters with a mark that exist as one letter, as that letter."""
    return _LETTER_MARKS.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


def skeleton_steps(text: str) -> list[tuple[str, str]]:
    """(kind of what a step replaces, text after the step): from the text to its skeleton.

    Characters without width go, spaces become one kind, joined and full-width forms are spelt out, marks join their letters, and
    look-alikes in words of Latin letters get their prototypes; the last step gives every character of the table its prototype
    and decomposes. A step that finds nothing leaves the text as it is. Decomposition is canonical: superscripts stay.
    """
    out = []
    for kind, table in (("invisible", _NO_INVISIBLE), ("space", _TO_SPACE), ("compat", _SPELT)):
        if _HAS[kind](text):
            text = text.translate(table)
        out.append((kind, text))
    text = _composed(text)
    out.append(("combining", text))
    text = LOOKALIKE_WORD.sub(lambda m: m.group().translate(_LOOKS), text)
    out.append(("lookalike", text))
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PROTOTYPES))
    out.append(("prototype", text))
    return out


def skeleton(text: str) -> str:
    """The confusables skeleton: decompose, prototype for every character of the look-alike table, decompose again."""
    return text if text.isascii() else skeleton_steps(text)[-1][1]

"""Printed lines of scanned text: folded words, glyph skeletons, running headers and page numbers of one section at a time."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.llm.scripts import COMPAT, INVISIBLE, PROTOTYPES, SPACES

# Glyphs that scanning confuses. Single signs share a prototype; wide letters are spelt by narrower ones.
SAME_GLYPH = {"€": "c", "e": "c", "0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "5": "s", "$": "s", "@": "a", "9": "g", "6": "b", "8": "b", "7": "t", "f": "t"}
SPELT_GLYPH = {"\\/": "v", "m": "rri", "n": "ri", "d": "ci", "u": "ii", "h": "ii", "y": "ij", "w": "vv"}
# Words before a chapter number, before a page number, and before the number of pages.
CHAPTER_WORDS = ["hoofdstuk", "chapter", "kapitel", "chapitre", "capitulo"]
PAGE_WORDS = ["blz", "bladzijde", "pagina", "p", "page", "pag", "s", "seite"]
OF_WORDS = ["van", "of", "von", "de", "sur"]


class _Same(dict):
    """A translation table that keeps what it doesn't list (and remembers that, as a failed look-up is slow)."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


def _folding() -> _Same:
    out = _Same()
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1:
            out[code] = base[0]
    out.update({ord(k): v for k, v in (PROTOTYPES | COMPAT).items()})
    out.update({ord(c): " " for c in SPACES} | dict.fromkeys(map(ord, INVISIBLE)) | dict.fromkeys(range(0x300, 0x370)))
    return out


_FOLD = _folding()


def fold(text: str) -> str:
    """Lower case without accents, disguises and widthless characters."""
    return (text if text.isascii() else text.translate(_FOLD)).lower()


_GLYPHS = {ord(k): v for k, v in (SAME_GLYPH | {k: v for k, v in SPELT_GLYPH.items() if len(k) == 1}).items()}


def glyphs_of(folded: str) -> str:
    """Skeleton of folded text: forms that scanning can turn into one another have the same skeleton."""
    return folded.replace("\\/", "v").translate(_GLYPHS)


def glyphs(folded: Column) -> Column:
    """The same as a column."""
    out = F.translate(F.replace(folded, F.lit("\\/"), F.lit("v")), "".join(SAME_GLYPH), "".join(SAME_GLYPH.values()))
    for wide, spelt in SPELT_GLYPH.items():
        if len(wide) == 1:
            out = F.replace(out, F.lit(wide), F.lit(spelt))
    return out


class _Letters(dict):
    """Skeleton letters of folded characters; what has none goes."""

    def __missing__(self, code: int) -> str | None:
        out = "".join(c for c in _GLYPHS.get(code, chr(code)) if "a" <= c <= "z") or None
        self[code] = out
        return out


_LETTERS = _Letters()


def letters_of(folded: str) -> str:
    """The letters a-z of the skeleton."""
    return folded.replace("\\/", "v").translate(_LETTERS)


def title_key(title: str | None) -> str:
    """Letters of the title's skeleton."""
    return letters_of(fold(title)) if isinstance(title, str) else ""


_DIGIT = "[0-9oil|!sgb]"
_LABEL = re.compile(f"(?<![a-z0-9])(?:c[hb]\\s?{_DIGIT}{{2,3}}|(?:{'|'.join(CHAPTER_WORDS)})\\s+{_DIGIT}{{1,3}}\\.?)(?![a-z0-9])")
_NUMBER = re.compile(f"(?<![a-z0-9]){_DIGIT}*[0-9]{_DIGIT}*(?![a-z0-9])")
_PAGE = re.compile(f"[\\[({{~–—-]*\\s*(?:(?:{'|'.join(PAGE_WORDS)})\\b\\.?\\s*)?({_DIGIT}*[0-9]{_DIGIT}*|[ivxlc]+)\\s*(?:(?:{'|'.join(OF_WORDS)}|/)\\s*{_DIGIT}*[0-9]{_DIGIT}*)?\\s*[\\])}}~–—-]*")
# Fixed value: no book has pages of more digits.
PAGE_DIGITS = 5
_TO_DIGIT = str.maketrans("oil|!sgb", "01111596")
_ROW = re.compile("[^|]*\\w \\| \\w[^\n]*")
_LABEL_KEYS = ["", *map(letters_of, [*CHAPTER_WORDS, "ch"])]
#: Key of a line that holds nothing but a chapter's label.
LABEL_ONLY = "#label"
_BARE_LABELS = {LABEL_ONLY}
_LABEL_STARTS = ["ch", "cb", *CHAPTER_WORDS]
_ANY_DIGIT = re.compile("[0-9]")


def masked_keys(folded: str) -> set[str]:
    """Keys under which printed lines that differ in their numbers only are the same: letters of the skeleton with digits masked,
    with and without chapter label and number. A line without letters has none."""
    bare = _LABEL.sub(" ", folded) if any(w in folded for w in _LABEL_STARTS) else folded
    without = _NUMBER.sub(" ", bare) if _ANY_DIGIT.search(bare) else bare
    out = {letters_of(form) for form in {without, bare, folded}} - {""}
    if bare != folded and not any(c.isalpha() for c in without):
        out.add(LABEL_ONLY)
    return out


class _Gone(dict):
    """A translation table that drops what it doesn't list."""

    def __missing__(self, code: int) -> None:
        self[code] = None


def _rough_table() -> dict[int, str | None]:
    """Each character's skeleton where it is one letter that no wide letter is spelt with; the others go."""
    spelt = {c for wide, letters in SPELT_GLYPH.items() for c in wide + letters}
    table = _Gone()
    for code in range(128):
        letter = letters_of(chr(code))
        table[code] = letter if len(letter) == 1 and letter not in spelt and chr(code) not in spelt else None
    return table


_ROUGH = _rough_table()


def rough(folded: str) -> str:
    """A part of the skeleton's letters that is cheap to make: texts of equal skeleton have it in common."""
    return folded.replace("\\/", "v").translate(_ROUGH)


class Headers:
    """The masked keys of a book's running headers, with a cheap test of whether a line can have one."""

    def __init__(self, keys: set[str], title: str | None) -> None:
        self.keys = keys
        self.rough = rough(fold(title)) if isinstance(title, str) else ""
        self.titled = any(k not in _BARE_LABELS for k in keys)

    def of(self, folded: str) -> set[str]:
        """The keys that the line has."""
        if self.titled and self.rough in rough(folded) or any(w in folded for w in _LABEL_STARTS) and _LABEL.search(folded):
            return masked_keys(folded) & self.keys
        return set()


def header_keys(title: str | None) -> set[str]:
    """Keys of the headers that a book of this title can have."""
    key = title_key(title)
    return {LABEL_ONLY, *({label + key for label in _LABEL_KEYS} if len(key) >= 4 else ())}


def page_number(folded: str) -> int | None:
    """The number of a line that holds only a page number and its trimmings (0 for roman numbers), else None."""
    m = _PAGE.fullmatch(folded) if folded else None
    if not m or len(m.group(1)) > PAGE_DIGITS:
        return None
    digits = m.group(1).translate(_TO_DIGIT)
    return int(digits) if digits.isdecimal() and any(c.isdecimal() for c in m.group(1)) else 0


BLANK, BODY, TABLE, HEADER, PAGE = "blank", "body", "table", "header", "page_number"


def classify(lines: list[str], folded: list[str], headers: Headers, lo: int | None = None, hi: int | None = None) -> list[str]:
    """The kind of every line; folded are the same lines folded, headers those of the book. A bare number is a page number if it fits the section's pages, and in a table only beside a header."""
    folded = [x.strip() for x in folded]
    kinds = [BLANK if not f else HEADER if headers.of(f) else BODY for f in folded]
    start, n = 0, len(lines)
    while start < n:
        stop = start
        while stop < n and kinds[stop] != BLANK:
            stop += 1
        if any(folded[i] == "[tabel]" or " | " in lines[i] and _ROW.fullmatch(lines[i]) for i in range(start, stop)):
            for i in range(start, stop):
                kinds[i] = TABLE if kinds[i] == BODY else kinds[i]
        start = stop + 1
    for i in range(n):
        if kinds[i] in (BODY, TABLE) and (number := page_number(folded[i])) is not None:
            beside = i and kinds[i - 1] == HEADER or i + 1 < n and kinds[i + 1] == HEADER
            fits = lo is None or lo - 1 <= number <= (lo if hi is None else hi) + 1
            bare = folded[i].isdecimal()
            if not bare or fits and (beside or kinds[i] == BODY):
                kinds[i] = PAGE
    return kinds


def headers_of(title: str | None) -> Headers:
    """All headers that a book of this title can have."""
    return Headers(header_keys(title), title)

"""Stage cues in spoken text: what a bracketed direction stands for, text without cues, and what a voice says, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that describe a sound, the sounds as they are spoken, and the words of pure reactions.
CUE_WORDS = {
    "laugh": ["laugh", "laughs", "laughing", "laughter", "lacht", "lachen", "lach", "lachend", "schatert", "gelach"],
    "chuckle": ["chuckle", "chuckles", "chuckling", "giggle", "giggles", "grinnik", "grinnikt", "grinniken", "giechelt", "gniffelt"],
    "sigh": ["sigh", "sighs", "sighing", "zucht", "zuchten", "zuchtend"],
    "hm": ["hums", "mumbles", "mompelt", "bromt"],
}
SPOKEN = {"laugh": "Haha.", "chuckle": "Hehe.", "sigh": "Pff.", "hm": "Hm.", "ja": "Ja.", "oh": "Oh.", "wacht": "Wacht.", "precies": "Precies."}
SOFTLY = ["zacht", "even", "kort", "softly"]
REACTION_WORD = "^(h?a(ha)+h?|he(he)+|ha+|he|h+m+|m+h?m+|ja+|jawel|o+h*|oké|ok|okay|wacht|even|precies|pf+|zucht|nou|tja|a+h+|hè|hé)$"
BRACKETED = "[(\\[*]\\s*([^()\\[\\]*]{1,40}?)\\s*[)\\]*]"
_REST = " .,!?…-—"


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(\\p{L}+)"), F.lit(1))


def _label_of(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, words in CUE_WORDS.items():
        out = F.when(word.isin(*words), label).otherwise(out)
    return out


def _first_label(words: Column) -> Column:
    labels = F.filter(F.transform(words, _label_of), lambda x: x.isNotNull())
    return F.get(labels, F.lit(0))


def cue_reaction(text: Column) -> Column:
    """The reaction that a text stands for if it is nothing but a cue, else null."""
    shown = F.trim(text)
    brackets = F.regexp_extract_all(shown, F.lit(BRACKETED), F.lit(1))
    words = _letters(shown)
    known = F.transform(words, lambda w: _label_of(w).isNotNull())
    bare = F.size(words).between(1, 2) & F.exists(known, lambda x: x) & F.forall(words, lambda w: _label_of(w).isNotNull() | w.isin(*SOFTLY))
    in_brackets = F.get(F.filter(F.transform(brackets, lambda b: _first_label(_letters(b))), lambda x: x.isNotNull()), F.lit(0))
    only = F.trim(F.regexp_replace(shown, BRACKETED, ""), F.lit(_REST)) == ""
    return F.when(shown == "", F.lit(None).cast("string")).when(only, in_brackets).when(bare, _first_label(words))


def strip_cues(text: Column) -> Column:
    """The text without cues, its spacing tidied."""
    out = F.regexp_replace(F.regexp_replace(text, BRACKETED, " "), "[\\s\\p{Z}]+([,.!?…])", "$1")
    return F.trim(F.regexp_replace(out, "[\\s\\p{Z}]+", " "), F.lit(" ,"))


def speakable(text: Column, reaction: Column | None = None) -> Column:
    """What a voice says: the sound of a cue that stands alone, else the text without cues, else the text."""
    label = reaction if reaction is not None else F.lit(None).cast("string")
    spoken = F.create_map(*[F.lit(x) for kv in SPOKEN.items() for x in kv])
    cue = cue_reaction(text)
    left = F.when((F.trim(strip_cues(text), F.lit(_REST)) == "") & label.isNotNull(), label)
    stripped = strip_cues(text)
    return F.coalesce(F.try_element_at(spoken, F.coalesce(cue, left)), F.when(stripped != "", stripped), F.trim(text))


def pure_reaction(text: Column, reaction: Column) -> Column:
    """The reaction that a line is, if it is nothing but that: a cue, or one to four reaction words under a label."""
    words = _letters(strip_cues(text))
    sounds = F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(REACTION_WORD))
    return F.coalesce(cue_reaction(text), F.when(sounds, reaction))


def spoken_text(text: Column, last: bool = True) -> Column:
    """Speakable text; at a turn's end without the dash or dots of a fragment."""
    out = speakable(text)
    return F.when(F.lit(last), F.rtrim(F.regexp_replace(out, "[\\s\\p{Z}]*(—|…|-|\\.\\.\\.)[\\s\\p{Z}]*$", ""))).otherwise(out)

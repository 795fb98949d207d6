"""Transliteration to Latin letters: nine Indic scripts and Kana by the characters' Unicode names, Greek, Cyrillic, Hebrew and Arabic by tables.

A character's spelling doesn't depend on its neighbours, so a column of text is spelled by one
map inside the JVM, and only rows that hold such a character are looked at letter by letter.
Scripts without a spelling in their names (Han among them) stay as they are.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and their spellings, in alphabetical order.
LETTERS = {
    "greek": "α a β v γ g δ d ε e ζ z η i θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ y φ f χ ch ψ ps ω o ά a έ e ή i ί i ό o ύ y ώ o",
    "cyrillic": "а a б b в v г g д d е e ж zh з z и i й y к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ - ы y ь - э e ю yu я ya ё yo є ye і i ї yi ґ g",
    "hebrew": "א a ב b ג g ד d ה h ו v ז z ח h ט t י y ך k כ k ל l ם m מ m ן n נ n ס s ע a ף p פ p ץ ts צ ts ק q ר r ש sh ת t",
    "arabic": "ا a ب b ت t ث th ج j ح h خ kh د d ذ dh ر r ز z س s ش sh ص s ض d ط t ظ z ع a غ gh ف f ق q ك k ل l م m ن n ه h و w ي y ة h ى a پ p چ ch ژ zh گ g ک k ی y",
}
SPELLED_SCRIPTS = r"[\u0370-\u052F\u0590-\u06FF\u0900-\u0D7F\u3041-\u30FF]"
_VOWELS = re.compile(r"(LETTER|VOWEL SIGN) (?:VOCALIC )?(?:SHORT |CANDRA )?([A-Z]+)$")


@functools.cache
def letters() -> dict[str, str]:
    """The tables' letters; '-' stands for nothing."""
    out = {}
    for table in LETTERS.values():
        words = table.split(" ")
        out |= {c: spelling.replace("-", "") for c, spelling in zip(words[::2], words[1::2], strict=True)}
    return out


@functools.cache
def spelled(c: str) -> str:
    """Latin letters of one character.

    A consonant's name ends in the vowel that is left unwritten, which is dropped; doubled
    letters of a name (long vowels, retroflex consonants) are written once; signs without a
    sound vanish.  What isn't Indic is decomposed, and marks are dropped.
    """
    if c.isascii():
        return c
    if c.lower() in letters():
        return letters()[c.lower()]
    name = unicodedata.name(c, "")
    script = name.split(" ")[0]
    if script in ("HIRAGANA", "KATAKANA") and " LETTER " in name:
        return name.rpartition(" ")[2].lower()
    if script == "ARABIC-INDIC" and "DIGIT" in name:
        return str(unicodedata.decimal(c, ""))
    if script in ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"):
        if "DIGIT" in name:
            return str(unicodedata.decimal(c, ""))
        if name.endswith(("ANUSVARA", "BINDI", "TIPPI")):
            return "n"
        found = _VOWELS.search(name)
        if not found:
            return ""
        kind, sound = found.group(1), found.group(2).lower()
        if kind == "LETTER" and len(sound) > 1 and sound.endswith("a") and sound[0] not in "aeiou":
            sound = sound[:-1]
        return re.sub(r"(.)\1", r"\1", sound)
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def transliterated(text: str | None) -> str:
    return "".join(map(spelled, text or ""))


@functools.cache
def spellings() -> dict[str, str]:
    """Every character of the spelled scripts whose spelling isn't itself."""
    inside = re.compile(SPELLED_SCRIPTS.encode().decode("unicode_escape"))
    return {c: spelled(c) for c in map(chr, range(0x370, 0x3100)) if inside.match(c) and unicodedata.name(c, "") and spelled(c) != c}


def transliterate(c: Column) -> Column:
    """Texts in Latin letters; rows without a character of these scripts stay as they are, null becomes ''."""
    # One literal, which the optimiser folds into a map.
    known = F.str_to_map(F.lit("\x02".join(f"{a}\x01{b}" for a, b in spellings().items())), F.lit("\x02"), F.lit("\x01"))
    one_by_one = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(known, x), x)), "")
    return F.coalesce(F.when(c.rlike(SPELLED_SCRIPTS), one_by_one).otherwise(c), F.lit(""))

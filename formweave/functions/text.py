"""Column builders over strings: normal forms, and predicates on field values."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base character and marks, and those base characters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if base != c and len(base[:1]) == 1 and all(unicodedata.category(x)[0] == "M" for x in base[1:]):
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _decomposed()
#: What marks a label as an identification field, and a pair as a contact.
ID_LABELS = ("phase", "indice", "revision", "echelle", "format", "emetteur", "lot", "zone", "niveau", "numero", "n°", "affaire", "projet", "batiment", "type", "date")
CONTACT_TERMS = ("rue", "avenue", "boulevard", "cedex", "immeuble", "constructeur", "mainteneur", "maitrise", "maitre d", "controle technique", "coordonnateur", "bureau d")


def without_marks(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}+", "")


def strip(text: Column) -> Column:
    """Drop ASCII white space at both ends, also tabs and line ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*$"), F.lit(True))


def normalize_label(text: Column) -> Column:
    """No accents, lower case, single blanks, no colons at the end; null and blank give the empty string."""
    plain = strip(F.regexp_replace(F.lower(without_marks(text)), r"\s+", " "))
    return F.coalesce(strip(F.regexp_replace(plain, ":+$", "")), F.lit(""))


def normalize_value(text: Column) -> Column:
    """A label's normal form, and numbers without leading zeros (all zeros: 0)."""
    plain = normalize_label(text)
    bare = F.regexp_replace(plain, "^0+", "")
    return F.when(plain.rlike("^[0-9]+$"), F.when(bare == "", "0").otherwise(bare)).otherwise(plain)


def simplify(text: Column) -> Column:
    """No accents, lower case, only a-z, 0-9 and single blanks."""
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(without_marks(text)), "[^a-z0-9 ]", " "), r"\s+", " ")), F.lit(""))


def fold(text: Column) -> Column:
    """No accents, lower case, nothing else."""
    return F.coalesce(F.lower(without_marks(text)), F.lit(""))


def word_count(text: Column) -> Column:
    return F.when(is_blank(text), 0).otherwise(F.size(F.split(strip(text), r"\s+")))


def is_short_code(value: Column) -> Column:
    """Not blank, 14 characters and 3 words at most, with a letter or digit."""
    return ~is_blank(value) & (F.length(strip(value)) <= 14) & (word_count(value) <= 3) & value.rlike(r"[\p{L}\p{Nd}]")


def looks_like_phone(value: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(value, r"[^\p{Nd}]", "")) >= 7, F.lit(False))


def looks_like_postal(value: Column) -> Column:
    """A five-digit word in a value of one line."""
    return F.coalesce(value.rlike(r"\A.*\b\d{5}\b.*\z"), F.lit(False))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a term stands in the text, also inside a word: one alternation, so that the text is computed once."""
    return F.coalesce(text.rlike("|".join(map(re.escape, terms))), F.lit(False))


def strip_code_fence(text: Column) -> Column:
    """Without a first line of back quotes, and without what follows the last three back quotes."""
    body = F.regexp_replace(strip(text), r"(?s)\A```[^\n]*\n?", "")
    return F.when(strip(text).startswith("```"), strip(F.regexp_replace(body, r"(?s)```(?!.*```).*\z", ""))).otherwise(strip(text))


def truncated(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def zone(text: Column) -> Column:
    """A zone's name, null where it is blank or unknown."""
    name = F.lower(strip(text))
    return F.when(is_blank(text) | (name == "unknown"), F.lit(None)).otherwise(name)


def is_retryable(status: Column) -> Column:
    """Whether a reader's HTTP status is worth another attempt."""
    return F.coalesce(status.isin(429, 502, 503, 504), F.lit(False))


def cache_key(body: Column) -> Column:
    return F.sha2(body, 256)


def read_prompt(base: str, intro: str, targets: Column, labels_word: str = "labels") -> Column:
    """``base``, and where fields are asked for ``intro`` and a line per field (struct of name and labels)."""
    named = lambda t: F.concat(F.lit("- "), t["name"], F.when(F.size(t["labels"]) > 0, F.concat(F.lit(f" ({labels_word}: "), F.array_join(t["labels"], ", "), F.lit(")"))).otherwise(""))
    lines = F.array_join(F.transform(targets, named), "\n")
    return F.when(F.coalesce(F.size(targets), F.lit(0)) > 0, F.concat(F.lit(base + intro), lines)).otherwise(F.lit(base))


def locate_prompt(base: str, hint: str, labels: Column, end: str = "") -> Column:
    """``base``, and where there are labels ``hint``, the different trimmed ones that are not blank, and ``end``."""
    known = F.array_distinct(F.filter(F.transform(labels, strip), lambda x: ~is_blank(x)))
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, F.concat(F.lit(base + hint), F.array_join(known, ", "), F.lit(end))).otherwise(F.lit(base))

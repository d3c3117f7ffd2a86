"""String column expressions: accents, identifiers, edit distance, patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbral.functions.scalars import col

# ---- fixed values: letters without a canonical decomposition ------------------------------------
MULTI_LETTER = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "TH", "þ": "th"}
SINGLE_LETTER = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Ð": "D", "ð": "d", "ı": "i"}
# -----------------------------------------------------------------------------------------------


def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            source.append(letter)
            target.append(base)
    source += list(SINGLE_LETTER)
    target += list(SINGLE_LETTER.values())
    return "".join(source), "".join(target)


_FROM, _TO = _accent_pairs()


def strip_accents(c: str | Column) -> Column:
    """Latin text to ASCII letters; combining marks are dropped."""
    out = F.translate(F.regexp_replace(col(c), "\\p{Mn}+", ""), _FROM, _TO)
    for letter, pair in MULTI_LETTER.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def normalise_name(c: str | Column) -> Column:
    return F.lower(strip_accents(c))


def split_id(c: str | Column, parts: int) -> list[Column]:
    """Pieces between runs of non-alphanumerics: surplus pieces dropped, missing ones NULL."""
    pieces = F.split(col(c), "[^\\p{L}\\p{N}]+")
    return [F.get(pieces, F.lit(i)) for i in range(parts)]


def paste(*parts: str | Column, sep: str = "") -> Column:
    """Concatenation in which a missing value becomes the text ``NA``."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts]
    joined = [t for p in texts for t in (F.lit(sep), p)][1:] if sep else texts
    return F.concat(*joined)


def normalise_id(c: str | Column) -> Column:
    """First two pieces of an identifier joined by ``-``; a missing piece is written ``NA``."""
    return paste(*split_id(c, 2), sep="-")


def extra_part_flag(c: str | Column) -> Column:
    """1 if the identifier has a third piece, else 0."""
    return F.when(split_id(c, 3)[2].isNull(), F.lit(0)).otherwise(F.lit(1))


def _swapped_once(a: Column, b: Column) -> Column:
    """True if exchanging one pair of neighbouring letters of ``a`` gives ``b``."""
    return F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1),
            F.substring(a, i + 1, F.lit(1)),
            F.substring(a, i, F.lit(1)),
            F.substring(a, i + 2, F.length(a)),
        )
        == b,
    )


def dl_0_1(a: str | Column, b: str | Column) -> Column:
    """Edit distance counting neighbour swaps: 0, 1, or NULL if larger or if a text is missing.

    The swap test runs only on equally long texts whose plain edit distance is 2.
    """
    a, b = col(a), col(b)
    plain = F.levenshtein(a, b, 2)
    swap = (plain == 2) & (F.length(a) == F.length(b)) & (F.length(a) >= 2)
    return (
        F.when(a == b, F.lit(0))
        .when(plain == 1, F.lit(1))
        .when(F.when(swap, _swapped_once(a, b)).otherwise(F.lit(False)), F.lit(1))
    )


def dl_within_1(a: str | Column, b: str | Column) -> Column:
    return dl_0_1(a, b).isNotNull()


def one_deletion_keys(c: str | Column) -> Column:
    """The text itself and every text with one letter left out.

    Two texts within edit distance 1 (swaps included) share at least one of these keys, which turns
    the fuzzy comparison into an equi-join.
    """
    c = col(c)
    shorter = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
        lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))),
    )
    return F.array_distinct(F.concat(F.array(c), shorter))


def regex_normalise(c: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Replace the whole text by a label wherever a pattern occurs, rule after rule, ignoring case."""
    out = col(c)
    for pattern, label in rules:
        out = F.regexp_replace(out, f"(?i).*({pattern}).*", label)
    return out


def digits_prefix(c: str | Column) -> Column:
    """Drop what follows the first run of digits, then read a number; NULL if none remains."""
    return F.regexp_replace(col(c), "([0-9]+).*$", "$1").try_cast("double")

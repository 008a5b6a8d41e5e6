"""Text column expressions: name keys, seasons, entity decoding, link templates."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns of the sources.
SEASON_IN_TITLE = r"for the (\d{4})/\d{4} season"
TRAILING_JSON_NUMBER = r"(\d+)\.json$"
APOSTROPHE_ENTITY = "&#039;"


@cache
def _fold_table() -> tuple[str, str]:
    """Characters that decompose into exactly one base character plus marks, and that base."""
    accented, base = [], []
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        kept = [c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c)[0] != "M"]
        if len(kept) == 1 and kept[0] != letter:
            accented.append(letter)
            base.append(kept[0])
    return "".join(accented), "".join(base)


def strip_accents(text: Column) -> Column:
    """Drop combining marks. Letters that do not decompose (ø, đ, ı) stay as they are.

    Plain ASCII, whose length in bytes equals its length in characters, has nothing to fold.
    """
    accented, base = _fold_table()
    folded = F.regexp_replace(F.translate(text, accented, base), r"\p{M}", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def name_key(text: Column) -> Column:
    """Comparable form of a name: no accents, lower case."""
    return F.lower(strip_accents(text))


def token(text: Column, position: int) -> Column:
    """Space-separated token, counted from 1, or from the end when negative."""
    return F.split_part(text, F.lit(" "), F.lit(position))


def name_keys(first: Column, second: Column, known_as: Column) -> dict[str, Column]:
    """Keys of a long official name under which another source may list the person."""
    space = F.lit(" ")
    return {
        "full_name": name_key(F.concat(first, space, second)),
        "short_name": name_key(F.concat(token(first, 1), space, token(second, -1))),
        "first_tokens": name_key(F.concat(token(first, 1), space, token(second, 1))),
        "web_name": name_key(known_as),
    }


def decode_apostrophe(text: Column) -> Column:
    return F.replace(text, F.lit(APOSTROPHE_ENTITY), F.lit("'"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def id_from_file(path: Column, pattern: str = TRAILING_JSON_NUMBER) -> Column:
    """Numeric id at the end of a file name, as text; '' without a match."""
    return F.regexp_extract(path, pattern, 1)


def score_side(score: Column, side: int) -> Column:
    """Goals of one side (1 = home, 2 = away) of a score text such as '2 : 0'."""
    return F.trim(F.split_part(score, F.lit(":"), F.lit(side))).try_cast("int")


def season_start_year(date: Column, rollover_month: int = 7) -> Column:
    """Start year of the season a date belongs to; the rollover month opens the next season."""
    return F.when(F.month(date) >= rollover_month, F.year(date)).otherwise(F.year(date) - 1)


def season_label(start_year: Column) -> Column:
    """2025 -> '2025/26'."""
    following = (start_year.cast("int") + 1).cast("string")
    return F.concat(start_year.cast("string"), F.lit("/"), F.substring(following, 3, 10))


def required(value: Column, message: str) -> Column:
    """The value, or a failing job where it is NULL or ''."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != ""), text).otherwise(F.raise_error(F.lit(message)))


def season_from_title(page: Column, pattern: str = SEASON_IN_TITLE, override: str | None = None) -> Column:
    """Season start year named in a page; an explicit override wins; no match fails the job."""
    if override:
        return F.lit(override)
    return required(F.regexp_extract(page, pattern, 1), "no season in the page title")


def season_from_deadline(deadline: Column, override: str | None = None) -> Column:
    """Season label from the first deadline of a payload (its first four characters)."""
    if override:
        return F.lit(override)
    return required(F.substring(deadline, 1, 4), "payload has no first deadline")


def link(template: str, code: Column) -> Column:
    """Fill an id into a URL template with one `%d`; NULL stays NULL."""
    return F.when(code.isNotNull(), F.format_string(template, code.cast("bigint")))


def contains_pattern(pattern: str, always: Column, optional: Column) -> Column:
    """Case-insensitive pattern search over two columns; a NULL in the second never matches."""
    expression = "(?i)" + pattern
    return always.rlike(expression) | F.coalesce(optional.rlike(expression), F.lit(False))

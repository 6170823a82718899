"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of private text, of what log lines and drafts must not show, and what stands for it.
LINK = r"(?i)https?://\S+"
PRIVATE_WORDS = r"(?i)\b(cookie|session(?:id)?|signature|request[_ -]?url|authorization|chat(?:s|log)?|run\.log|registry)\b"
ABSOLUTE_PATH = r"(?:[A-Za-z]:\\|/(?:Users|home)/)\S+"
NOISE_LINE = r"^[|:\-\s]+$"
DRAFT_WORDS = r"(?i)\b(cookie|sessionid?|signature|request[_ -]?url)\b"
ID_WORDS = r"(?i)\b(job|source|item)[_ -]?id\b"
LONG_DIGITS = r"(?<![0-9])[0-9]{15,24}(?![0-9])"
JOB_NAME = r"(?i)\bitem-[0-9a-f]{20}\b"
SECRET_PAIR = r"(?i)\b(cookie|session|signature|token)\b\s*[=:]\s*\S+"
DIGIT_WORD = r"\b[0-9]{15,24}\b"
NO_PATH, NO_LINK, NO_SECRET, NO_JOB, NO_DIGITS = "[private-path-removed]", "[REDACTED_URL]", "$1=[REDACTED]", "[REDACTED_JOB]", "[REDACTED_ID]"
#: Characters and names that file systems refuse.
FORBIDDEN_NAME = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10))]
NAME_CHARS = 80


def filled(col: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(col), F.lit(""))


def canonical_id(first: Column, second: Column) -> Column:
    """The first non-empty of two ids."""
    return F.coalesce(filled(first), filled(second))


def stable_key(col: Column, prefix: str = "item-") -> Column:
    """Prefix and the first 20 hex digits of the id's SHA-256; where the id stands is no part of it."""
    return F.concat(F.lit(prefix), F.left(F.sha2(col, 256), F.lit(20)))


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(rules):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out


def fold(col: Column) -> Column:
    """Text for comparison without case; ß counts as ss."""
    return F.lower(F.replace(col, F.lit("ß"), F.lit("ss")))


def one_line(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def line_key(col: Column) -> Column:
    """A line without white space and markdown characters, without case."""
    return fold(F.regexp_replace(col, r"(?U)[\s|*_`#>-]+", ""))


def format_time(seconds: Column) -> Column:
    """MM:SS, with milliseconds where there are any; minutes may exceed 59."""
    ms = F.round(seconds * 1000).cast("long")
    base = F.format_string("%02d:%02d", F.floor(ms / 60000), F.pmod(F.floor(ms / 1000), F.lit(60)))
    rest = F.pmod(ms, F.lit(1000))
    return F.when(rest > 0, F.concat(base, F.format_string(".%03d", rest))).otherwise(base)


def parse_time(text: Column) -> Column:
    """Seconds of MM:SS(.mmm) or HH:MM:SS(.mmm); null for other text."""
    whole = r"^(?:([0-9]+):)?([0-9]+):([0-5]?[0-9](?:\.[0-9]+)?)$"
    part = lambda i: F.regexp_extract(text, whole, i)
    hours = F.coalesce(F.nullif(part(1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(F.regexp_like(text, F.lit(whole)), hours * 3600 + F.nullif(part(2), F.lit("")).cast("double") * 60 + F.nullif(part(3), F.lit("")).cast("double"))


def redact(col: Column) -> Column:
    """Links, key=value secrets, job names and long digit ids give way to tokens."""
    out = F.regexp_replace(col, LINK, NO_LINK)
    out = F.regexp_replace(out, SECRET_PAIR, NO_SECRET)
    out = F.regexp_replace(out, JOB_NAME, NO_JOB)
    return F.regexp_replace(out, DIGIT_WORD, NO_DIGITS)


def is_private(col: Column) -> Column:
    return F.regexp_like(col, F.lit(PRIVATE_WORDS)) | F.regexp_like(col, F.lit(LINK))


def cleaned_whole(col: Column) -> Column:
    """One line without absolute paths; null if it is empty, private or nothing but table marks."""
    text = one_line(col)
    keep = (text != "") & ~F.regexp_like(text, F.lit(NOISE_LINE)) & ~is_private(text)
    return F.when(keep, F.regexp_replace(text, ABSOLUTE_PATH, NO_PATH))


def cleaned(col: Column, limit: int = 800) -> Column:
    """``cleaned_whole`` cut at ``limit``."""
    return F.trim(F.left(cleaned_whole(col), F.lit(limit)))


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.str.normalize("NFKC")


def similarity_key(col: Column) -> Column:
    """Composed text without case, digits, a-z and CJK ideographs only."""
    return F.regexp_replace(fold(_composed(col)), "[^0-9a-z\u4e00-\u9fff]+", "")


def safe_component(col: Column, composed: bool = True) -> Column:
    """A name that any file system takes: composed, one line, forbidden characters as -, none of space, dot and hyphen at its ends, at most 80 characters; null for what is refused.

    Empty and reserved names are refused.
    """
    text = _composed(col) if composed else col
    text = F.regexp_replace(one_line(text), FORBIDDEN_NAME, "-")
    whole = F.regexp_replace(F.regexp_replace(text, r"^[ .-]+", ""), r"[ .-]+$", "")
    cut = F.regexp_replace(F.left(whole, F.lit(NAME_CHARS)), r"[ .-]+$", "")
    return F.when((whole != "") & ~F.upper(whole).isin(RESERVED_NAMES), cut)

"""Text expressions. Python only where the JVM lacks Unicode normalisation."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words in brackets at the end of a title that name an edition.
EDITIONS = "deluxe|japanese|remastered|expanded"


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def _without_accents(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)))


def nfc(text: Column) -> Column:
    return _nfc(text)


def without_accents(text: Column) -> Column:
    return _without_accents(text)


def clean(text: Column) -> Column:
    """NFC, without white space at the ends; NULL if nothing is left."""
    return F.nullif(F.regexp_replace(nfc(text), r"^\s+|\s+$", ""), F.lit(""))


def display_list(names: Column) -> Column:
    """Distinct non-empty names in their order, joined by a comma; NULL for none."""
    kept = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def normal_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything between them one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def album_key(artist: Column, title: Column) -> Column:
    return F.concat(F.lower(F.coalesce(artist, F.lit(""))), F.lit("::"), F.lower(F.coalesce(title, F.lit(""))))


def edition_text(text: Column) -> Column:
    """Lower case without any bracketed edition names at the end, however many follow each other."""
    suffixes = rf"(\s*\([^)]*({EDITIONS})[^)]*\)\s*)+$"
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), suffixes, ""))


def identity_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")


def search_text(*columns: str) -> Column:
    """What search tokens are looked for in: the columns joined, lower case, without accents."""
    return F.lower(without_accents(F.concat_ws(" ", *columns)))


def search_tokens(query: str, limit: int = 8) -> list[str]:
    """The first tokens of a query, folded, without accents."""
    folded = "".join(c for c in unicodedata.normalize("NFD", query.casefold()) if not unicodedata.combining(c))
    return folded.split()[:limit]


def matches_all(haystack: Column, tokens: list[str]) -> Column:
    """Every token occurs; % and _ in a token stand for any text and any character."""
    found = F.lit(True)
    for token in tokens:
        found = found & haystack.like(f"%{token}%")
    return found


def id_list(text: Column, limit: int = 500) -> Column:
    """Ids of a comma-separated list: trimmed, non-empty, first occurrences, at most `limit`."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")), 1, limit)


def base64url(data: Column) -> Column:
    """URL-safe base64 without padding and line breaks."""
    plain = F.regexp_replace(F.base64(data), "\r?\n", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def content_kind(raw: Column) -> Column:
    """podcast, music (anything audio), video or the lower-case value itself; music if there is none."""
    low = F.lower(F.trim(raw))
    return (
        F.when(low.contains("podcast"), "podcast")
        .when(low.isin("music", "song", "track") | low.contains("audio"), "music")
        .when(low.contains("video"), "video")
        .otherwise(F.coalesce(F.nullif(low, F.lit("")), F.lit("music")))
    )

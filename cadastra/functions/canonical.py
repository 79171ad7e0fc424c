"""Canonical JSON and fingerprints. Byte-exact number and key formats need Python; it runs on Arrow batches."""

import hashlib
import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Keys that never leave a provider record (anywhere in the key), and whole keys of places of files.
PRIVATE_KEYS = ("password", "token", "credential", "secret", "authorization", "userdata", "playcount", "lastplayed", "favorite", "rating")
PLACE_KEYS = ("path", "filepath", "url", "streamurl", "downloadurl")
_PRIVATE = re.compile("|".join(PRIVATE_KEYS), re.IGNORECASE)


def clean_text(value) -> str | None:
    return None if value is None else unicodedata.normalize("NFC", str(value)).strip() or None


def sanitised(value):
    """A JSON value without private and place keys, texts cleaned, numbers that are not finite as null."""
    match value:
        case dict():
            return {clean_text(k): sanitised(v) for k, v in value.items() if not _PRIVATE.search(str(k)) and str(k).lower() not in PLACE_KEYS}
        case list() | tuple():
            return [sanitised(v) for v in value]
        case str():
            return clean_text(value)
        case float():
            return value if math.isfinite(value) else None
        case bool() | int() | None:
            return value
        case bytes():
            return None
    return clean_text(value)


def canonical(value) -> str:
    """Sanitised JSON with sorted keys and no spaces."""
    return json.dumps(sanitised(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def fingerprint_of(value) -> Column:
    """fingerprint of a value of the driver, as a column."""
    return F.lit(fingerprint(value))


def _parsed(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (v := _parsed(t)) is None else canonical(v))


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text; NULL for NULL, the JSON null and what is no JSON."""
    return _canonical_json(text)


def json_fingerprint(text: Column) -> Column:
    """SHA-256 (hex) of the canonical form of a JSON text."""
    return F.sha2(canonical_json(text), 256)


def _unordered(value, names: frozenset[str], name: str = ""):
    """A JSON value in which the lists under these names (in any case) are in the order of their canonical forms."""
    match value:
        case dict():
            return {k: _unordered(v, names, str(k)) for k, v in value.items()}
        case list():
            items = [_unordered(v, names) for v in value]
            return sorted(items, key=canonical) if name.casefold() in names else items
    return value


def unordered_json(text: Column, *names: str) -> Column:
    """canonical_json in which the order of the lists under these names means nothing."""
    chosen = frozenset(n.casefold() for n in names)

    @F.pandas_udf(StringType())
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := _parsed(t)) is None else canonical(_unordered(v, chosen)))

    return form(text)

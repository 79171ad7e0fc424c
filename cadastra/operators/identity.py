"""Ids of several shapes: the canonical 22-character form, server versions, and re-keying a catalogue."""

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from cadastra.session import salted_join

# Digits of base 62, the last release that still had other ids, and the shapes of ids and of version texts.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST_OTHER_VERSION = (0, 63, 2)
_PLACE = {c: i for i, c in enumerate(ALPHABET)}
_HEX = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_RELEASE = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\s+\(([0-9a-fA-F]{7,40})\))?$"
_BRANCH = r"^(?i)(master|main|dev)(?:\s+\(([0-9a-fA-F]{7,40})\))?$"


def base62(value: int) -> str:
    digits = []
    while value:
        value, rest = divmod(value, 62)
        digits.append(ALPHABET[rest])
    return "".join(reversed(digits)).rjust(22, "0")


def canonical(value: str) -> tuple[str, bool, bool, str]:
    """(canonical id, recognised, changed, shape): 128-bit numbers as 22 digits of base 62; other ids stay."""
    shape, number = "unrecognized", None
    if len(value) == 22 and all(c in _PLACE for c in value):
        number, shape = 0, "base62_128"
        for c in value:
            number = 62 * number + _PLACE[c]
        if number >> 128:
            shape, number = "base62_overflow", int.from_bytes(hashlib.md5(value.encode()).digest())
    elif _HEX.fullmatch(value):
        shape, number = "hex32" if len(value) == 32 else "uuid", int(value.replace("-", ""), 16)
    form = value if number is None or shape == "base62_128" else base62(number)
    return form, number is not None, form != value, shape


_ID = StructType([StructField("value", StringType()), StructField("recognized", BooleanType()), StructField("changed", BooleanType()), StructField("shape", StringType())])


@F.pandas_udf(_ID)
def _canonical(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None, None) if v is None else canonical(v) for v in values], columns=["value", "recognized", "changed", "shape"])


def canonical_id(text: Column) -> Column:
    """Canonical form of an id as struct<value, recognized, changed, shape>; all NULL for NULL. 128 bits need Python."""
    return _canonical(text)


def server_version(text: Column) -> Column:
    """struct<kind, version array<int>, prerelease, commit, branch> of a server's version text."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    part = lambda pattern, i: F.nullif(F.regexp_extract(raw, pattern, i), F.lit(""))
    release, branch = raw.rlike(_RELEASE), raw.rlike(_BRANCH)
    kind = F.when(release & part(_RELEASE, 4).isNotNull(), "prerelease").when(release, "release").when(branch, "branch").otherwise("unknown")
    version = F.when(release, F.array(*[part(_RELEASE, i).try_cast("int") for i in (1, 2, 3)]))
    return F.struct(kind.alias("kind"), version.alias("version"), part(_RELEASE, 4).alias("prerelease"), F.lower(F.coalesce(part(_RELEASE, 5), part(_BRANCH, 2))).alias("commit"), F.lower(part(_BRANCH, 1)).alias("branch"))


def after_last_other_version(text: Column) -> Column:
    """Whether a release is later than the last one with other ids; NULL for what is no release."""
    v = server_version(text)
    return F.when(v["kind"] == "release", v["version"] > F.array(*[F.lit(i) for i in LAST_OTHER_VERSION]))


def inspect_ids(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row on whether ids changed to their canonical form: counts and status.

    status: conflict (old and new form both present), transition_detected, incomplete (25, or a tenth, of the changeable ids are gone in
    both forms) or unchanged.
    """
    old = previous.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__c", canonical_id(F.col(key)))
    now = current.select(F.col(key).alias("__id")).where("__id is not null").distinct()
    same = now.select(F.col("__id").alias(key), F.lit(True).alias("__kept"))
    new = now.select(F.col("__id").alias("__form"), F.lit(True).alias("__moved"))
    state = old.select(key, F.when(F.col("__c.recognized") & F.col("__c.changed"), F.col("__c.value")).alias("__form")).join(same, key, "left").join(new, "__form", "left")
    able, kept, moved = F.col("__form").isNotNull(), F.col("__kept").isNotNull(), F.col("__moved").isNotNull()
    counts = state.agg(
        F.count("*").alias("n_old"),
        F.count_if(able).alias("n_candidates"),
        F.count_if(able & kept & moved).alias("n_duplicate"),
        F.count_if(able & ~kept & moved).alias("n_matched"),
        F.count_if(able & ~kept & ~moved).alias("n_missing"),
    ).select("*", now.agg(F.count("*")).scalar().alias("n_current"))
    status = (
        F.when(F.col("n_duplicate") > 0, "conflict")
        .when(F.col("n_matched") > 0, "transition_detected")
        .when((F.col("n_missing") >= 25) | ((F.col("n_old") > 0) & (F.col("n_missing") >= 0.1 * F.col("n_old"))), "incomplete")
        .otherwise("unchanged")
    )
    return counts.withColumn("status", status)


def rekey_plan(old: DataFrame, new: DataFrame, compared: list[str], library: str = "library") -> DataFrame:
    """entity_type, entity_id, operation (rekey, upsert, delete, unchanged, conflict), old_entity_id.

    old, new: entity_type, entity_id, `compared`. An old id that is gone and whose canonical form is new becomes that one;
    if two old ids, or an old id and one that stays, come to one new id, both are conflicts. Libraries keep their ids.
    """
    fields = F.struct(*compared)
    was = old.groupBy("entity_type", "entity_id").agg(F.max(fields).alias("__was"))
    now = new.groupBy("entity_type", "entity_id").agg(F.max(fields).alias("__now"))
    form = canonical_id(F.col("entity_id"))
    able = was.where(F.col("entity_type") != library).select("entity_type", F.col("entity_id").alias("old_entity_id"), form.alias("__c")).where("__c.recognized and __c.changed")
    moves = able.select("entity_type", "old_entity_id", F.col("__c.value").alias("entity_id")).join(now.select("entity_type", "entity_id"), ["entity_type", "entity_id"])
    claims = moves.groupBy("entity_type", "entity_id").agg(F.count("*").alias("__claims"), F.min("old_entity_id").alias("old_entity_id"))
    both = was.join(now, ["entity_type", "entity_id"], "full_outer").join(claims, ["entity_type", "entity_id"], "left")
    gone = moves.select("entity_type", F.col("old_entity_id").alias("entity_id"), F.lit(True).alias("__moved"))
    state = both.join(gone, ["entity_type", "entity_id"], "left")
    claimed, stays = F.col("__claims").isNotNull(), F.col("__was").isNotNull() & F.col("__now").isNotNull()
    operation = (
        F.when(claimed & ((F.col("__claims") > 1) | F.col("__was").isNotNull()), "conflict")
        .when(claimed, "rekey")
        .when(stays & F.col("__was").eqNullSafe(F.col("__now")), "unchanged")
        .when(F.col("__now").isNotNull(), "upsert")
        .when(F.col("__moved").isNull(), "delete")
    )
    out = state.withColumn("operation", operation).where("operation is not null")
    return out.select("entity_type", "entity_id", "operation", F.when(F.col("operation") == "rekey", F.col("old_entity_id")).alias("old_entity_id"))


def _names(value) -> set[str]:
    """All texts of a JSON value: members' names and values that are texts."""
    match value:
        case str():
            return {value}
        case list():
            return set().union(*map(_names, value))
        case dict():
            return set(value).union(*map(_names, value.values()))
    return set()


def _exchanged(value, new: dict[str, str]):
    """A JSON value with whole texts exchanged; two members that come to one name are an error."""
    match value:
        case str():
            return new.get(value, value)
        case list():
            return [_exchanged(v, new) for v in value]
        case dict():
            out = {new.get(k, k): _exchanged(v, new) for k, v in value.items()}
            if len(out) < len(value):
                raise KeyError("two members of one name")
            return out
    return value


def _loaded(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def _texts_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(_names(_loaded(t))))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("collides", BooleanType())]))
def _with_new_ids(texts: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(texts, old, new):
        value = _loaded(text)
        try:
            rows.append((text if value is None or a is None or not len(a) else json.dumps(_exchanged(value, dict(zip(a, b))), ensure_ascii=False, separators=(",", ":")), False))
        except KeyError:
            rows.append((None, True))
    return pd.DataFrame(rows, columns=["text", "collides"])


def rewritten_json(rows: DataFrame, key: str, text: str, mapping: DataFrame) -> DataFrame:
    """`key`, text, collides: JSON texts in which every member name and value that is an old id as a whole is the new one; parts of texts stay.

    rows: `key` (distinct, not NULL), `text`. mapping: old_id, new_id. An old id with several new ones is an error. Where two
    members come to one name, text is NULL and collides is true. NULL and what is no JSON stays as it is. The texts' own strings are joined
    with the mapping by salts, so the mapping may have any size; a row gets only the ids that it holds.
    """
    one = mapping.where("old_id is not null and new_id is not null").groupBy("old_id").agg(F.min("new_id").alias("new_id"), (F.min("new_id") != F.max("new_id")).alias("__several"))
    if one.where("__several").limit(1).count():
        raise ValueError("an id has several new ids")
    held = rows.select(F.col(key).alias("__key"), F.explode(_texts_of(F.col(text))).alias("old_id"))
    met = salted_join(held, one.drop("__several"), ["old_id"], [F.col("__key")])
    found = met.groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("old_id", "new_id"))).alias("__ids"))
    both = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(found, "__key", "left")
    done = both.withColumn("__new", _with_new_ids(F.col("__text"), F.col("__ids.old_id"), F.col("__ids.new_id")))
    return done.select(F.col("__key").alias(key), "__new.text", "__new.collides")

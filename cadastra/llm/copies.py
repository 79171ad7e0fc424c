"""Duplicates hidden by formatting differences (problem 3)."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, salted_join, stored

#: Bits for each hash, at every size, and the bits of a filter that are set for it.
BITS_PER_ROW, PROBES = 8, 4
#: Bits of a segment, the unit in which filters are merged (128 KB), and the most segments that are held at a time.
SEGMENT_BITS, RANGE_SEGMENTS = 1 << 20, 512
#: Hashes of a partition that are sorted by segment at a time.
FILL = 1 << 20
_NOT_CONTENT = r"[^\p{L}\p{M}\p{N}]"


def reduced(text: Column) -> Column:
    """Letters, marks and numbers of a text in lower case, all else removed; NULL stays NULL."""
    return F.regexp_replace(F.lower(text), _NOT_CONTENT, "")


def content_set(fields: list[str], paired: list[str] = ()) -> Column:
    """The set of non-empty reduced values of `fields` and of the sides (around ::) of `paired`, as one text.

    Sides and fields stand in sorted order, so the order of the fields does not matter. All NULL or empty: empty text.
    """
    sides = [F.coalesce(F.split(F.col(c), "::"), F.array().cast("array<string>")) for c in paired]
    values = F.concat(F.array(*[F.col(c).cast("string") for c in fields]), *sides)
    kept = F.filter(F.transform(values, reduced), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(kept)), "|")


def group_key(scope: list[str], content: Column) -> Column:
    """Scope columns and content as one text; NULL is a scope of its own."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in scope]
    return F.concat_ws("/", *parts, content)


def n_segments(rows: int, segment_bits: int = SEGMENT_BITS) -> int:
    """Segments of a filter of so many hashes: as many as BITS_PER_ROW asks for, so filters fill alike at every size."""
    return max(1, -(-rows * BITS_PER_ROW // segment_bits))


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash, by its upper half; it rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def segment_of(hash_: Column, segments: int) -> Column:
    """_segment as a column of signed hashes."""
    return F.shiftright(F.shiftrightunsigned(hash_, 32) * segments, 32)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash within its segment, by double hashing."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    low, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) & np.uint64(bits - 1)


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def filter_segments(hashes: DataFrame, segments: int, repeated: bool = True, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """segment, bits of a Bloom filter of the hashes that occur more than once (or of all, if not `repeated`).

    hashes: one bigint column without NULLs. The space of hashes is cut into `segments` ranges with a filter each. Every
    partition makes its part of each filter: the hashes it saw once and those it saw again. A part is sent as the hashes
    that set it, which are fewer bytes than its bits as soon as there is more than one partition. Merged by segment, a hash
    is seen again if a part saw it again or if it is in the filter of those seen before; so no repeat is missed and some
    hashes pass by chance, as many of a thousand at every size. A task holds one segment's two filters. A hash with a
    third of all rows is one value of each part. Segments with no bit set give no row.
    """
    size = segment_bits // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def parts() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(waiting).view(np.uint64), return_counts=True)
            at = _segment(values, segments)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.r_[first[1:], len(values)]
            data = [[x[a:b].tobytes() for a, b in zip(first, ends)] for x in (values, counts > 1)]
            return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int64)), *(pa.array(x, pa.binary()) for x in data)], names=["segment", "seen", "again"])

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(batch)
            if n >= FILL:
                yield parts()
                waiting, n = [], 0
        if n:
            yield parts()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, again = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([(again if repeated else once).tobytes()])], names=["segment", "bits"])
        for batch in batches:
            for segment, seen, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != now:
                    if now is not None and (again if repeated else once).any():
                        yield row()
                    now, once, again = segment, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                at = _positions(np.frombuffer(seen, np.uint64), segment_bits)
                if repeated:
                    _set(again, at[np.frombuffer(twice, bool) | _has(once, at)])
                _set(once, at)
        if now is not None and (again if repeated else once).any():
            yield row()

    parts = hashes.mapInArrow(fill, "segment bigint, seen binary, again binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(fold, "segment bigint, bits binary")


class Range:
    """The filter of one range of hashes: at most RANGE_SEGMENTS segments, which bounds what is collected and broadcast (64 MB)."""

    def __init__(self, filters: DataFrame, number: int, segments: int, segment_bits: int, range_segments: int) -> None:
        self.segments, self.bits, self.first = segments, segment_bits, number * range_segments
        held, size = min(range_segments, segments - self.first), segment_bits // 8
        data = np.zeros(held * size, np.uint8)
        for k, bits in filters.where(F.col("segment").between(self.first, self.first + held - 1)).toLocalIterator():
            at = (k - self.first) * size
            data[at : at + size] = np.frombuffer(bits, np.uint8)
        self.shared = filters.sparkSession.sparkContext.broadcast(data.tobytes())

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], np.int64).view(np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether hashes (uint64) are in the filter; False for those of other ranges."""
        data = np.frombuffer(self.shared.value, np.uint8)
        at = _segment(hashes, self.segments).astype(np.int64) - self.first
        own = (at >= 0) & (at < len(data) * 8 // self.bits)
        positions = _positions(hashes, self.bits) + (np.where(own, at, 0) * self.bits).astype(np.uint64)[:, None]
        return own & _has(data, positions)


def keyed(items: DataFrame, item_id: str, scope: list[str], fields: list[str], paired: list[str] = ()) -> DataFrame:
    """Items as id, `scope`, __key (what copies share), __hash (of the key)."""
    return items.select(F.col(item_id).alias("__id"), *scope, group_key(scope, content_set(fields, paired)).alias("__key")).withColumn("__hash", F.xxhash64("__key"))


def split_repeats(rows: DataFrame, n_rows: int, segment_bits: int = SEGMENT_BITS, range_segments: int = RANGE_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """`rows` of keyed() as (possible repeats, sure singletons); the first keep all true repeats.

    n_rows: about the number of rows, which the filters are sized by. The rows are written once, apart by range of their
    hashes if there is more than one range; each range's rows are then asked for in their filter, where they are. So only
    the hashes are shuffled, 8 bytes each, and of a corpus of any size one filter of bounded size is broadcast per range.
    """
    segments = n_segments(n_rows, segment_bits)
    ranges = -(-segments // range_segments)
    if ranges == 1:
        kept = stored(rows)
    else:
        kept = stored(rows.withColumn("__range", F.floor(segment_of(F.col("__hash"), segments) / range_segments)), "__range")
    filters = checkpointed(filter_segments(kept.select("__hash"), segments, True, segment_bits))

    def judged(number: int) -> DataFrame:
        filter_ = Range(filters, number, segments, segment_bits, range_segments)

        @F.pandas_udf("boolean")
        def repeats(hashes: pd.Series) -> pd.Series:
            return pd.Series(filter_.has(hashes.to_numpy(np.int64).view(np.uint64)))

        own = kept if ranges == 1 else kept.where(F.col("__range") == number).drop("__range")
        return own.withColumn("__again", repeats("__hash"))

    all_ = reduce(DataFrame.unionByName, map(judged, range(ranges)))
    return all_.where("__again").drop("__again"), all_.where("NOT __again").drop("__again")


def copy_groups(possible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, groups) of possible repeats: items once per key and id; groups as __key, keep_id, n_copies."""
    items = possible.select("__key", "__id").where("__id is not null").distinct()
    return items, items.groupBy("__key").agg(F.min("__id").alias("keep_id"), F.count("*").alias("n_copies"))


def formatting_copies(items: DataFrame, item_id: str, scope: list[str], fields: list[str], paired: list[str] = (), **sizes: int) -> DataFrame:
    """keep_id, copy_id: each item that repeats another of its scope but for formatting, with the smallest id of its set.

    Items are equal if the sets of their reduced values are (see content_set). Rows repeated with the same id are one
    item. Sets of values that are all empty are equal too. A row without id names no item and is left out; an id that
    comes with several contents is an item in each. Only possible repeats (see filter_segments; `sizes` are its parameters) are shuffled, for exact
    grouping on the text itself. A set with a third of all items is one row after partial aggregation; joining its
    members to it is salted by id.
    """
    possible, _ = split_repeats(keyed(items, item_id, scope, fields, paired), items.count(), **sizes)
    members, groups = copy_groups(checkpointed(possible.select("__key", "__id")))
    pairs = salted_join(members, groups.where("n_copies > 1"), ["__key"], [F.col("__id")])
    return pairs.where("__id <> keep_id").select("keep_id", F.col("__id").alias("copy_id"))


def collapsed(items: DataFrame, item_id: str, scope: list[str], fields: list[str], paired: list[str] = (), **sizes: int) -> DataFrame:
    """One row per set of equal items: `scope`, keep_id (the smallest id), n_copies (distinct ids); singletons included."""
    possible, single = split_repeats(keyed(items, item_id, scope, fields, paired), items.count(), **sizes)
    grouped = possible.where("__id is not null").select(*scope, "__key", "__id").distinct().groupBy("__key", *scope).agg(F.min("__id").alias("keep_id"), F.count("*").alias("n_copies"))
    alone = single.where("__id is not null").select(*scope, F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("n_copies"))
    return grouped.select(*scope, "keep_id", "n_copies").unionByName(alone)

"""Filling fixed-capacity containers with items (problem 7)."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.tokens import RANKS, encoder, read_ranks
from cadastra.session import checkpointed, shuffle_partitions, spread

CAPACITY = 2048


@dataclass
class Plan:
    """Which ranks of each length go to which containers.

    A segment (length, first, per, base, n) says: the items of that length with ranks first, first + 1, ... fill the
    containers base, base + 1, ..., base + n - 1 with `per` items each.
    """

    capacity: int
    containers: int = 0
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def fullest(reach: list[int], lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within the capacity; on a tie the one with the longest items.

    reach[i] is a bit set: the sums that the i shortest lengths can make with their counts.
    """
    total = reach[len(lengths)].bit_length() - 1
    chosen, left = {}, total
    for i in range(len(lengths) - 1, -1, -1):
        length = lengths[i]
        take = min(left // length, counts[length])
        while take and not reach[i] >> (left - take * length) & 1:
            take -= 1
        if take:
            chosen[length] = take
            left -= take * length
    return chosen


def extend(reach: int, length: int, count: int, mask: int) -> int:
    """The sums that `count` further items of a length can add, by doubling."""
    step = 1
    while count > 0:
        take = min(step, count)
        reach |= (reach << (take * length)) & mask
        count -= take
        step *= 2
    return reach


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack over a histogram of lengths (1 to capacity).

    Again and again the fullest feasible combination of the lengths that are left is found by subset sums over bit sets
    and removed as often as the counts allow, which is what removing it container by container comes to: the
    combination stays the fullest, and the first among equals, while enough items are left. Every round leaves a length
    with fewer items than the round took of it at a time, so rounds depend on the capacity, not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan, used, mask = Plan(capacity), dict.fromkeys(left, 0), (1 << (capacity + 1)) - 1
    lengths = sorted(left)
    reach = [1]
    while lengths:
        for i in range(len(reach) - 1, len(lengths)):
            reach.append(extend(reach[i], lengths[i], min(left[lengths[i]], capacity // lengths[i]), mask))
        chosen = fullest(reach, lengths, left, capacity)
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            plan.segments.append((n, used[n], k, plan.containers, times))
            used[n] += k * times
            left[n] -= k * times
        plan.containers += times
        # sums stay as they are below the shortest length whose usable count changed
        changed = min((n for n in chosen if left[n] < capacity // n), default=None)
        if changed is not None:
            reach = reach[: lengths.index(changed) + 1]
            lengths = [n for n in lengths if left[n]]
    return plan


def token_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens of every text that is neither NULL nor empty. Whole texts are encoded."""
    ranks, kind = read_ranks(path), docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[doc_id, "n_tokens"])

    return spread(docs.select(doc_id, text), doc_id).where(f"{text} is not null and {text} <> ''").mapInArrow(count, f"{doc_id} {kind}, n_tokens bigint")


def pack(sizes: DataFrame, item_id: str, size: str, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """container, item_id, part, start, length: every item laid into containers of `capacity`.

    An item within the capacity is one part in one container. A longer one is cut into full containers of its own and a
    rest, which is laid like any item. Sizes of 0, less or NULL take no part. Rows repeated with the same id are items of
    their own. Ids may be NULL.

    The driver sees only the histogram of lengths, at most `capacity` rows whatever the number of items, and makes the
    plan by minimum bin slack (slack_plan). Items are ranked within their length to take their places in it: a length
    may hold a third of all items, so each is ranked in `buckets` hash buckets, whose offsets (capacity x buckets rows)
    are summed by length. The plan's segments are bounded by the capacity too and are sent with the tasks.
    """
    spark, kind = sizes.sparkSession, sizes.schema[item_id].dataType.simpleString()
    buckets = buckets or 4 * shuffle_partitions(spark)
    known = sizes.where(F.col(size) > 0).select(F.col(item_id).alias("__id"), F.col(size).cast("bigint").alias("__size"))
    full = F.expr(f"CASE WHEN __size > {capacity} THEN transform(sequence(0, cast(ceil(__size / {capacity}) as int) - 1), i -> struct(i as part, i * {capacity}L as start, least({capacity}L, __size - i * {capacity}L) as length)) ELSE array(struct(0 as part, 0L as start, __size as length)) END")
    parts = known.select("__id", F.explode(full).alias("__p")).select("__id", "__p.*", F.pmod(F.xxhash64("__id", "__p.part"), F.lit(buckets)).alias("__bucket"))
    parts = checkpointed(parts)
    by_bucket = parts.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__id", "part")) - 1
    ranked = parts.withColumn("__place", place).join(offsets, ["length", "__bucket"])
    rows = ranked.select("__id", "part", "start", "length", (F.col("__place") + F.col("__offset")).alias("__rank"))

    plan = slack_plan(counts, capacity)
    table = np.array(sorted(plan.segments), dtype=np.int64).reshape(-1, 5)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key that sorts by length, then by first rank
        span = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 2]
            yield pa.RecordBatch.from_arrays([pa.array(container), batch.column(0), batch.column(1), batch.column(2), batch.column(3)], names=["container", item_id, "part", "start", "length"])

    return rows.mapInArrow(assign, f"container bigint, {item_id} {kind}, part int, start bigint, length bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers any packing needs by volume, and the part filled."""
    by = packed.groupBy("container").agg(F.sum("length").alias("used"))
    total = by.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("largest"))
    return total.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).cast("bigint").alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("filled"), "largest")

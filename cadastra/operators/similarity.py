"""Similar albums and artists from the vectors, energies and moods of their tracks.

Tracks: entity, id, order (bigint), embedding (array<float>), energy (double), mood (array<double>), album, year.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import interval, interval_distance
from cadastra.functions.vectors import cosine_distance, vector_mean
from cadastra.operators.ranks import with_group_position
from cadastra.session import checkpointed, salted_join, shuffle_partitions

# Weights and thresholds of the scores.
ALBUM_WEIGHTS = {"core": 0.38, "poles": 0.22, "spread": 0.14, "energy": 0.10, "mood": 0.08, "path": 0.08}
ARTIST_WEIGHTS = {"poles": 0.32, "core": 0.22, "spread": 0.14, "outliers": 0.12, "energyMood": 0.12, "trajectory": 0.08}
REASON, CORE_REASON = 0.18, 0.12


@dataclass(frozen=True)
class Bounds:
    """Bounds of the work per entity. Fixed values by default; probes=None searches exactly."""

    sample: int = 160  #: tracks of an entity's fingerprint,
    edges: int = 12  #: of them the farthest from its mean
    nearest: int = 96  #: tracks per query vector
    candidates: int = 384  #: candidates per entity
    queries: int = 8  #: query vectors per entity
    top: int = 12  #: results per entity
    probes: float | None = None  #: share of the lists of an index that each query vector searches


DEFAULT = Bounds()
#: Query vectors and vectors that one task compares; more of either are more tasks.
BLOCK, PART = 4096, 65536
#: Distances that are held at a time.
_HELD = 1 << 22
#: Vectors that an index is fitted on, and the most lists of one; every vector is in a list.
FITTED, MOST_LISTS = 65536, 4096
#: Share of the lists that finds 9 of 10 neighbours among vectors without clusters, the worst case; clustered ones need far fewer.
PROBES = 0.65

_STATS = "struct<low double, high double, mean double, q1 double, q3 double>"
_MOODS = "struct<low array<double>, high array<double>, mean array<double>, q1 array<double>, q3 array<double>>"
_POLES = "array<struct<id string, embedding array<float>, weight double>>"
ALBUM_SCHEMA = f"entity string, mean array<float>, poles {_POLES}, spread struct<center double, farthest double, pairwise double, widest double>, path struct<mean_step double, longest double, total double, net double>, energy {_STATS}, mood {_MOODS}"
ARTIST_SCHEMA = f"entity string, core array<array<float>>, poles {_POLES}, outliers array<array<float>>, spread struct<pairwise double, p50 double, p90 double, widest double>, energy {_STATS}, mood {_MOODS}, trajectory struct<mean_step double, p50 double, longest double, net double>"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows of a to all rows of b, within 0 and 2; 1 where a vector has no length."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.clip(1 - a @ b.T / lengths, 0, 2)
    return np.where(lengths > 0, found, 1.0)


def _mean_vector(vectors: np.ndarray) -> np.ndarray:
    return np.asarray(vectors, np.float64).mean(axis=0).astype(np.float32)


def _stats(values) -> dict:
    known = np.sort(np.array([v for v in values if v is not None and v == v], np.float64))
    if not len(known):
        return dict.fromkeys(("low", "high", "mean", "q1", "q3"), 0.0)
    return {"low": known[0], "high": known[-1], "mean": known.mean(), "q1": np.quantile(known, 0.25), "q3": np.quantile(known, 0.75)}


def _mood_stats(moods) -> dict:
    known = np.array([list(m) for m in moods if m is not None], np.float64)
    if not len(known):
        return {k: [] for k in ("low", "high", "mean", "q1", "q3")}
    quantiles = np.quantile(known, [0.25, 0.75], axis=0)
    return {k: list(v) for k, v in zip(("low", "high", "mean", "q1", "q3"), (known.min(0), known.max(0), known.mean(0), *quantiles))}


def _poles(pairs: np.ndarray, first: int, most: int, least: float) -> tuple[list[int], np.ndarray]:
    """Medoids by farthest points from `first`, at least `least` apart, refined twice; and the cluster of every row.

    Rows stand in their order, so the first of equals is the one with the smallest order and id.
    """
    chosen = [first]
    while len(chosen) < most:
        nearest = pairs[:, chosen].min(axis=1)
        nearest[chosen] = -1
        far = int(np.argmax(nearest))
        if nearest[far] < least or far in chosen:
            break
        chosen.append(far)
    for _ in range(2):
        cluster = np.argmin(pairs[:, chosen], axis=1)
        for k in range(len(chosen)):
            rows = np.flatnonzero(cluster == k)
            if len(rows):
                chosen[k] = int(rows[np.argmin(pairs[np.ix_(rows, rows)].sum(axis=1))])
    return chosen, np.argmin(pairs[:, chosen], axis=1)


def _upper(pairs: np.ndarray) -> np.ndarray:
    return pairs[np.triu_indices(len(pairs), 1)]


def _or_zero(values: np.ndarray, f) -> float:
    return float(f(values)) if len(values) else 0.0


def album_fingerprint(entity: str, tracks: pd.DataFrame) -> dict:
    """Fingerprint of an album's sampled tracks, in their order."""
    vectors = np.stack(tracks["embedding"].to_list()).astype(np.float32)
    mean, pairs = _mean_vector(vectors), distances(vectors, vectors)
    np.fill_diagonal(pairs, 0)
    center = distances(vectors, mean[None, :])[:, 0]
    medoids, cluster = _poles(pairs, int(np.argmin(center)), 3, 0.12)
    steps, between = np.diagonal(pairs, 1), _upper(pairs)
    total = float(steps.sum())
    return {
        "entity": entity,
        "mean": mean,
        "poles": [{"id": str(tracks["id"].iloc[m]), "embedding": vectors[m], "weight": float((cluster == k).mean())} for k, m in enumerate(medoids)],
        "spread": {"center": center.mean(), "farthest": center.max(), "pairwise": _or_zero(between, np.mean), "widest": _or_zero(between, np.max)},
        "path": {"mean_step": _or_zero(steps, np.mean), "longest": _or_zero(steps, np.max), "total": total, "net": float(pairs[0, -1]) / total if total else 0.0},
        "energy": _stats(tracks["energy"]),
        "mood": {**_mood_stats(tracks["mood"]), "q1": [], "q3": []},
    }


def artist_fingerprint(entity: str, tracks: pd.DataFrame, albums: pd.DataFrame) -> dict:
    """Fingerprint of an artist's sampled tracks, and of the medoids of its albums in order of years."""
    vectors = np.stack(tracks["embedding"].to_list()).astype(np.float32)
    pairs = distances(vectors, vectors)
    np.fill_diagonal(pairs, 0)
    n, between = len(vectors), np.sort(_upper(pairs))
    quantile = lambda q: _or_zero(between, lambda x: np.quantile(x, q))
    spread = {"pairwise": _or_zero(between, np.mean), "p50": quantile(0.5), "p90": quantile(0.9), "widest": _or_zero(between, np.max)}
    core = np.argsort(pairs.sum(axis=1), kind="stable")[:3]
    medoids, cluster = _poles(pairs, int(core[0]), min(4, n), max(0.08, 0.85 * spread["p50"]))
    poles = [{"id": str(tracks["id"].iloc[m]), "embedding": vectors[m], "weight": float((cluster == k).mean())} for k, m in enumerate(medoids)]
    from_core = pairs[:, core].min(axis=1)
    far = [int(i) for i in np.argsort(-from_core, kind="stable") if i not in core and from_core[i] >= max(0.12, 1.1 * spread["pairwise"], 0.9 * spread["p50"])][:5]
    trajectory = None
    if len(albums) >= 3:
        stops = np.stack(albums["embedding"].to_list())
        steps = np.array([distances(stops[i : i + 1], stops[i + 1 : i + 2])[0, 0] for i in range(len(stops) - 1)])
        trajectory = {"mean_step": steps.mean(), "p50": np.quantile(steps, 0.5), "longest": steps.max(), "net": distances(stops[:1], stops[-1:])[0, 0]}
    return {
        "entity": entity,
        "core": [vectors[i] for i in core],
        "poles": sorted(poles, key=lambda p: (-p["weight"], p["id"])),
        "outliers": [vectors[i] for i in far],
        "spread": spread,
        "energy": _stats(tracks["energy"]),
        "mood": _mood_stats(tracks["mood"]),
        "trajectory": trajectory,
    }


def sampled(tracks: DataFrame, dimension: int, bounds: Bounds = DEFAULT) -> DataFrame:
    """At most bounds.sample tracks of every entity: the bounds.edges farthest from its mean and an even spread over its order.

    Entities of any size: means, counts and the farthest are aggregated before the shuffle (a limited rank in every
    task first), and places in the order are counted over ranges. Entities within the bound are kept whole.
    """
    placed = with_group_position(tracks, ["entity"], ["order", "id"], "place")
    about = placed.groupBy("entity").agg(vector_mean(F.col("embedding"), dimension).alias("__mean"), F.count("*").alias("__n"))
    known = salted_join(placed, about, ["entity"], [F.col("id")]).withColumn("__far", -cosine_distance(F.col("embedding"), F.col("__mean")))
    small = known.where(F.col("__n") <= bounds.sample)
    large = known.where(F.col("__n") > bounds.sample)
    edge = large.withColumn("__r", F.row_number().over(Window.partitionBy("entity").orderBy("__far", "order", "id"))).where(F.col("__r") <= bounds.edges).drop("__r")
    slots = bounds.sample - bounds.edges
    # places round(i / (slots - 1) * (n - 1)) for i = 0, 1, ..., slots - 1: a place is one if some i rounds to it
    at = (F.col("place") - 1) * (slots - 1) / (F.col("__n") - 1)
    hit = lambda i: F.bround(i / (slots - 1) * (F.col("__n") - 1), 0) == F.col("place") - 1
    even = large.where(hit(F.floor(at)) | hit(F.ceil(at)))
    return small.unionByName(edge).unionByName(even).drop("__mean", "__n", "__far", "place").dropDuplicates(["entity", "id"])


def album_fingerprints(tracks: DataFrame, dimension: int, bounds: Bounds = DEFAULT) -> DataFrame:
    """A fingerprint (ALBUM_SCHEMA) of every entity; tracks without a vector of the dimension are left out."""
    known = tracks.where(F.size("embedding") == dimension)
    return sampled(known, dimension, bounds).groupBy("entity").applyInPandas(lambda key, rows: pd.DataFrame([album_fingerprint(key[0], rows.sort_values(["order", "id"]))]), ALBUM_SCHEMA)


def album_medoids(tracks: DataFrame, dimension: int) -> DataFrame:
    """Of every entity's dated albums the track nearest to the album's mean: entity, year, album_key, embedding."""
    dated = tracks.where("album is not null and year is not null").withColumn("album_key", F.lower(F.trim("album")))
    keys = ["entity", "year", "album_key"]
    means = dated.groupBy(*keys).agg(vector_mean(F.col("embedding"), dimension).alias("__mean"))
    near = salted_join(dated, means, keys, [F.col("id")]).withColumn("__d", cosine_distance(F.col("embedding"), F.col("__mean")))
    return near.groupBy(*keys).agg(F.min_by("embedding", F.struct("__d", "order", "id")).alias("embedding"))


def artist_fingerprints(tracks: DataFrame, dimension: int, bounds: Bounds = DEFAULT) -> DataFrame:
    """A fingerprint (ARTIST_SCHEMA) of every entity."""
    known = tracks.where(F.size("embedding") == dimension)
    stops = album_medoids(known, dimension)
    stops = stops.select(*[F.col(c).alias(f"stop_{c}") for c in stops.columns])
    make = lambda key, rows, albums: pd.DataFrame([artist_fingerprint(key[0], rows.sort_values(["order", "id"]), albums.rename(columns=lambda c: c.removeprefix("stop_")).sort_values(["year", "album_key"]))] if len(rows) else [])
    return sampled(known, dimension, bounds).groupBy("entity").cogroup(stops.groupBy("stop_entity")).applyInPandas(make, ARTIST_SCHEMA)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, probes: float | None = None) -> DataFrame:
    """query, id, distance, rank: the k nearest vectors of every query by cosine distance (rounded to 9), then id.

    queries: query, embedding; vectors: id, embedding; ids of one type. Only vectors of a query's dimension are compared;
    NULL and empty embeddings are left out. Both sides are cut into blocks by hashes of their ids, and each task compares
    one block of either in matrix products, so one plan serves any number of queries and nothing passes the driver. Of a
    block pair only the k nearest of each query are written, and the best of those are ranked with a limited rank in every task first.

    Without `probes` every block meets every other, which is exact and grows with queries times vectors. With `probes` the
    vectors are kept in inverted lists (see fit_lists) and a query is compared with the vectors of this share of them, the
    nearest: all vectors are in the lists, but a neighbour in another list is missed. A list of any size is cut into parts.
    """
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    ask = queries.select("query", "embedding", F.size("embedding").alias("__dim")).where("__dim > 0")
    have = vectors.select("id", "embedding", F.size("embedding").alias("__dim")).where("__dim > 0")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if probes is None:
        blocks = max(1, -(-ask.count() // BLOCK))
        parts = max(shuffle_partitions(vectors.sparkSession), -(-have.count() // PART))
        ask = ask.withColumn("__cell", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("__part", numbers(parts))
        have = have.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("__cell", numbers(blocks))
    else:
        lists = fit_lists(have)
        have, ask = in_lists(have, "id", lists, 0), in_lists(ask, "query", lists, probes)
        # a row for each list, MOST_LISTS at most
        sizes = F.broadcast(checkpointed(have.groupBy("__cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts"))))
        have = have.join(sizes, "__cell").withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts"))).drop("__parts")
        ask = ask.join(sizes, "__cell").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")

    def compare(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        out = [pa.table({"query": asked["query"].slice(0, 0), "id": known["id"].slice(0, 0), "distance": pa.array([], pa.float64())})]
        if len(asked) and len(known):
            known = known.sort_by("id").combine_chunks()
            first, second = (t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (asked, known))
            step = max(1, _HELD // len(known))
            for at in range(0, len(asked), step):
                d = np.round(distances(first[at : at + step], second), 9)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(at, at + len(d)), order.shape[1])
                out.append(pa.table({"query": asked["query"].take(rows), "id": known["id"].take(order.ravel()), "distance": np.take_along_axis(d, order, 1).ravel()}))
        return pa.concat_tables(out)

    keys = ["__dim", "__cell", "__part"]
    found = ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(compare, f"query {kinds[0]}, id {kinds[1]}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def fit_lists(vectors: DataFrame, rounds: int = 8) -> dict[int, np.ndarray]:
    """Centres of the lists of an index for each dimension: spherical means of FITTED vectors, those with the smallest hashes.

    vectors: id, embedding, __dim. As many lists as the root of the number of vectors, MOST_LISTS at most.
    """
    counts = {r["__dim"]: r["n"] for r in vectors.groupBy("__dim").agg(F.count("*").alias("n")).collect()}
    lists = {}
    for dimension, n in counts.items():
        rows = vectors.where(F.col("__dim") == dimension).orderBy(F.xxhash64("id")).limit(FITTED).select("embedding").toArrow()
        sample = _unit(rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64))
        centres = sample[: max(1, min(MOST_LISTS, round(n**0.5), len(sample)))].copy()
        for _ in range(rounds):
            own = np.argmax(sample @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, sample)
            centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, _unit(sums), centres)
        lists[dimension] = centres.astype(np.float32)
    return lists


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1)


def in_lists(rows: DataFrame, key: str, lists: dict[int, np.ndarray], probes: float) -> DataFrame:
    """`key`, embedding, __dim, __cell: rows of `key`, embedding, __dim once for each of the lists nearest to them, a share of them or one."""
    shared = rows.sparkSession.sparkContext.broadcast(lists)
    kind = rows.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dimension, some in batch.groupby("__dim"):
                if dimension in shared.value:
                    near = np.stack(some["embedding"].to_list()).astype(np.float32) @ shared.value[dimension].T
                    most = max(1, round(probes * near.shape[1]))
                    yield some.assign(__cells=list(np.argsort(-near, axis=1, kind="stable")[:, :most]))

    placed = rows.select(key, "embedding", "__dim").mapInPandas(place, f"`{key}` {kind}, embedding array<float>, __dim int, __cells array<int>")
    return placed.select(key, "embedding", "__dim", F.explode("__cells").alias("__cell"))


def candidates(queries: DataFrame, tracks: DataFrame, bounds: Bounds = DEFAULT) -> DataFrame:
    """entity, candidate: entities that own the nearest tracks of an entity's query vectors, at most bounds.candidates each.

    queries: entity, vectors (array, of which bounds.queries count). Tracks of all vectors are merged by rank, then vector, then id;
    an entity stands where its first track does.
    """
    single = queries.select("entity", F.posexplode(F.slice("vectors", 1, bounds.queries)).alias("n", "embedding")).withColumn("query", F.concat_ws("\n", "n", "entity"))
    found = nearest(single, tracks.select(F.col("id").cast("string").alias("id"), "embedding"), bounds.nearest, bounds.probes)
    owned = found.join(tracks.select(F.col("id").cast("string").alias("id"), F.col("entity").alias("candidate")), "id").withColumns({"entity": F.expr("substring(query, instr(query, '\n') + 1)"), "n": F.substring_index("query", "\n", 1).cast("int")})
    seen = owned.where("candidate <> entity").groupBy("entity", "candidate").agg(F.min(F.struct("rank", "n", "id")).alias("__first"))
    return seen.withColumn("__r", F.row_number().over(Window.partitionBy("entity").orderBy("__first"))).where(F.col("__r") <= bounds.candidates).select("entity", "candidate")


def _clipped(value: float) -> float:
    """A distance within 0 and 1; what is no number is as far as can be."""
    return float(np.nan_to_num(np.clip(value, 0, 1), nan=1.0))


def _nearest_mean(a, b, penalty=0.0) -> float:
    return float((distances(a, b) + penalty).min(axis=1).mean())


def _both_ways(a, b, weights_a=None, weights_b=None) -> float:
    if not len(a) or not len(b):
        return 0.0 if not len(a) and not len(b) else 1.0
    a, b = np.stack(list(a)), np.stack(list(b))
    apart = 0.0 if weights_a is None else 0.25 * np.abs(np.subtract.outer(weights_a, weights_b))
    return _clipped((_nearest_mean(a, b, apart) + _nearest_mean(b, a, np.transpose(apart))) / 2)


def _narrower(source: float, candidate: float, part: float) -> float:
    """Extra distance of a candidate much narrower than a wide source."""
    return 0.12 if source >= 0.18 and candidate < part * source else 0.0


def _reasons(parts: dict[str, float]) -> list[str]:
    near = [name for d, name in sorted((d, name) for name, d in parts.items() if d < REASON)][:2]
    return near if "core" in near or parts["core"] >= CORE_REASON else ["core", *near]


def album_score(a, b, energy: float, moods: list[float]) -> tuple[float, list[str]]:
    """Weighted distance of album b as a neighbour of album a, and its reasons; energy: distance of their ranges."""
    pole = lambda f: np.stack([p["embedding"] for p in f["poles"]])
    mood_a, mood_b = a["mood"]["mean"], b["mood"]["mean"]
    parts = {
        "core": _clipped(distances([a["mean"]], [b["mean"]])[0, 0]),
        "poles": 0.0 if not len(a["poles"]) else 1.0 if not len(b["poles"]) else _clipped(_nearest_mean(pole(a), pole(b))),
        "spread": _clipped(abs(a["spread"]["pairwise"] - b["spread"]["pairwise"]) + _narrower(a["spread"]["pairwise"], b["spread"]["pairwise"], 0.55)),
        "energy": energy,
        "mood": _clipped(distances([mood_a], [mood_b])[0, 0]) if len(mood_a) and len(mood_b) else 0.0,
        "path": _clipped(abs(a["path"]["mean_step"] - b["path"]["mean_step"])),
    }
    return sum(parts[n] * w for n, w in ALBUM_WEIGHTS.items()), _reasons(parts)


def artist_score(a, b, energy: float, moods: list[float]) -> tuple[float, list[str]]:
    """Weighted distance of artist b as a neighbour of artist a, and its reasons; without a trajectory its weight is spread.

    energy, moods: distances of their ranges.
    """
    poles = [([p["embedding"] for p in f["poles"]], [p["weight"] for p in f["poles"]]) for f in (a, b)]
    mood_a, mood_b = a["mood"]["mean"], b["mood"]["mean"]
    mood = 0.0
    if len(mood_a) and len(mood_b):
        mood = _clipped((distances([mood_a], [mood_b])[0, 0] + float(np.mean(moods))) / 2)
    differ = lambda name, keys: float(np.mean([abs(a[name][k] - b[name][k]) for k in keys]))
    parts = {
        "poles": _both_ways(poles[0][0], poles[1][0], poles[0][1], poles[1][1]),
        "core": _both_ways(a["core"], b["core"]),
        "spread": _clipped(differ("spread", ("pairwise", "p50", "p90", "widest")) + _narrower(a["spread"]["pairwise"], b["spread"]["pairwise"], 0.65)),
        "outliers": _both_ways(a["outliers"], b["outliers"]),
        "energyMood": _clipped((energy + mood) / 2),
    }
    if a["trajectory"] is not None and b["trajectory"] is not None:
        parts["trajectory"] = _clipped(differ("trajectory", ("mean_step", "p50", "longest", "net")))
    weight = sum(ARTIST_WEIGHTS[n] for n in parts)
    return sum(d * ARTIST_WEIGHTS[n] for n, d in parts.items()) / weight, _reasons(parts)


def scored(pairs: DataFrame, fingerprints: DataFrame, score) -> DataFrame:
    """entity, candidate, score, reasons of candidate pairs; each side meets its fingerprint by an equi-join."""
    whole = F.struct(*[c for c in fingerprints.columns if c != "entity"])
    side = checkpointed(fingerprints.select("entity", whole.alias("f")))
    joined = pairs.join(side.withColumnRenamed("f", "__a"), "entity").join(side.select(F.col("entity").alias("candidate"), F.col("f").alias("__b")), "candidate")
    ends = lambda f, at: interval(*[at(f[c]) for c in ("low", "high", "q1", "q3")])
    energy = interval_distance(*[ends(F.col(f)["energy"], lambda c: c) for f in ("__a", "__b")])
    both = F.least(*[F.size(F.col(f)["mood"]["mean"]) for f in ("__a", "__b")])
    one = lambda k: interval_distance(*[ends(F.col(f)["mood"], lambda c: F.coalesce(F.get(c, k), F.lit(0.0))) for f in ("__a", "__b")])
    moods = F.when(both > 0, F.transform(F.sequence(F.lit(0), both - 1), one)).otherwise(F.array().cast("array<double>"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(*pair) for pair in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.float64()), pa.array([r for _, r in found], pa.list_(pa.string()))], names=["entity", "candidate", "score", "reasons"])

    return joined.select("entity", "candidate", "__a", "__b", energy.alias("energy"), moods.alias("moods")).mapInArrow(judge, "entity string, candidate string, score double, reasons array<string>")


def diverse_top(rows: DataFrame, group: str, order: list, diverse: str, top: int = DEFAULT.top, passes: int = 3) -> DataFrame:
    """`rank`ed top rows of each group, first one for each value of `diverse`, then a second and a third if places are left.

    The passes over the ordered list come to this: rows are numbered within group and value, up to `passes`, and the group
    is ordered by that number, then by `order`. Both ranks are limited in every task before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(group, diverse).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(group).orderBy("__turn", *order))
    return rows.withColumn("__turn", turn).where(F.col("__turn") <= passes).withColumn("rank", place).where(F.col("rank") <= top).drop("__turn")


def similar_albums(tracks: DataFrame, names: DataFrame, dimension: int, bounds: Bounds = DEFAULT) -> DataFrame:
    """entity, candidate, score, reasons, rank: the most similar albums of each, other editions of itself left out.

    names: entity, album, artist, edition, artist_edition (folded names without edition suffixes; see edition_text).
    """
    prints = checkpointed(album_fingerprints(tracks, dimension, bounds))
    vectors = prints.select("entity", F.concat(F.array("mean"), F.col("poles.embedding")).alias("vectors"))
    found = scored(candidates(vectors, tracks, bounds), prints, album_score)
    own = names.select("entity", F.col("edition").alias("__e"), F.col("artist_edition").alias("__a"))
    other = names.select(F.col("entity").alias("candidate"), "album", "artist", "edition", "artist_edition")
    rows = found.join(own, "entity").join(other, "candidate").where((F.col("edition") != F.col("__e")) | (F.col("artist_edition") != F.col("__a")))
    ranked = diverse_top(rows, "entity", [F.col("score"), F.lower("artist"), F.lower("album"), F.col("candidate")], "artist_edition", bounds.top)
    return ranked.select("entity", "candidate", "score", "reasons", "rank")


def similar_artists(tracks: DataFrame, names: DataFrame, dimension: int, bounds: Bounds = DEFAULT) -> DataFrame:
    """entity, candidate, score, reasons, rank: the most similar artists of each. names: entity, artist."""
    prints = checkpointed(artist_fingerprints(tracks, dimension, bounds))
    vectors = prints.select("entity", F.concat(F.col("core"), F.col("poles.embedding"), F.col("outliers")).alias("vectors"))
    found = scored(candidates(vectors, tracks, bounds), prints, artist_score).join(names.select(F.col("entity").alias("candidate"), "artist"), "candidate")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("score", F.lower("artist"), "candidate"))
    return found.withColumn("rank", rank).where(F.col("rank") <= bounds.top).select("entity", "candidate", "score", "reasons", "rank")

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastra.operators import similarity as s

SCHEMA = "entity string, id string, order bigint, embedding array<float>, energy double, mood array<double>, album string, year int"


def tracks(spark, rows):
    return spark.createDataFrame([(e, i, n, v, 0.5, [0.5] * 6, a, y) for n, (e, i, v, a, y) in enumerate(rows)], SCHEMA)


NEAR = [("a", "a1", [1.0, 0.0], "A", 2000), ("a", "a2", [1.0, 0.01], "A", 2000), ("b", "b1", [0.99, 0.1], "B", 2001), ("c", "c1", [0.0, 1.0], "C", 2002)]


def test_near_before_far(spark):
    df = tracks(spark, NEAR)
    names = spark.createDataFrame([(k, k.upper(), f"artist {k}", k, f"artist {k}") for k in "abc"], "entity string, album string, artist string, edition string, artist_edition string")
    albums = s.similar_albums(df, names, 2).where("entity = 'a'").orderBy("rank").collect()
    assert [r["candidate"] for r in albums] == ["b", "c"] and albums[0]["reasons"][0] == "core"
    artists = s.similar_artists(df, names.select("entity", "artist"), 2).where("entity = 'a'").orderBy("rank").collect()
    assert [r["candidate"] for r in artists] == ["b", "c"]


def test_other_editions_are_left_out(spark):
    names = spark.createDataFrame([("a", "A", "x", "same", "x"), ("b", "B", "x", "same", "x"), ("c", "C", "y", "c", "y")], "entity string, album string, artist string, edition string, artist_edition string")
    got = {(r["entity"], r["candidate"]) for r in s.similar_albums(tracks(spark, NEAR), names, 2).collect()}
    assert got == {("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")}


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400, None), (401, [0.0] * 8), (402, [1.0])]
    df = spark.createDataFrame(vectors, "id bigint, embedding array<float>").repartition(5)
    queries = df.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    got = {}
    for r in s.nearest(queries, df, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    usable = [(i, v) for i, v in vectors if v is not None and len(v) == 8]
    matrix = np.array([v for _, v in usable], np.float32)
    for q, v in vectors[:400:20]:
        d = np.round(s.distances(np.array([v], np.float32), matrix)[0], 9)
        assert got[q] == [usable[k][0] for k in sorted(range(len(usable)), key=lambda k: (d[k], usable[k][0]))[:5]]
    assert s.nearest(queries.where("false"), df, 5).count() == 0


def test_diverse_top_equals_the_passes(spark):
    rng = random.Random(8)
    rows = [(g, f"{rng.randint(0, 5)}", rng.randint(0, 10**6), f"c{i}") for g in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "entity string, artist string, score int, candidate string")
    got = [(r["entity"], r["candidate"]) for r in s.diverse_top(df, "entity", [F.col("score"), F.col("candidate")], "artist").orderBy("entity", "rank").collect()]
    want = []
    for g in "xy":
        ordered, chosen, count = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3])), [], {}
        for cap in (1, 2, 3):
            for r in ordered:
                if r not in chosen and count.get(r[1], 0) < cap and len(chosen) < s.DEFAULT.top:
                    chosen.append(r)
                    count[r[1]] = count.get(r[1], 0) + 1
        want += [(g, r[3]) for r in chosen]
    assert got == want


def test_large_entities_are_sampled(spark):
    rng = np.random.default_rng(5)
    df = tracks(spark, [("big", f"t{i:04}", [float(x) for x in rng.normal(size=4)], "A", 2000) for i in range(700)] + [("small", f"s{i}", [1.0, 0.0, 0.0, 0.0], "A", 2000) for i in range(5)])
    kept = s.sampled(df, 4).collect()
    big = sorted(r["order"] for r in kept if r["entity"] == "big")
    assert sum(r["entity"] == "small" for r in kept) == 5 and 148 <= len(big) <= s.DEFAULT.sample
    assert {round(i / 147 * 699) for i in range(148)} <= set(big)
    means = np.mean([r["embedding"] for r in df.where("entity = 'big'").collect()], axis=0)
    far = sorted(df.where("entity = 'big'").collect(), key=lambda r: (-s.distances([r["embedding"]], [means])[0, 0], r["order"]))[:10]
    assert {r["order"] for r in far} <= set(big)


def scalar_poles(d, first, most, least):
    chosen = [first]
    while len(chosen) < most:
        rest = [i for i in range(len(d)) if i not in chosen]
        best = max(rest, key=lambda i: (min(d[i][c] for c in chosen), -i), default=None)
        if best is None or min(d[best][c] for c in chosen) < least:
            break
        chosen.append(best)
    for _ in range(2):
        groups = [[] for _ in chosen]
        for i in range(len(d)):
            groups[min(range(len(chosen)), key=lambda k: d[i][chosen[k]])].append(i)
        chosen = [min(g, key=lambda i: (sum(d[i][j] for j in g if j != i), i)) if g else c for g, c in zip(groups, chosen)]
    return chosen


def test_poles_and_fingerprints_against_scalar_code():
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 7, 30):
        vectors = rng.normal(size=(n, 6)).astype(np.float32)
        pairs = s.distances(vectors, vectors)
        np.fill_diagonal(pairs, 0)
        assert s._poles(pairs, 0, 3, 0.12)[0] == scalar_poles(pairs.tolist(), 0, 3, 0.12)
        rows = pd.DataFrame({"id": [str(i) for i in range(n)], "order": range(n), "embedding": list(vectors), "energy": [0.1 * i for i in range(n)], "mood": [[0.1 + 0.1 * i] * 6 for i in range(n)]})
        print_ = s.album_fingerprint("e", rows)
        steps = [pairs[i, i + 1] for i in range(n - 1)]
        assert print_["path"]["total"] == pytest.approx(sum(steps)) and sum(p["weight"] for p in print_["poles"]) == pytest.approx(1)
        assert print_["spread"]["widest"] == pytest.approx(max((pairs[i, j] for i in range(n) for j in range(i)), default=0))
        own = s.artist_fingerprint("e", rows, rows.iloc[:4])
        assert len(own["core"]) == min(3, n) and (own["trajectory"] is None) == (n < 3)
        assert s.album_score(print_, print_, 0.0, [0.0] * 6)[0] == pytest.approx(0, abs=1e-6) and s.artist_score(own, own, 0.0, [0.0] * 6)[0] == pytest.approx(0, abs=1e-6)


def test_ranges_count_in_the_scores(spark):
    rows = [("a", "a1", [1.0, 0.0], 0.1, [0.2] * 6), ("a", "a2", [1.0, 0.1], 0.3, [0.4] * 6), ("b", "b1", [1.0, 0.0], 0.4, [0.5] * 6), ("b", "b2", [1.0, 0.1], 0.5, None)]
    df = spark.createDataFrame([(e, i, n, v, x, m, "A", 2000) for n, (e, i, v, x, m) in enumerate(rows)], SCHEMA)
    pairs = spark.createDataFrame([("a", "b")], "entity string, candidate string")
    for make, score, of in ((s.album_fingerprints, s.album_score, 0), (s.artist_fingerprints, s.artist_score, 1)):
        got = s.scored(pairs, make(df, 2), lambda a, b, energy, moods: (energy + 10 * moods[0] + 100 * len(moods), [])).first()
        # quartiles: energies 0.15..0.25 and 0.425..0.475, moods of artists 0.25..0.35 and 0.5..0.5, of albums their ends
        assert got["score"] == pytest.approx(0.175 + 10 * (0.1 if of == 0 else 0.15) + 600)


def test_the_index_finds_nearly_all(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = df.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    exact = {(r["query"], r["id"]) for r in s.nearest(queries, df, 12).collect()}
    found = {(r["query"], r["id"]) for r in s.nearest(queries, df, 12, probes=s.PROBES).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    lists = s.fit_lists(df.withColumn("__dim", F.size("embedding")))
    placed = s.in_lists(df.withColumn("__dim", F.size("embedding")), "id", lists, 0)
    assert placed.count() == df.count() and len(lists[64]) == round(df.count() ** 0.5)


def test_a_list_of_any_size_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "PART", 16)
    df = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(200)] + [(900, None), (901, [])], "id bigint, embedding array<float>")
    queries = df.where("id < 3").select(F.col("id").alias("query"), "embedding")
    got = {(r["query"], r["rank"]): r["id"] for r in s.nearest(queries, df, 2, probes=1.0).collect()}
    assert got == {(q, r): i for q, ids in ((0, (0, 1)), (1, (1, 0)), (2, (2, 1))) for r, i in enumerate(ids, 1)}

import datetime as dt
import random

from cadastra.operators import snapshots as s

ROWS = "id string, kind string, a string, b string, change_kind string"


def diff(spark, old, new):
    return sorted(tuple(x) for x in s.snapshot_diff(spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS), ["id", "kind"], ["a", "b"]).collect())


def test_nulls_repeats_and_clashing_columns(spark):
    old = [("1", "t", "x", None, ""), ("1", "t", "x", None, ""), ("2", "t", None, "y", ""), ("3", "t", "", "", ""), ("4", "t", "ab", "c", ""), (None, "t", "1", "1", ""), ("5", "t", "z" * 100_000, "", "")]
    new = [("1", "t", "x", None, "q"), ("2", "t", "y", None, ""), ("3", "t", None, "", ""), ("4", "t", "a", "bc", ""), ("6", "t", "1", "1", ""), ("1", "u", "x", None, ""), ("5", "t", "z" * 99_999 + "y", "", "")]
    assert diff(spark, old, new) == [("1", "u", "added"), ("2", "t", "changed"), ("3", "t", "changed"), ("4", "t", "changed"), ("5", "t", "changed"), ("6", "t", "added")]
    assert diff(spark, old, old) == diff(spark, [], []) == []
    assert diff(spark, [], new[:1]) == [("1", "t", "added")] and diff(spark, old[:1], []) == [("1", "t", "removed")]


def test_scans_against_brute_force(spark):
    rng = random.Random(4)
    scans, rows, states = [], [], {}
    for i in range(24):
        instance, status = rng.choice("xy"), rng.choice(["complete", "complete", "failed", "scanning"])
        scans.append((f"s{i}", instance, status, dt.datetime(2024, 1, 1 + i), None))
        content = {(rng.choice(["track", "album"]), str(rng.randint(1, 8))): (rng.choice("ab"), rng.choice(["c", None]), None) for _ in range(rng.randint(0, 9))}
        rows += [(f"s{i}", instance, t, e, *fps, "{}") for (t, e), fps in content.items() for _ in range(rng.randint(1, 2))]
        if status == "complete":
            states.setdefault(instance, []).append((f"s{i}", content))
    want = []
    for chain in states.values():
        for (_, a), (name, b) in zip(chain, chain[1:]):
            want += [(name, *k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
    scan_df = spark.createDataFrame(scans + scans[:3], "scan_id string, catalog_instance_id string, status string, started_at timestamp_ntz, entity_type string")
    row_df = spark.createDataFrame(rows, "scan_id string, catalog_instance_id string, entity_type string, entity_id string, metadata_fp string, media_fp string, artwork_fp string, payload string")
    assert sorted(tuple(x) for x in s.scan_changes(scan_df, row_df).collect()) == sorted(want)
    assert s.scan_changes(scan_df.where("false"), row_df).count() == s.scan_changes(scan_df.where("false"), row_df.where("false")).count() == 0

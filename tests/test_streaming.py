from cadastra.operators.changefeed import apply_changes
from cadastra.streaming import journal as s

SCHEMA = "catalog_instance_id string, seq bigint, operation string, entity_type string, entity_id string, old_entity_id string, payload string"


def test_fold_over_files_equals_one_application(spark, tmp_path):
    rows = [("i", n, ("upsert", "upsert", "delete", "rekey")[n * 7 % 4], "t", f"e{n * 5 % 9}", f"e{n * 3 % 9}", str(n)) for n in range(200)]
    rows = [r[:5] + (None if r[2] != "rekey" else r[5], None if r[2] == "delete" else r[6]) for r in rows] + [("i", 3, *[("upsert", "upsert", "delete", "rekey")[21 % 4], "t", "e6", None, None])]
    df = spark.createDataFrame(rows, SCHEMA)
    root = str(tmp_path)
    fold = s.JournalFold(f"{root}/fold", ["catalog_instance_id"], ["payload"])
    for part in range(3):
        df.where(f"seq % 3 = {part}").write.mode("append").parquet(f"{root}/changes.parquet")
        state = fold.run(s.read_stream(spark, root, "changes"))
    got = {(r["entity_type"], r["entity_id"]): r["made"]["seq"] for r in s.living(state).collect()}
    want = {(r["entity_type"], r["entity_id"]): r["seq"] for r in apply_changes(df, ["payload"]).collect()}
    assert got == want


def test_a_batch_run_again_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("i", 1, "upsert", "t", "a", None, "x")], SCHEMA)
    fold = s.JournalFold(str(tmp_path), ["catalog_instance_id"], ["payload"])
    fold.apply(df, 0)
    fold.apply(df.withColumn("seq", df["seq"] + 5), 1)
    fold.apply(df.withColumn("seq", df["seq"] + 5), 1)
    assert [r["made"]["seq"] for r in spark.read.parquet(fold._folder(1)).collect()] == [6]


def test_few_folders_hold_the_state(spark, tmp_path):
    fold, n = s.JournalFold(str(tmp_path), ["catalog_instance_id"], ["payload"]), 11
    for batch in range(n):
        fold.apply(spark.createDataFrame([("i", batch, "upsert", "t", f"e{batch % 4}", None, "x"), ("i", batch, "delete", "t", f"e{(batch + 1) % 4}", None, None)], SCHEMA), batch)
        held = spark.read.option("basePath", f"{tmp_path}/state").parquet(*[fold._folder(k) for k in fold.living_folders(batch)])
        assert len(fold.living_folders(batch)) <= 3
    state = s.merged(held.drop("batch"), ["catalog_instance_id"])
    assert {r["entity_id"]: (r["made"]["seq"], r["removed"]) for r in state.collect()} == {"e0": (8, 7), "e1": (9, 8), "e2": (10, 9), "e3": (7, 10)}
    assert len(list((tmp_path / "state").iterdir())) <= 5

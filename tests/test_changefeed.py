import random

from cadastra.operators import changefeed as c

SCHEMA = "catalog_instance_id string, epoch string, generation bigint, seq bigint, operation string, entity_type string, entity_id string, old_entity_id string, a string, b string, __x string"


def replay(rows, merge):
    state = {}
    for _, _, _, seq, op, kind, new, old, a, b, _ in sorted(set(rows), key=lambda r: r[3]):
        if op == "delete":
            state.pop((kind, new), None)
        else:
            if op == "rekey":
                state.pop((kind, old), None)
            before = state.get((kind, new)) if merge and op == "upsert" else None
            state[kind, new] = (seq, a if a is not None or not before else before[1], b if b is not None or not before else before[2])
    return sorted((k, e, *v) for (k, e), v in state.items())


def rows_of(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(1000), n):
        op = rng.choice(["upsert", "upsert", "upsert", "delete", "rekey"])
        ids = rng.sample("uvwxyz", 2)
        values = [None if op == "delete" else rng.choice([None, "p", "q", "r"]) for _ in range(2)]
        rows.append(("i", "e", 1, seq, op, rng.choice(["t", "a"]), ids[0], ids[1] if op == "rekey" and rng.random() < 0.8 else ids[0] if op == "rekey" else None, *values, None))
    rows += rng.choices(rows, k=n // 4)
    rng.shuffle(rows)
    return rows


def test_replay_in_order(spark):
    for seed in range(6):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        for merge in (False, True):
            got = c.apply_changes(df, ["a", "b"], merge=merge).select("entity_type", "entity_id", "seq", "a", "b").collect()
            assert sorted(tuple(x) for x in got) == replay(rows, merge), (seed, merge)


def test_current_epoch_nulls_and_empty(spark):
    rows = [("i", "e1", 5, 9, "upsert", "t", "x", None, "a", None, None), ("i", "e2", 6, 1, "upsert", "t", "y", None, "b" * 100_000, "", None), ("i", "e2", 7, 2, "upsert", "t", None, None, "b", None, None), ("j", "e3", None, 1, "upsert", "t", "z", None, None, None, None), (None, "e", 1, 1, "upsert", "t", "w", None, None, None, None), ("i", "e2", 7, None, "upsert", "t", "v", None, None, None, None), ("i", "e2", 7, 3, "other", "t", "u", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(x) for x in c.current_entities(df).collect()) == [("i", "t", "y", 1), ("j", "t", "z", 1)]
    assert c.current_entities(df.where("false"), ["a"]).count() == 0
    assert c.apply_changes(df.where("false"), ["a"], merge=True).count() == 0


def test_hot_entity(spark):
    rows = [("i", "e", 1, s, "upsert", "t", "hot", None, str(s), None, None) for s in range(500)] + [("i", "e", 1, 1000 + s, "upsert", "t", f"x{s}", None, None, None, None) for s in range(500)]
    got = c.current_entities(spark.createDataFrame(rows, SCHEMA).repartition(7), ["a"]).where("entity_id = 'hot'").first()
    assert (got["seq"], got["a"]) == (499, "499")


def test_seq_is_a_column_like_the_others(spark):
    rows = [("i", "e", 1, 5, "upsert", "t", "x", None, "a", None, None), ("i", "e", 1, 7, "delete", "t", "x", None, None, None, None), ("i", "e", 1, 3, "upsert", "t", "y", None, "b", "c", None), ("i", "e", 1, 9, "upsert", "t", "y", None, None, "d", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(x) for x in c.apply_changes(df, ["a", "b"]).collect()] == [("i", "t", "y", 9, None, "d")]
    assert [tuple(x) for x in c.apply_changes(df, ["a", "b"], merge=True).collect()] == [("i", "t", "y", 9, "b", "d")]
    assert [tuple(x) for x in c.apply_changes(df, []).collect()] == [("i", "t", "y", 9)]

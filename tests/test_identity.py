import pytest
from pyspark.sql import functions as F

from cadastra.operators import identity as i

# Published examples of the transform.
EXAMPLES = [
    ("0" * 32, "0" * 22, True, True, "hex32"),
    ("f" * 32, "7N42dgm5tFLK9N8MT7fHC7", True, True, "hex32"),
    ("e3b7fc2ae9447bbec37a13bf916e3cf6", "6VHl3uR4kss6sUPKA8Cwnk", True, True, "hex32"),
    ("f47ac10b-58cc-4372-a567-0e02b2c3d479", "7rke2SAWaicSeSYzkhww6R", True, True, "uuid"),
    ("5cLJPkLA5DK2BADhoeotPk", "5cLJPkLA5DK2BADhoeotPk", True, False, "base62_128"),
    ("z" * 22, "3LyqmwQBm5IRqlVjNYASwb", True, True, "base62_overflow"),
    ("", "", False, False, "unrecognized"),
    ("aB3xY9kQz1", "aB3xY9kQz1", False, False, "unrecognized"),
    ("!" * 22, "!" * 22, False, False, "unrecognized"),
    ("z" * 32, "z" * 32, False, False, "unrecognized"),
    ("0" * 36, "0" * 36, False, False, "unrecognized"),
]


def test_canonical_ids(spark):
    df = spark.createDataFrame([(e[0],) for e in EXAMPLES] + [(None,)], "id string")
    got = {r["id"]: tuple(r["c"]) for r in df.select("id", i.canonical_id(F.col("id")).alias("c")).collect()}
    for given, *want in EXAMPLES:
        assert got[given] == tuple(want)
        assert i.canonical(want[0])[0] == want[0]


@pytest.mark.parametrize(
    ("raw", "kind", "version", "prerelease", "commit", "after"),
    [
        ("0.63.2", "release", [0, 63, 2], None, None, False), ("v0.63.3", "release", [0, 63, 3], None, None, True), ("0.7.15", "release", [0, 7, 15], None, None, False), ("1.2.0", "release", [1, 2, 0], None, None, True),
        ("0.70.1-rc2 (00FFEE1234)", "prerelease", [0, 70, 1], "rc2", "00ffee1234", None), ("Main (9d8c7b6a5f40)", "branch", None, None, "9d8c7b6a5f40", None),
        ("dev", "branch", None, None, None, None), ("my own server", "unknown", None, None, None, None), ("", "unknown", None, None, None, None), (None, "unknown", None, None, None, None),
    ],
)
def test_versions(spark, raw, kind, version, prerelease, commit, after):
    row = spark.createDataFrame([(raw,)], "v string").select(i.server_version(F.col("v")).alias("s"), i.after_last_other_version(F.col("v")).alias("a")).first()
    assert (row["s"]["kind"], row["s"]["version"], row["s"]["prerelease"], row["s"]["commit"], row["a"]) == (kind, version, prerelease, commit, after)


def test_inspection(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    old = [f"{n:032x}" for n in range(30)]
    new = [i.canonical(x)[0] for x in old]
    status = lambda a, b: i.inspect_ids(ids(a), ids(b), "id").first().asDict()
    assert status(new, new)["status"] == "unchanged" and status(old, old)["status"] == "unchanged"
    found = status(old, new[:2] + old[2:])
    assert (found["status"], found["n_matched"]) == ("transition_detected", 2)
    found = status(old, old + new[:2])
    assert (found["status"], found["n_duplicate"]) == ("conflict", 2)
    found = status(old, [])
    assert (found["status"], found["n_missing"], found["n_current"]) == ("incomplete", 30, 0)
    assert status([], [])["status"] == "unchanged"


def test_plan(spark):
    rows = lambda xs: spark.createDataFrame(xs, "entity_type string, entity_id string, fp string")
    old = [("track", f"{n:032x}", "a") for n in range(3)] + [("track", "stays", "a"), ("track", "gone", "a"), ("album", "changes", "a"), ("library", "0" * 32, "a")]
    new = [("track", i.canonical(f"{n:032x}")[0], "a") for n in range(3)] + [("track", "stays", "a"), ("album", "changes", "b"), ("track", "added", "c"), ("library", "0" * 22, "a")]
    got = {(r["entity_type"], r["entity_id"]): (r["operation"], r["old_entity_id"]) for r in i.rekey_plan(rows(old), rows(new), ["fp"]).collect()}
    assert sum(op == "rekey" for op, _ in got.values()) == 3 and got["track", i.canonical("0" * 32)[0]] == ("rekey", "0" * 32)
    assert got["track", "stays"] == ("unchanged", None) and got["track", "gone"] == ("delete", None)
    assert got["album", "changes"] == ("upsert", None) and got["track", "added"] == ("upsert", None)
    assert got["library", "0" * 32] == ("delete", None) and got["library", "0" * 22] == ("upsert", None)
    assert len(got) == 9
    both = [("track", "0" * 32, "a"), ("track", "00000000-0000-0000-0000-000000000000", "a")]
    assert i.rekey_plan(rows(both), rows([("track", "0" * 22, "a")]), ["fp"]).where("operation = 'conflict'").count() == 1


def test_ids_inside_json_are_exchanged_as_a_whole(spark):
    texts = {1: '{"a":"old1","old2":["old1","xold1",{"b":"old3"}],"n":1.5}', 2: '{"old1":1,"new1":2}', 3: "no json", 4: None, 5: '"old2"', 6: '{"é":"plain"}', 7: '{"old1":1,"old2":"new1"}'}
    rows = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "k int, body string, old_id string").repartition(3)
    mapping = spark.createDataFrame([("old1", "new1"), ("old2", "new2"), ("old1", "new1"), (None, "z"), ("old9", None)], "old_id string, new_id string")
    got = {r["k"]: (r["text"], r["collides"]) for r in i.rewritten_json(rows, "k", "body", mapping).collect()}
    assert got == {1: ('{"a":"new1","new2":["new1","xold1",{"b":"old3"}],"n":1.5}', False), 2: (None, True), 3: ("no json", False), 4: (None, False), 5: ('"new2"', False), 6: ('{"é":"plain"}', False), 7: ('{"new1":1,"new2":"new1"}', False)}
    assert i.rewritten_json(rows.where("false"), "k", "body", mapping).count() == 0
    with pytest.raises(ValueError):
        i.rewritten_json(rows, "k", "body", mapping.union(spark.createDataFrame([("old1", "other")], "old_id string, new_id string")))


def test_order_of_contributors_means_nothing(spark):
    from cadastra.functions.canonical import unordered_json

    rows = spark.createDataFrame([('{"Contributors":[{"id":2},{"id":1}],"discs":[2,1]}',), ('{"discs":[2,1],"Contributors":[{"id":1},{"id":2}]}',), ('{"Contributors":[{"id":1},{"id":2}],"discs":[1,2]}',), (None,)], "v string")
    got = [r["f"] for r in rows.select(unordered_json(F.col("v"), "contributors").alias("f")).collect()]
    assert got == ['{"Contributors":[{"id":1},{"id":2}],"discs":[2,1]}'] * 2 + ['{"Contributors":[{"id":1},{"id":2}],"discs":[1,2]}', None]

from pyspark.sql import functions as F

from cadastra.operators import coverage as c

LINKS = "track_id string, analysis_id string, status string, evidence_complete boolean, conflict_flags array<string>, review_state string"


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_projection_of_every_state(spark):
    tracks = df(spark, "track_id string, status string", *[(t, "x") for t in ("one", "a1", "a2", "b1", "b2", "c1", "c2", "d1", "d2", "e1", "lost", "later")])
    mapping = df(spark, "track_id string, analysis_id string", ("one", "1"), *[(f"{k}{n}", k) for k in "abcd" for n in (1, 2)], ("e1", "e"), ("later", "none yet"))
    items = df(spark, "analysis_id string", *[(k,) for k in ("1", "a", "b", "c", "d", "e")])
    prints = df(spark, "track_id string, fingerprint string", ("a1", "f"), ("a2", "f"), ("b1", "f"), ("b2", ""), ("c1", "f"), ("c2", "g"), ("d1", "f"), ("d2", "g"))
    suspects = df(spark, "analysis_id string", ("d",), ("e",), ("e",), ("none yet",))
    rows = c.projection(tracks, mapping, items, prints, suspects)
    got = {r["track_id"]: (r["status"], r["evidence_complete"], r["conflict_flags"], r["review_state"]) for r in rows.collect()}
    assert got["one"] == got["a1"] == got["a2"] == ("ready", True, [], "none")
    assert got["b1"] == got["b2"] == ("ready", False, [c.PENDING], "provisional")
    assert got["c1"] == ("ready", False, [c.DISAGREEMENT], "needs_repair") and got["d2"] == ("ready", False, [c.DISAGREEMENT, c.CONFLICT], "needs_repair")
    assert got["e1"] == ("ready", False, [c.CONFLICT], "needs_review")
    assert got["lost"] == ("missing", False, [], "none") and got["later"] == ("pending", False, [], "none")
    assert c.link_states(rows).first().asDict() == {"total": 12, "usable": 10, "verified": 3, "provisional": 7, "pending": 1, "suspect": 5, "missing": 1, "usable_ids": 6}
    assert c.projection(tracks.where("false"), mapping, items, prints, suspects).count() == 0


def test_counters_of_nothing(spark):
    tracks, states = df(spark, "track_id string"), df(spark, "track_id string, status string")
    assert c.profile_states(tracks, states).first()["needs_attention"] == 0
    row = c.readiness(tracks, tracks, df(spark, "track_id string, fingerprint string, updated_at timestamp_ntz")).first()
    assert (row["eligible"], row["part"], row["latest"]) == (0, 0.0, None)
    assert c.link_states(df(spark, LINKS)).first()["total"] == 0


def catalogue(spark, tracks, members, libraries=("l1", "l2")):
    return {
        "tracks": df(spark, "track_id string", *[(t,) for t in tracks]).repartition(3),
        "entity_libraries": df(spark, "entity_type string, entity_id string, library_id string", *[("track", *m) for m in members], ("album", "x", "l9")),
        "libraries": df(spark, "library_id string, name string", *[(x, "Music") for x in libraries]),
    }


def test_scope_does_not_depend_on_order_and_can_be_proved(spark):
    ids = [f"t{n:03}" for n in range(200)]
    members = [(t, f"l{1 + n % 2}") for n, t in enumerate(ids)]
    one = c.scope_evidence(catalogue(spark, ids, members), "p")
    row = one.first()
    assert row == c.scope_evidence(catalogue(spark, ids[::-1], members[::-1]), "p").first()
    assert (row["library_count"], row["track_count"], row["mapped_track_count"]) == (2, 200, 200)
    other = c.scope_evidence(catalogue(spark, ids[1:] + ["t999"], members), "q").first()
    assert other["tracks_fp"] != row["tracks_fp"] and other["scope_fp"] == row["scope_fp"]
    assert c.scope_evidence(catalogue(spark, [], []), "p").first()["library_count"] == 2
    tracks = df(spark, "track_id string", *[(t,) for t in ids])
    proof = lambda libraries, sample: c.verified_scope(one, tracks, libraries, sample).first()["verified"]
    assert proof(["l2", "l1"], ids[:12]) and not proof(["l1"], ids[:12]) and not proof(["l1", "l2"], ids[:11]) and not proof(["l1", "l2"], [*ids[:12], "t999"])


def test_integrity(spark):
    items, tracks = df(spark, "analysis_id string", ("a",), ("b",)), df(spark, "track_id string", ("1",), ("2",))
    links = df(spark, LINKS, ("1", "a", "ready", True, [], "none"), ("2", None, "missing", False, [], "none"))
    assert c.projection_integrity(links, items, tracks, 2, 2).first()["integrity"]
    row = c.projection_integrity(links.withColumn("analysis_id", F.lit("z")), items, tracks.limit(1), 2, 2).first()
    assert (row["orphan_link_count"], row["out_of_catalogue_link_count"], row["integrity"]) == (2, 1, False)

import random

import pytest

from cadastra.llm import truncation

SCHEMA = "doc_id bigint, text string, source string, evidence string"
OPENERS = ["The singer", "A guest", "My neighbour", "The drummer", "Every version"]
MIDDLES = ["leaves the stage", "argues with the organ", "celebrates the anniversary", "improves the arrangement", "remembers the carousel"]
CLOSERS = ["before the bass arrives", "while the others wait", "for better or worse", "at least on headphones", "in the first chorus"]


def corpus(seed=1, n=900, limit=200):
    rng, rows, cut = random.Random(seed), [], set()
    sentence = lambda: f"{rng.choice(OPENERS)} {rng.choice(MIDDLES)} {rng.choice(CLOSERS)}."
    for i in range(n):
        text = " ".join(sentence() for _ in range(rng.randint(1, 6)))
        kind = i % 3
        if kind == 0:
            rows.append((i, text[:limit], "limited", None))
            if len(text) > limit and text[limit - 1] != ".":
                cut.add(i)
        elif kind == 1:
            tail = rng.choice(["", "\n\nCheers,\nAda", "\n\n— Bo", " #song #night"])
            if rng.random() < 0.08:
                at = rng.randint(len(text) - 25, len(text) - 2)
                text, tail = text[:at], ""
                cut.add(i)
            rows.append((i, text + tail, "open", None))
        else:
            rows.append((i, rng.choice(["not for me, sorry", "Songs for late trains", "best opener of the year"]), "notes", None))
    return rows, cut


def found(spark, rows):
    return truncation.cut_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()


def test_finds_cuts_and_spares_complete_texts(spark):
    rows, cut = corpus()
    got = {r["doc_id"] for r in found(spark, rows)}
    assert len(got & cut) >= 0.97 * len(cut)
    assert len(got - cut) <= 0.01 * len(rows)


def test_structures_broken_characters_nulls_and_blanks(spark):
    rows = [(1, '{"a": [1, 2', "j", None), (2, '{"a": [1, 2]}', "j", None), (3, "half a charact�", "j", None), (4, None, "j", None), (5, "", None, None), (6, " \n ", "j", None), (7, '{"a": "x}', "j", None), (None, "[[]", None, None), (8, "​", "j", None)]
    assert sorted((r["doc_id"] or 0, r["evidence"]) for r in found(spark, rows)) == [(0, "structure"), (1, "structure"), (3, "character"), (7, "structure")]
    assert found(spark, []) == []


def test_prose_after_a_closed_bracket_is_judged(spark):
    rows, _ = corpus()
    rows += [(10_000, "[Live] The singer argues with the organ while the others wai", "open", None), (10_001, "[Live] The drummer at the anniv", "open", None)]
    rows += [(20_000, '[Live] The 12" improves the arrangement in the first chorus.', "open", None), (20_001, '{"a": [1]}' + chr(10) + '{"b": "}"}', "open", None), (20_002, "[1, 2]", "open", None)]
    rows += [(10_002, '{"a": 1}' + chr(10) + '{"b": "x', "open", None)]
    assert {r["doc_id"] for r in found(spark, rows) if r["doc_id"] >= 10_000} == {10_000, 10_001, 10_002}


def test_copies_of_a_cut_text_are_cut_too(spark):
    rows, _ = corpus()
    rows += [(10_000 + i, "A guest leaves the stage for better or worse. The singer argues with the organ while the others wai", "open", None) for i in range(300)]
    got = {r["doc_id"] for r in found(spark, rows)}
    assert {10_000 + i for i in range(300)} <= got


def test_copies_of_a_short_text_cut_within_a_word_are_cut_too(spark):
    rows, _ = corpus()
    rows += [(10_000 + i, "still waiting for a proper arrange", "notes", None) for i in range(300)]
    rows += [(20_000 + i, "one more ride on my carousel", "open", None) for i in range(300)]
    got = {r["doc_id"] for r in found(spark, rows)}
    assert {r[0] for r in rows if 10_000 <= r[0] < 20_000} <= got
    assert not {r[0] for r in rows if r[0] >= 20_000} & got


def test_texts_cut_at_the_same_fragment_do_not_vouch_for_each_other(spark):
    rows, _ = corpus()
    before = [f"{o} {m} {c}." for o in OPENERS for m in MIDDLES for c in CLOSERS][:50]
    rows += [(10_000 + i, f"{text} A guest argues with the organ while the others wai", "open", None) for i, text in enumerate(before)]
    rows += [(20_000 + i, f"{text} The drummer at the anniv", "open", None) for i, text in enumerate(before)]
    got = {r["doc_id"] for r in found(spark, rows)}
    assert {r[0] for r in rows if r[0] >= 10_000} <= got


def test_report_counts_per_source(spark):
    rows, _ = corpus(n=300)
    rows += [(900, None, None, None), (901, "[", None, None), (901, "[", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    report = {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.cut_report(df).collect()}
    assert report[None] == (2, 2) and report["limited"][0] == 100 and report["notes"] == (100, 0)


def test_prefix_lookup_against_brute_force(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 6))): rng.randint(1, 99) for _ in range(300)}
    asked = {w[: rng.randint(1, len(w))] for w in words} | {"zz", "日"}
    got = truncation.prefix_lookup(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    want = {a: (words.get(a, 0), max((n for w, n in words.items() if w.startswith(a) and w != a), default=0)) for a in asked}
    assert {r["word"]: (r["n"], r["longest_n"]) for r in got} == want


@pytest.mark.parametrize("n_long", [0, 40])
def test_limits_need_a_peak(spark, n_long):
    rows = [(i, f"{i:04}" + "x" * (56 + i % 50), "s", None) for i in range(400)] + [(1000 + i, f"{i:02}" + "é" * 148, "s", None) for i in range(n_long)]
    limits = truncation.field_limits(truncation.endings(spark.createDataFrame(rows, SCHEMA)).dropDuplicates(["text_key"])).collect()
    assert {(r["unit"], r["limit"]) for r in limits} == ({("chars", 150), ("bytes", 298)} if n_long else set())


def test_very_long_text(spark):
    rows, _ = corpus(n=60)
    rows.append((77_777, "word " * 200_000 + "wor", "open", None))
    assert 77_777 in {r["doc_id"] for r in found(spark, rows)}


def test_long_runs_of_spaces_and_letters(spark):
    rows, _ = corpus(n=60)
    rows += [(1_000, "a" + " " * 300_000 + "b", "open", None), (1_001, "x" * 300_000, "open", None), (1_002, "日" * 100_000 + " ​\n", "open", None), (1_003, "1a" * 100_000, "open", None)]
    assert {r["doc_id"] for r in found(spark, rows)} <= {r[0] for r in rows}


def test_last_tokens_are_those_of_the_whole_text():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "20ms ", "ab3 ", ", ", "日本", "\n", "​", "x", ". "]) for _ in range(rng.randint(0, 400)))
        whole, last = truncation.tokens(text.rstrip(truncation._patterns()[2])), truncation.last_tokens(text)
        assert whole[-len(last) :] == last if last else not whole
        assert len(last) >= min(20, len(whole))


def test_copies_of_other_texts_change_no_verdict(spark):
    rows, _ = corpus()
    # "notes" are phrases by their copies and are judged by contexts alone without them
    rows = [r for r in rows if r[2] != "notes"]
    before = {(r["doc_id"], r["evidence"]) for r in found(spark, rows)}
    copies = [(100_000 + 10 * r[0] + k, *r[1:]) for r in rows for k in range(3) if len(r[1]) > 100]
    assert {(r["doc_id"], r["evidence"]) for r in found(spark, rows + copies) if r["doc_id"] < 100_000} == before


def test_counts_do_not_depend_on_ranges(spark):
    rows, _ = corpus(n=300)
    docs = spark.createDataFrame([*rows, *rows[:50], (1, None, "open", None)], SCHEMA).repartition(3)
    small = {"segment_bits": 1 << 8, "range_segments": 1}
    texts = truncation.different_texts(docs, "text", **small)
    assert sorted(r["text"] for r in texts.collect()) == sorted({r[1] for r in rows})
    ends = truncation.endings(docs).cache()
    wanted = {k for r in ends.where("ending in ('word', 'other', 'abbreviation')").collect() for k in r["contexts"]}
    many, one = truncation.wanted_contexts(ends, **small), truncation.wanted_contexts(ends)
    assert len(many) > 3 and len(one) == 1
    counted = [{(r["word"], r["key"]): (r["n"], r["n_stop"], r["n_end"]) for r in truncation.corpus_counts(texts, "text", w).collect()} for w in (many, one, None)]
    for some in counted[:2]:
        assert {k: v for k, v in some.items() if k[0] or k[1] in wanted} == {k: v for k, v in counted[2].items() if k[0] or k[1] in wanted}
        assert len(some) < len(counted[2])


def test_thresholds_are_parameters(spark):
    rows = [(i, f"{i:03} this one was cut here by forty x"[:34], "s", None) for i in range(40)] + [(100 + i, "word " * (i + 1) + ".", "s", None) for i in range(5)]
    ends = truncation.endings(spark.createDataFrame(rows, SCHEMA))
    assert truncation.field_limits(ends).count() == 0
    assert {r["limit"] for r in truncation.field_limits(ends, truncation.Thresholds(shortest_limit=20)).collect()} == {34}

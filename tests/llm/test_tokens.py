import os

import pytest

from cadastra.llm import tokens

JSON = tokens.RANKS.replace(".tiktoken", ".json")
TEXTS = [
    None, "", " ", "\n\n  x", "Hello world, it's 2024!  Twice.", "<|endoftext|> is text", "naïve façade — “quoted” …", "日本語のテキスト。ひらがな", "Снег и Пыль",
    "emoji 👩‍🎤🏴‍☠️ mixed", "a" * 30_000, "word " * 20_000, "  wide　spaces end", "\u0085x", "tabs\t\tand\r\nlines\r\n", "'ll 've 're 'S 's'd",
    "\U0001df00\U00010780 new letters", "\U0001fae8 new picture", "zero​width﻿", "ﬁ ½ ² Ⅳ ٣ 五", "same", "same",
]


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, ids int").repartition(3)


@pytest.mark.parametrize("frequent", [tokens.FREQUENT, 3, 0])
def test_same_as_the_library(docs, frequent):
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(docs, frequent=frequent).collect()}
    assert [got[i] for i in range(len(TEXTS))] == expected(TEXTS)


def test_round_trip(docs):
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_decoding_of_odd_lists(spark):
    df = spark.createDataFrame([(1, [0, 999_999, -1]), (2, None), (3, []), (4, [127, 126]), (4, [127])], "doc_id int, ids array<int>")
    ids, data = tokens.token_bytes()
    table = dict(zip(ids, data))
    want = [(1, table[0]), (2, b""), (3, b""), (4, table[127] + table[126]), (4, table[127])]
    assert sorted((r["doc_id"], r["text"]) for r in tokens.decode_corpus(df).collect()) == sorted((i, b.decode(errors="replace")) for i, b in want)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "four"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = sorted(zip([r[0] or 0 for r in rows], expected([r[1] for r in rows])))
    for frequent in (0, 100):
        assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in tokens.encode_corpus(df, frequent=frequent).collect()) == want
    assert tokens.encode_corpus(df.where("false")).count() == 0
    assert tokens.decode_corpus(tokens.encode_corpus(df.where("false"))).count() == 0


def test_whole_words_of_the_test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df).collect()}
    assert [got[r["doc_id"]] for r in rows] == expected([r["text"] for r in rows])


def test_path_is_a_parameter(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    assert tokens.read_ranks(os.fspath(tmp_path / "v")) == b"YQ== 0\n"


def test_a_long_word_that_fills_the_corpus(spark):
    rule, indent = "-" * 100, "\n" + " " * 200
    texts = [f"{rule}{indent}{'x' * 90} {i}{rule}" for i in range(300)] + [None, rule]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)

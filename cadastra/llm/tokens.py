"""Encoding and decoding of a corpus with a public byte-level tokenizer (problem 6)."""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, salted_join, spread

#: Default place of the vocabulary; a parameter of every operator here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The most frequent words, at most so many and each of at most so many bytes, are sent to all tasks: at most
#: FREQUENT * (FREQUENT_BYTES * 5) bytes, about 20 MB. No other word is more than 1/FREQUENT of all words, unless it is
#: longer than FREQUENT_BYTES.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
#: White space as the tokenizer's pattern means it (the Unicode property White_Space), for Java's regular expressions.
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The tokenizer's published pattern, with white space spelt out. Fixed value.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: The same for the tokenizer's own library.
_PUBLIC_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str = RANKS) -> bytes:
    """The vocabulary file, read by the driver and sent with the tasks (under 1 MB), so executors need no copy."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=_PUBLIC_PATTERN, mergeable_ranks=table, special_tokens={})


def pre_tokens(text: Column) -> Column:
    """Words of a text as the tokenizer splits it: an array of strings that join to the text; NULL for NULL.

    Split in the JVM. A text with characters that Java's Unicode version does not know yet may be split otherwise there;
    those texts, and only those, go to the tokenizer's library.
    """
    unknown = text.rlike(r"\p{Cn}")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        from tokenizers.pre_tokenizers import ByteLevel

        splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        return texts.map(lambda t: None if t is None else [t[a:b] for _, (a, b) in splitter.pre_tokenize_str(t)])

    words = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(unknown, split(F.when(unknown, text))).otherwise(words)


def dictionary(words: DataFrame, ranks: bytes) -> DataFrame:
    """word, n, ids: every distinct word of the corpus once, with its number of occurrences and its token ids.

    Counts are combined before the shuffle, then each distinct word is encoded once, wherever its hash falls.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = encoder(ranks)._core_bpe.encode_single_piece
        for batch in batches:
            ids = [piece(w.encode()) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.mapInArrow(encode, "word string, n bigint, ids array<int>")


def look_up(docs: DataFrame, common: list[tuple[str, list[int]]]) -> DataFrame:
    """Documents (__doc, __text, __words) as __doc, __text, ids, missing: the ids of their common words in place.

    A word that is not common leaves a negative id, -1 for the first of the document, -2 for the second, ..., and stands
    in `missing` (in that order). Words are looked up a batch at a time by Arrow's hash table.
    """
    kind = docs.schema["__doc"].dataType.simpleString()
    words, ids = [w for w, _ in common], [i for _, i in common]
    shared = docs.sparkSession.sparkContext.broadcast((words, ids))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = shared.value
        table, flat = pa.array(words, pa.string()), np.array([i for each in ids for i in each], np.int32)
        sizes = np.array([len(each) for each in ids] + [1], np.int64)  # one id in the place of a missing word
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(2)
            offsets, every = lists.offsets.to_numpy(), lists.flatten()
            offsets = offsets - offsets[0]
            at = pc.fill_null(pc.index_in(every, value_set=table), len(words)).to_numpy().astype(np.int64)
            missing, n = at == len(words), sizes[at]
            begin = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int32)
            within = np.arange(len(out)) - np.repeat(begin, n)
            source = np.repeat(starts[at], n) + within
            out[:] = np.append(flat, 0)[source]
            before = np.cumsum(missing) - missing  # missing words so far, over the batch
            first = np.append(before, missing.sum())[offsets]
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            out[begin[missing]] = (-1 - (before - first[owner]))[missing]
            ends = np.append(begin, len(out))[offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out)),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), every.filter(pa.array(missing))),
                ],
                names=["__doc", "__text", "ids", "missing"],
            )

    return docs.mapInArrow(fill, f"__doc {kind}, __text bigint, ids array<int>, missing array<string>")


def put_in(open_: DataFrame) -> DataFrame:
    """__doc, ids: of __doc, ids (with negative ids), found (array of at, ids) the ids with the found ones in place."""
    kind = open_.schema["__doc"].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, found in zip(batch.column(1), batch.column(2).to_pylist()):
                ids, by_place = ids.values.to_numpy(zero_copy_only=False), {f["at"]: f["ids"] for f in found}
                holes = np.flatnonzero(ids < 0)
                parts, last = [], 0
                for k, hole in enumerate(holes):
                    parts += [ids[last:hole], np.array(by_place[k], np.int32)]
                    last = hole + 1
                out.append(np.concatenate([*parts, ids[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["__doc", "ids"])

    return open_.select("__doc", "ids", "found").mapInArrow(fill, f"__doc {kind}, ids array<int>")


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids (array<int>): the token ids of every text, without special tokens.

    An empty and a NULL text both give an empty list; strings that look like special tokens are ordinary text. Every row
    of `docs` gives a row, rows repeated too; ids of documents may be NULL. Extra columns are not touched.

    The words of all documents are exploded and counted, each distinct word is encoded once, and the ids are joined back
    by position. A word may be a large part of all words, so the most frequent ones (see FREQUENT) are sent to the
    documents; only the occurrences of the others are exploded with their positions, shuffled to their ids, and
    put in their places again by document. Words too long for the table of frequent ones (a rule of dashes, an indentation) may be
    as frequent as any: they are joined with salts. The dictionary is kept in the checkpoint folder.
    """
    ranks = read_ranks(path)
    words = spread(docs.select(doc_id, text), doc_id).select(F.col(doc_id).alias("__doc"), F.xxhash64(F.col(text)).alias("__text"), F.coalesce(pre_tokens(F.col(text)), F.array().cast("array<string>")).alias("__words"))
    known = checkpointed(dictionary(words.select(F.explode("__words").alias("word")), ranks))
    top = known.where(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(frequent).select("word", "ids").collect()
    common = [(r["word"], r["ids"]) for r in top]
    partly = checkpointed(look_up(words, common))
    done = partly.where(F.size("missing") == 0).select("__doc", "ids")

    open_ = partly.where(F.size("missing") > 0)
    places = open_.select("__doc", "__text", F.posexplode("missing").alias("at", "word"))
    long_ = F.octet_length("word") > FREQUENT_BYTES
    entries = known.select("word", "ids")
    met = places.where(~long_).join(entries.where(~long_), "word").unionByName(salted_join(places.where(long_), entries.where(long_), ["word"], [F.col("__text"), F.col("at")]).select("word", "__doc", "__text", "at", "ids"))
    ids = met.groupBy("__doc", "__text").agg(F.collect_set(F.struct("at", "ids")).alias("found"))
    ids = ids.withColumnsRenamed({"__doc": "__doc2", "__text": "__text2"})
    both = open_.join(ids, F.col("__doc").eqNullSafe(F.col("__doc2")) & (F.col("__text") == F.col("__text2")))
    return done.unionByName(put_in(both)).select(F.col("__doc").alias(doc_id), "ids")


def token_bytes(path: str = RANKS) -> tuple[list[int], list[bytes]]:
    """The token-byte table: ids and their bytes; as many rows as the vocabulary has."""
    rows = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, read_ranks(path).splitlines()))
    return [i for i, _ in rows], [b for _, b in rows]


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = RANKS) -> DataFrame:
    """doc_id, text: the text of every list of token ids, a row for each row; an empty or NULL list gives an empty text.

    The ids of a batch are joined with the token-byte table by Arrow's hash table and their bytes put together in order.
    The table's size is the vocabulary's, so it goes to every task and nothing is shuffled. Ids outside the vocabulary
    give nothing; bytes that are no UTF-8 come out as U+FFFD.
    """
    kind = encoded.schema[doc_id].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, data = shared.value
        table, pieces = pa.array(known, pa.int32()), pa.array([*data, b""], pa.binary())
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=table), len(known))
            offsets = lists.offsets.to_numpy()
            found = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pieces.take(at))
            joined = pc.binary_join(found, b"")
            try:
                text = joined.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([b.decode(errors="replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=[doc_id, "text"])

    return encoded.select(doc_id, F.col(ids).cast("array<int>").alias("ids")).mapInArrow(decode, f"{doc_id} {kind}, text string")

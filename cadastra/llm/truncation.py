"""Text cut off by field limits or in transfer (problem 8)."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.copies import RANGE_SEGMENTS, SEGMENT_BITS, Range, filter_segments, n_segments
from cadastra.session import checkpointed, salted_join, salts, sized_join, spread

#: Contexts of a token, from the most to the least specific: the words before it with its class, or with itself.
LEVELS = 5


@dataclass(frozen=True)
class Thresholds:
    """When evidence counts. Occurrences are those in other, different texts, so copies of any text change nothing."""

    support: int = 8  #: occurrences from which on a context counts
    rare: int = 100  #: a known word is at least 1/rare as frequent as the most frequent word that goes on from it
    ends: float = 0.2  #: a complete end: so many of the occurrences of its context end a text,
    stops: float = 0.8  #: or so many end a line or text, of them a text at least
    some: float = 0.01  #: so many, give or take two
    sure: float = 0.5  #: an end that even a partial word or a limit does not make doubtful
    after_stop: float = 0.02  #: an abbreviation's point is no stop if so few of its occurrences are,
    short_support: int = 50  #: of at least so many
    limit_texts: int = 5  #: a field limit is reached by so many different texts,
    limit_peak: int = 8  #: so many times the usual number of texts of one length,
    limit_longer: float = 0.002  #: and at most so many of the source's texts are longer
    shortest_limit: int = 50  #: no limit is sought below
    phrase_tokens: int = 12  #: a text of so few tokens
    phrase_copies: int = 9  #: that came so often is a phrase of its own


DEFAULT = Thresholds()
#: Parts of texts between spaces that are counted at a time; bounds memory, not texts.
_CHUNK = 1_000_000
_TERMINAL, _CLOSING = ".!?。！？…｡", "\"\u201d»)]}」』\u2019'"
_START = 0x9E3779B97F4A7C15
_DIGITS = frozenset("0123456789")
#: Ends that need not be the text's, which contexts decide.
_OPEN = ("word", "other", "abbreviation")


#: White space and characters without width that may follow the end of a text, for Arrow's regular expressions.
_AFTER = r"[\s\x{85}\x{a0}\x{ad}\x{34f}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]+$"
#: Characters from the end of a text in which its last tokens are sought before the whole text is.
_TAIL = 400


@lru_cache(maxsize=1)
def _patterns():
    import regex

    ignorable = regex.compile(r"[\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060\ufeff]+")
    run = regex.compile(r"[\p{L}\p{M}\p{N}]+|\n|[^\s]")
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0xAD, 0x34F, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF]
    after = "".join(map(chr, spaces))
    return ignorable, run, after


def tokens(text: str) -> list[str]:
    """Tokens of a text, or of a part of it between spaces: runs of letters, marks and digits (see spelt), line ends, others."""
    ignorable, run, _ = _patterns()
    return [t for found in run.findall(ignorable.sub("", text)) for t in ((found,) if _DIGITS.isdisjoint(found) else spelt(found))]


def last_tokens(text: str) -> list[str]:
    """The last tokens of a text, at least 20 or all.

    Taken from the end after a space where that gives so many, since a space parts tokens; else from the whole text.
    """
    text = text.rstrip(_patterns()[2])
    space = text.find(" ", len(text) - _TAIL) if len(text) > _TAIL else -1
    if space >= 0 and len(found := tokens(text[space:])) >= 20:
        return found
    return tokens(text)


def spelt(run: str) -> list[str]:
    """Tokens of a run: digits as 0, codes of digits and small letters as 0x, letters as they are.

    Digits with a unit (20ms) are two tokens; letters and digits of other scripts are parted at the digits.
    """
    if _DIGITS.isdisjoint(run):
        return [run]
    if run.isdigit():
        return ["0"] if run.isascii() else [run]
    if run.isascii() and run.islower() and not run.lstrip("0123456789").isalpha():
        return ["0x"]
    out = []
    for c in run:
        kind = "0" <= c <= "9"
        if not kind and out and out[-1] != "0":
            out[-1] += c
        elif not kind or not out or out[-1] != "0":
            out.append("0" if kind else c)
    return out


def _class(word: str) -> str:
    first = word[0]
    if first == "0":
        return "0"
    if not first.isalpha():
        return word
    return "J" if ord(first) > 0x2E80 else "A" if first.isupper() else "a"


def _hashed(words: list[str]) -> np.ndarray:
    """Rows of 64-bit hashes of words and of their classes; start marks for None."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([(_START, _START) if w is None else (digest(w), digest("class " + _class(w))) for w in words], np.uint64).reshape(-1, 2)


def _contexts(words: np.ndarray, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the contexts (one row a level) of the tokens at `at`; `words` has three start marks before every text. The last two bits are free."""
    mix = lambda level, *parts: _mixed(np.uint64(level), *parts)
    p1, p2, p3, w, c = words[at - 1], words[at - 2], words[at - 3], words[at], classes[at]
    return np.stack([mix(1, p3, p2, p1, c), mix(2, p2, p1, w), mix(3, p2, p1, c), mix(4, p1, w), mix(5, p1, c)]) & ~np.uint64(3)


def _mixed(seed: np.uint64, *parts: np.ndarray) -> np.ndarray:
    out = np.full(parts[0].shape, seed, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _structure(text: str) -> str | None:
    """Of a text that begins with a bracket: open if a bracket or a string in one stays open, closed if it is brackets throughout, else NULL (prose)."""
    depth, quoted, escaped, loose = 0, False, False, False
    for ch in text:
        if escaped:
            escaped = False
        elif quoted and ch == "\\":
            escaped = True
        elif depth and ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            depth += 1
        elif depth and not quoted and ch in "}]":
            depth -= 1
        elif not depth and ch != "," and not ch.isspace():
            loose = True
    return "open structure" if depth else None if loose else "closed structure"


def endings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How every text ends: doc, source, text_key, sizes, last token, kind of end and the keys of its contexts.

    Texts without any token (NULL, empty, blank) have a NULL `last`. text_key tells texts apart (hash and length). n_last is the
    number of last tokens looked at: all of a text that has fewer than 20.
    """
    ids, sources = (docs.schema[c].dataType.simpleString() for c in (doc_id, source))
    schema = f"doc {ids}, source {sources}, text_key string, n_chars bigint, n_bytes bigint, n_last bigint, last string, ending string, contexts array<bigint>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows, number, ends = [], {}, []  # numbers of distinct tokens; those of the last four of every text
            for value in batch.column(2).to_pylist():
                found = last_tokens(value or "")
                if not found:
                    rows.append((None, len(value or ""), 0, 0, None, None))
                    continue
                raw, stripped, last = value.encode(), value.strip(), found[-1]
                ends += [number.setdefault(t, len(number)) for t in [None, None, None, *found][-4:]]
                if stripped.endswith("\ufffd"):
                    kind = "broken"
                elif stripped[0] in "{[" and (structure := _structure(stripped)):
                    kind = structure
                elif last in _TERMINAL:
                    kind = "abbreviation" if last == "." and len(found) > 1 and found[-2][0].isalpha() else "terminal"
                elif last in _CLOSING and len(found) > 1 and found[-2] in _TERMINAL:
                    kind = "terminal"
                else:
                    kind = "word" if last[0].isalpha() else "other"
                rows.append((f"{xxhash.xxh64_hexdigest(raw)}-{len(raw)}", len(value), len(raw), len(found), last, kind))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            flat = _hashed(list(number))[np.array(ends, np.int64)]
            keys = _contexts(flat[:, 0], flat[:, 1], np.arange(3, len(flat), 4)).T.astype(np.int64)
            sizes = [LEVELS * (r[0] is not None) for r in rows]
            contexts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds)), contexts],
                names=["doc", "source", "text_key", "n_chars", "n_bytes", "n_last", "last", "ending", "contexts"],
            )

    return docs.select(doc_id, source, text).mapInArrow(describe, schema)


def wanted_contexts(ends: DataFrame, segment_bits: int = SEGMENT_BITS, range_segments: int = RANGE_SEGMENTS) -> list[Range]:
    """Bloom filters of the contexts in which texts end openly, one for each range of keys; each of bounded size."""
    keys = checkpointed(ends.where(F.col("ending").isin(*_OPEN)).select(F.explode("contexts").alias("key")).distinct())
    segments = n_segments(keys.count(), segment_bits)
    filters = checkpointed(filter_segments(keys, segments, False, segment_bits))
    return [Range(filters, k, segments, segment_bits, range_segments) for k in range(-(-segments // range_segments))]


def different_texts(docs: DataFrame, text: str = "text", segment_bits: int = SEGMENT_BITS, range_segments: int = RANGE_SEGMENTS) -> DataFrame:
    """`text` of every different text once. Only texts whose hash may repeat are shuffled, the others stay where they are."""
    keys = docs.where(F.col(text).isNotNull()).select(text, F.xxhash64(text).alias("__hash"))
    segments = n_segments(docs.count(), segment_bits)
    filters = checkpointed(filter_segments(keys.select("__hash"), segments, True, segment_bits))
    ranges = [Range(filters, k, segments, segment_bits, range_segments) for k in range(-(-segments // range_segments))]

    @F.pandas_udf("boolean")
    def repeats(hashes: pd.Series) -> pd.Series:
        values = hashes.to_numpy(np.int64).view(np.uint64)
        return pd.Series(reduce(np.logical_or, (r.has(values) for r in ranges)))

    asked = keys.withColumn("__again", repeats("__hash"))
    return asked.where("NOT __again").select(text).unionByName(asked.where("__again").select(text).distinct())


def corpus_counts(docs: DataFrame, text: str = "text", wanted: list[Range] | None = None) -> DataFrame:
    """word (NULL for a context), key (NULL for a word), n, n_stop, n_end over all tokens of all texts.

    Contexts that do not pass a filter of `wanted` are left out before the shuffle: no text ends openly in them. Filters fill
    alike at every size, so about as few others pass; of a corpus whose filters are more than one range the texts are read once a range.

    Words count where something follows them. Contexts count all their tokens, those before a line or text end (n_stop)
    and those that end a text (n_end). Combined in every batch, then by partial aggregation, then by word or key.
    """

    def counter(asked: Range | None, with_words: bool):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, list[str]] = {}
            for batch in batches:
                lists = pc.split_pattern(pc.replace_substring_regex(pc.drop_null(batch.column(0)), _AFTER, ""), " ")
                at, rows, first = lists.offsets.to_numpy(), len(lists), 0
                while first < rows:  # as many texts as have _CHUNK parts together, one at least
                    after = max(first + 1, int(np.searchsorted(at, at[first] + _CHUNK, side="right")) - 1)
                    yield from _counted(lists.slice(first, after - first), known, asked, with_words)
                    first = after

        return count

    schema = "word string, key bigint, n bigint, n_stop bigint, n_end bigint"
    parts = [docs.select(text).mapInArrow(counter(asked, k == 0), schema) for k, asked in enumerate(wanted or [None])]
    return reduce(DataFrame.unionByName, parts).groupBy("word", "key").agg(*[F.sum(c).alias(c) for c in ("n", "n_stop", "n_end")])


def _counted(texts: pa.ListArray, known: dict[str, list[str]], asked: Range | None, with_words: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the words and contexts of some texts, each a list of parts; known: tokens of parts seen before; asked: the filter."""
    names = ["word", "key", "n", "n_stop", "n_end"]
    coded = texts.flatten().dictionary_encode()
    if len(known) > 500_000:
        known.clear()
    number: dict[str, int] = {}
    parts = []
    for part in coded.dictionary.to_pylist():
        found = known.get(part)
        if found is None:
            found = known[part] = tokens(part)
        parts.append([number.setdefault(t, len(number)) for t in found])
    words, of = list(number), coded.indices.to_numpy()
    # every part becomes its tokens
    flat_parts, n_parts = np.array([c for each in parts for c in each], np.int64), np.array([len(each) for each in parts], np.int64)
    n = n_parts[of]
    begin = np.cumsum(n) - n
    codes = flat_parts[np.repeat((np.cumsum(n_parts) - n_parts)[of] - begin, n) + np.arange(int(n.sum()))]
    offsets = texts.offsets.to_numpy()
    sizes = np.diff(np.append(0, np.cumsum(n))[offsets - offsets[0]])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return

    # three start marks before every text
    at = np.arange(len(codes)) + 3 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    flat = np.full((len(codes) + 3 * len(sizes), 2), _START, np.uint64)
    flat[at] = _hashed(words)[codes]
    end = np.zeros(len(codes), bool)
    end[np.cumsum(sizes) - 1] = True
    stop = end.copy()
    stop[:-1] |= (codes[1:] == number.get("\n", -1)) & ~end[:-1]
    flags = stop.astype(np.uint64) | end.astype(np.uint64) << np.uint64(1)
    for keys in _contexts(flat[:, 0], flat[:, 1], at):
        ordered = np.sort(keys | flags)  # flags in the free bits: sorting values is faster than sorting places
        known_keys = ordered & ~np.uint64(3)
        first = np.flatnonzero(np.r_[True, known_keys[1:] != known_keys[:-1]])
        n = np.diff(np.r_[first, len(ordered)])
        n_stop, n_end = (np.add.reduceat((ordered >> np.uint64(bit) & np.uint64(1)).astype(np.int64), first) for bit in (0, 1))
        found = known_keys[first]
        kept = np.flatnonzero(asked.has(found)) if asked is not None else np.arange(len(found))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(kept), pa.string()), *(pa.array(x[kept].astype(np.int64)) for x in (found, n, n_stop, n_end))], names=names)
    if not with_words:
        return
    inner = np.bincount(codes[~end], minlength=len(words))
    zero = pa.array(np.zeros(len(words), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(words), pa.nulls(len(words), pa.int64()), pa.array(inner.astype(np.int64)), zero, zero], names=names)


def prefix_lookup(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, n, longest_n: of every asked word its own count and the largest count of a longer word that begins with it.

    asked: word (distinct). vocabulary: word, n (distinct). The trie of the vocabulary is walked depth first in shards:
    sorted words are its nodes in that order, and only the asked words on the current path are kept, so memory does not
    grow with the vocabulary. A shard has the words of two first characters and of one salt, a hash of the word; asked words
    are read by all salts and take the largest counts, so the commonest first characters are as many shards as the
    cluster's size asks for. One-character words span shards and get the maximum of their first character by aggregation.
    """
    parts = salts(vocabulary.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[list] = []  # [word, own count, largest count beyond] of the asked words on the path
        seen, count, at, done = None, 0, None, []

        def leave() -> None:
            word, own, beyond = path.pop()
            done.append((word, own, beyond))
            if path:
                path[-1][2] = max(path[-1][2], beyond)

        for batch in batches:
            for word, n, is_asked, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                while path and (part != at or not word.startswith(path[-1][0])):
                    leave()
                if part != at:
                    seen, at = None, part
                if is_asked:
                    path.append([word, count if seen == word else 0, 0])
                else:
                    seen, count = word, n
                    if path:
                        path[-1][2] = max(path[-1][2], n)
            if done:
                yield _looked_up(done)
                done.clear()
        while path:
            leave()
        if done:
            yield _looked_up(done)

    part = F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    rows = vocabulary.select("word", "n", F.lit(False).alias("asked"), part).unionByName(asked.select("word", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked"), every))
    sharded = rows.repartition(F.substring("word", 1, 2), "part").sortWithinPartitions("part", "word", "asked").select("word", "n", "asked", "part")
    deep = sharded.mapInArrow(walk, "word string, n bigint, longest_n bigint").groupBy("word").agg(F.max("n").alias("n"), F.max("longest_n").alias("longest_n"))
    firsts = vocabulary.where(F.char_length("word") > 1).groupBy(F.substring("word", 1, 1).alias("word")).agg(F.max("n").alias("__first"))
    return deep.join(firsts, "word", "left").select("word", "n", F.greatest("longest_n", F.coalesce("__first", F.lit(0))).alias("longest_n"))


def _looked_up(rows: list[tuple]) -> pa.RecordBatch:
    words, own, beyond = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(words), pa.array(own, pa.int64()), pa.array(beyond, pa.int64())], names=["word", "n", "longest_n"])


def field_limits(texts: DataFrame, by: Thresholds = DEFAULT) -> DataFrame:
    """source, unit (chars or bytes), limit: lengths at which a source cuts its texts; texts: a row for each different text of a source.

    A limit is the peak of the longest lengths of a source that by.limit_texts texts share: at most by.limit_longer of the
    texts are longer, and the peak is by.limit_peak times the mean of the lengths from half of it on. A row per source and
    length at most goes through the windows, not the texts.
    """
    sizes = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length"))))
    lengths = texts.select("source", sizes.alias("s")).groupBy("source", "s.unit", "s.length").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("source", "unit")
    top = lengths.withColumn("top", F.max(F.when((F.col("n") >= by.limit_texts) & (F.col("length") >= by.shortest_limit), F.col("length"))).over(whole))
    peak = top.withColumn("limit", F.max(F.when(F.col("length").between(F.col("top") - 5, F.col("top")), F.struct("n", "length"))).over(whole))
    lo, hi = F.floor(F.col("limit.length") / 2), F.col("limit.length") - 5
    judged = peak.groupBy("source", "unit", "limit").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("length") > F.col("limit.length") + 3, F.col("n")).otherwise(0)).alias("longer"),
        (F.sum(F.when((F.col("length") >= lo) & (F.col("length") < hi), F.col("n")).otherwise(0)) / (F.max(hi) - F.max(lo))).alias("usual"),
    )
    real = (F.col("longer") <= by.limit_longer * F.col("all")) & (F.col("limit.n") >= by.limit_peak * F.col("usual")) & (F.col("limit.n") >= by.limit_texts)
    return judged.where(real).select("source", "unit", F.col("limit.length").alias("limit"))


def _verdict(by: Thresholds) -> Column:
    """Why a text counts as cut, from its end, limit, last word and contexts; NULL if it does not."""
    n, stop, end = ([F.col(f"level{k}.{c}") for k in range(LEVELS)] for c in ("n", "n_stop", "n_end"))
    # other texts only: a doubtful text is left out of the counts already
    own = F.when(F.col("any_doubtful"), 0).otherwise(1)
    n, stop, end = ([x - own for x in xs] for xs in (n, stop, end))
    known = [F.coalesce(x >= by.support, F.lit(False)) for x in n]
    ends = [(e >= by.ends * x) | ((s >= by.stops * x) & (e + 2 > by.some * x)) for x, s, e in zip(n, stop, end)]
    often = [e >= by.sure * x for x, e in zip(n, end)]

    def judged(each: list[Column]) -> Column:
        """By the two most specific contexts if known, either is enough; else by the most specific known one."""
        out = F.when(known[0] | known[1], (known[0] & each[0]) | (known[1] & each[1]))
        for k in range(2, LEVELS):
            out = out.when(known[k], each[k])
        return out

    sure = F.coalesce(judged(often), F.lit(False))
    open_end = F.col("ending").isin("word", "other")
    phrase = (F.col("copies") >= by.phrase_copies) & (F.col("n_last") <= by.phrase_tokens) & ~F.col("doubtful")
    short = (F.col("ending") == "abbreviation") & (n[3] >= by.short_support) & (stop[3] < by.after_stop * n[3])
    return (
        F.when(F.col("ending") == "broken", "character")
        .when(F.col("ending") == "open structure", "structure")
        .when(open_end & F.col("partial") & ~sure, "word")
        .when(open_end & F.col("at_limit") & ~sure, "limit")
        .when(open_end & ~phrase & ~judged(ends), "sentence")
        .when(short, "sentence")
    )


def cut_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", by: Thresholds = DEFAULT) -> DataFrame:
    """doc_id, source, evidence of every document whose text was cut.

    evidence: `character` (ends in a broken character), `structure` (brackets or strings stay open), `word` (the last
    word is unknown, or rare beside its continuations, and a proper prefix of known words), `limit` (the length is its source's
    field limit and the end is open), `sentence` (its last words are elsewhere nearly always followed by more). Only ends
    without final punctuation are open; an end that others of its kind share (sign-offs, tags, headings, log lines) is
    complete. Ends that may be cuts themselves (broken, inside a structure, an open end in a partial word or at a limit)
    vouch for no text. Words, contexts and limits are counted over different texts, so copies of other texts change no
    verdict; a text of few tokens that came often is a phrase of its own and complete, unless its end may be a cut (see
    Thresholds). NULL, empty and blank texts are not cut. Every row is judged, rows repeated too; NULL sources are one
    source. Runs its jobs when called.

    Whole texts are read for their ends, for their hashes and for the counts of words and contexts over all texts. Then only short
    rows are shuffled: distinct contexts meet their counts once, and texts that share a context or are copies of each
    other (a third may be) are joined to it with salts.
    """
    docs = spread(docs.select(doc_id, text, source), doc_id)
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    ends = checkpointed(endings(docs, doc_id, text, source))
    counts = checkpointed(corpus_counts(different_texts(docs, text), text, wanted_contexts(ends)))
    about = ["n_chars", "n_bytes", "n_last", "last", "ending", "contexts"]
    texts = checkpointed(ends.where("last is not null").groupBy("text_key", "source", *about).agg(F.count("*").alias("copies")).withColumn("__source", named))

    looked_up = prefix_lookup(texts.where("ending = 'word'").select(F.col("last").alias("word")).distinct(), counts.where("word is not null").select("word", "n"))
    limits = field_limits(texts, by).withColumn("__source", named)
    by_unit = limits.groupBy("__source").agg(*[F.max(F.when(F.col("unit") == u, F.col("limit"))).alias(f"limit_{u}") for u in ("chars", "bytes")])
    at_limit = F.coalesce(F.col("n_chars") == F.col("limit_chars"), F.lit(False)) | F.coalesce((F.col("n_bytes") - F.col("limit_bytes")).between(-3, 2), F.lit(False))
    # sources are few and any may be hot: their limits go to all texts
    limited = sized_join(texts, by_unit, ["__source"], [F.col("text_key")], "left_outer")
    words = looked_up.select(F.col("word").alias("last"), F.col("n").alias("own_n"), "longest_n")
    partial = F.coalesce((F.col("ending") == "word") & (F.col("longest_n") > 0) & (F.col("own_n") * by.rare <= F.col("longest_n")), F.lit(False))
    doubtful = F.col("ending").isin("broken", "open structure") | (F.col("ending").isin("word", "other") & (F.col("partial") | F.col("at_limit")))
    spelled = sized_join(limited.withColumn("at_limit", at_limit), words, ["last"], [F.col("text_key")], "left_outer")
    flagged = checkpointed(spelled.withColumn("partial", partial).withColumn("doubtful", doubtful))

    different = flagged.groupBy("text_key", "ending", "contexts").agg(F.bool_or("doubtful").alias("any_doubtful"))
    asked = different.select("text_key", "ending", "any_doubtful", F.posexplode("contexts").alias("level", "key"))
    doubt = asked.where("any_doubtful").groupBy("key").agg(F.count("*").alias("n_cut"))
    others = [(F.col(c) - F.coalesce("n_cut", F.lit(0))).alias(c) for c in ("n", "n_stop", "n_end")]
    needed = counts.where("key is not null").join(doubt, "key", "left").select("key", *others)
    met = salted_join(asked.where(F.col("ending").isin(*_OPEN)), needed, ["key"], [F.col("text_key")])
    levels = [F.max(F.when(F.col("level") == k, F.struct("n", "n_stop", "n_end"))).alias(f"level{k}") for k in range(LEVELS)]
    levelled = met.groupBy("text_key").agg(F.bool_or("any_doubtful").alias("any_doubtful"), *levels)

    judged = flagged.join(levelled, "text_key", "left").withColumn("evidence", _verdict(by)).where("evidence is not null").select("text_key", "__source", "evidence")
    rows = ends.where("last is not null").withColumn("__source", named)
    found = sized_join(rows, judged, ["text_key", "__source"], [F.col("doc")])
    return found.select(F.col("doc").alias(doc_id), F.col("source").alias(source), "evidence")


def cut_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per source: texts that are not blank, those that were cut, and their part."""
    cut = cut_texts(docs, doc_id, text, source).groupBy(source).agg(F.count("*").alias("n_cut")).withColumnRenamed(source, "__cut_source")
    every = docs.where(F.col(text).rlike(r"\S")).groupBy(source).agg(F.count("*").alias("n_texts"))
    both = every.join(cut, F.col(source).eqNullSafe(F.col("__cut_source")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0)).cast("bigint")
    return both.select(source, "n_texts", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_texts"), 6).alias("cut_part"))

"""Visually identical text with different characters (problem 4)."""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, salted_join, shuffle_partitions, sized_join

#: Tries for each shuffle partition; more tries are smaller.
TRIES_PER_PARTITION = 4

# Letters that look alike, by script. Each Latin letter stands with its imitations.
LOOKALIKES = {
    "Cyrillic": {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "W": "Ԝ", "X": "Х", "Y": "Ү", "Q": "Ԛ", "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у"},
    "Greek": {"A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "a": "α", "i": "ι", "k": "κ", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "x": "χ", "y": "γ"},
    "Armenian": {"L": "Լ", "O": "Օ", "S": "Տ", "U": "Ս", "f": "ք", "g": "ց", "h": "հ", "j": "յ", "n": "ո", "o": "օ", "q": "զ", "u": "ս", "w": "ա"},
    "Cherokee": {"A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ"},
    "letters of phonetics": {"a": "ɑ", "g": "ɡ", "i": "ɩ", "l": "ʟ", "v": "ʋ", "y": "ʏ", "e": "ҽ"},
}
# Ranges of characters without visible width (default ignorable code points).
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
# Compatibility characters of ordinary typography, which stay.
TYPOGRAPHY = frozenset("…‥\u2011\u00b4\u00a8\u00af\u00b8\u02d8\u02d9\u02da\u02db\u02dc\u02dd")
# Line breaks, which stay.
BREAKS = frozenset("\t\n\x0b\x0c\r\x85  ")


def ignorable(ch: str) -> bool:
    """Whether a character has no visible width: default ignorables and control characters other than breaks."""
    code = ord(ch)
    return any(a <= code <= b for a, b in IGNORABLE) or (unicodedata.category(ch) == "Cc" and ch not in BREAKS)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """(script of each look-alike letter, for each script the letter of it that looks like a given one)."""
    script, to = {}, {"Latin": {}}
    for name, pairs in LOOKALIKES.items():
        to.setdefault(name, {})
        for latin, other in pairs.items():
            script[other] = name
            to["Latin"][other] = latin
            to[name][latin] = other
    for name in list(to):
        if name == "Latin" or name not in ("Cyrillic", "Greek", "Armenian"):
            continue
        # by way of the Latin letter
        to[name] |= {other: to[name][latin] for other, latin in to["Latin"].items() if latin in to[name] and script[other] != name}
    return script, to


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str | None:
    """Latin, Greek, Cyrillic, Armenian, Cherokee, `letters of phonetics`, `other` for letters of other scripts; None for what is no letter."""
    found = _tables()[0].get(ch)
    if found:
        return found
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "").split(" ")[0].capitalize()
    return name if name in ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee") else "other"


@lru_cache(maxsize=65536)
def plain(ch: str) -> str:
    """A character's compatibility form in decomposed units; nothing for an ignorable one."""
    return "" if ignorable(ch) else ch if ch in TYPOGRAPHY else unicodedata.normalize("NFKD", ch)


@lru_cache(maxsize=65536)
def look(unit: str) -> str:
    """What a decomposed unit looks like: the Latin letter, if it imitates one."""
    return _tables()[1]["Latin"].get(unit, unit)


def skeleton(word: str) -> str:
    """What all words that look like this one share."""
    return "".join(look(u) for ch in word for u in unicodedata.normalize("NFD", plain(ch)))


@lru_cache(maxsize=1)
def _imitated() -> frozenset[str]:
    """Latin letters that some letter of another script looks like."""
    return frozenset(latin for pairs in LOOKALIKES.values() for latin in pairs)


@lru_cache(maxsize=65536)
def told(ch: str) -> tuple[str | None, bool]:
    """Script of a character's letter, and whether it shows that script: no letter of another one looks like it."""
    unit = unicodedata.normalize("NFD", ch)[0]
    script = script_of(unit)
    return script, script is not None and unit not in (_imitated() if script == "Latin" else _tables()[0])


def variants(word: str, budget: int) -> set[str]:
    """A skeleton and all that is left of it after up to `budget` omissions. Words within so many edits of each other share one."""
    every = last = {word}
    for _ in range(budget):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        every = every | last
    return every


def composed(word: str) -> str:
    """Without ignorables and compatibility forms, accents composed."""
    out, run = [], []
    for ch in word:
        if ch in TYPOGRAPHY:
            out.append(unicodedata.normalize("NFKC", "".join(run)) + ch)
            run = []
        elif not ignorable(ch):
            run.append(ch)
    return "".join(out) + unicodedata.normalize("NFKC", "".join(run))


def by_table(word: str) -> str:
    """The consistent form of a word by the tables alone.

    Ignorables go, compatibility forms become their characters, accents are composed. Of the scripts in a word that
    have look-alikes, the word's is one into which every letter of the others can be turned; of several, the one with
    the most letters that look like no other's, then Latin, then the one with the most letters. If there is none, the
    one with the most letters, and what imitates one of its letters is turned.
    """
    word = composed(word)
    scripts = [script_of(ch) for ch in unicodedata.normalize("NFD", word)]
    present = {s for s in scripts if s and s != "other"}
    if len(present) < 2:
        return word
    units, (known, to) = unicodedata.normalize("NFD", word), _tables()
    best = None
    for target in sorted(present - {"letters of phonetics", "Cherokee"} or present):
        foreign = [u for u, s in zip(units, scripts) if s and s not in ("other", target)]
        turned = sum(u in to.get(target, {}) for u in foreign)
        own = [u for u, s in zip(units, scripts) if s == target]
        distinct = sum(u not in known and not (target == "Latin" and any(u in pairs for pairs in LOOKALIKES.values())) for u in own)
        rank = (turned == len(foreign), distinct if turned == len(foreign) else len(own), target == "Latin", len(own))
        if turned and (best is None or rank > best[0]):
            best = (rank, target)
    if best is None:
        return word
    target = best[1]
    return unicodedata.normalize("NFC", "".join(to[target].get(u, u) if s and s not in ("other", target) else u for u, s in zip(units, scripts)))


class Trie:
    """Words by their decomposed units, with counts at their ends."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for unit in unicodedata.normalize("NFD", word):
            node = node.setdefault(unit, {})
        node[None] = (word, count)

    def closest(self, word: str, budget: int = 0) -> str | None:
        found = self.match(word, budget)
        return found and found[3]

    def match(self, word: str, budget: int = 0) -> tuple[int, int, int, str] | None:
        """Cost, negative count, exchanged letters and the word at the least weighted edit distance within the budget; NULL if there is none.

        The automaton's states are trie nodes with the cost so far and the number of letters exchanged. Reading a unit
        costs nothing along an edge that looks the same (the unit itself, a look-alike, its compatibility form) or if it
        is ignorable; any other exchange, omission or insertion costs 1. Among the cheapest words the most frequent wins,
        then the one with the fewest exchanged letters, then the first.
        """
        states = {id(self.root): (0, 0, self.root)}
        states = self._insert(states, budget)
        for ch in word:
            for unit in unicodedata.normalize("NFD", plain(ch)):
                after: dict[int, tuple[int, int, dict]] = {}
                for cost, swaps, node in states.values():
                    for edge, child in node.items():
                        if edge is not None:
                            same = look(edge) == look(unit)
                            self._keep(after, (cost + (not same), swaps + (edge != unit), child), budget)
                    self._keep(after, (cost + 1, swaps, node), budget)
                states = self._insert(after, budget)
        return min(((cost, -node[None][1], swaps, node[None][0]) for cost, swaps, node in states.values() if None in node), default=None)

    @staticmethod
    def _keep(states: dict, state: tuple[int, int, dict], budget: int) -> None:
        if state[0] <= budget and (id(state[2]) not in states or state[:2] < states[id(state[2])][:2]):
            states[id(state[2])] = state

    def _insert(self, states: dict, budget: int) -> dict:
        queue = list(states.values())
        while queue:
            cost, swaps, node = queue.pop()
            if cost < budget:
                for edge, child in node.items():
                    if edge is not None:
                        before = states.get(id(child))
                        self._keep(states, (cost + 1, swaps, child), budget)
                        if states.get(id(child)) is not before:
                            queue.append(states[id(child)])
        return states


@lru_cache(maxsize=1)
def _patterns():
    import regex

    hidden = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in IGNORABLE)
    unit = rf"[\p{{L}}\p{{M}}\p{{N}}{hidden}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
    # pictures shown as text by default that are forms of other characters (circled M, trade mark): emoji only before a selector or joiner
    shown = regex.compile(r"(?!\p{Emoji_Presentation})\p{Extended_Pictographic}")
    texts = "".join(c for c in map(chr, range(0x2000, 0x20000)) if shown.match(c) and unicodedata.normalize("NFKC", c) != c)
    picture = rf"(?![{texts}](?![\ufe0f\u200d]))\p{{Extended_Pictographic}}[\p{{EMod}}\ufe0e\ufe0f\u20e3\U000e0020-\U000e007f]*"
    return regex.compile(rf"(?P<emoji>{picture}(?:\u200d{picture})*|\p{{RI}}\p{{RI}}|[0-9#*]\ufe0f?\u20e3)|(?P<word>{unit}+(?:['’＇]{unit}+)*)")


def pieces(value: str) -> list[tuple[str, str | None]]:
    """A value cut into (text, form): words have no form yet, everything else its form by table. The texts join to the value.

    Emoji stay with their joiners and selectors; a sign that is a compatibility form counts as emoji only with one of these. Outside words, spaces other than U+0020 and breaks become U+0020.
    """
    out, at = [], 0

    def between(text: str) -> None:
        for ch in text:
            form = ch if ch in BREAKS or ch == " " else " " if unicodedata.category(ch) == "Zs" else composed(ch)
            out.append((ch, form))

    for found in _patterns().finditer(value):
        between(value[at : found.start()])
        out.append((found.group(), found.group() if found.lastgroup == "emoji" else None))
        at = found.end()
    between(value[at:])
    return out


def field_values(items: DataFrame, credits: DataFrame) -> DataFrame:
    """src_table, src_field, row_key, value of the three fields whose text is brought to one form; NULL values left out."""
    item = items.select(F.lit("collection_items").alias("src_table"), F.col("id").alias("row_key"), F.expr("stack(2, 'title', title, 'artist', artist)").alias("src_field", "value"))
    credit = credits.select(
        F.lit("catalog_track_artists").alias("src_table"),
        F.concat_ws("/", "catalog_instance_id", "published_generation", "track_id", "position", "role").alias("row_key"),
        F.lit("display_name").alias("src_field"),
        F.col("display_name").alias("value"),
    )
    return item.unionByName(credit).where("value is not null").select("src_table", "src_field", "row_key", "value")


def split_values(counted: DataFrame, budget: int = 0) -> DataFrame:
    """Of distinct values with counts n: the words and the pieces of those that may not be in the consistent form.

    word, keys, dirty, asked, n for every word (value NULL); value, pos, word, form for every piece of a value with a word or
    character that is not (dirty), or with a word that may imitate one of another script (form NULL where the word is to be
    looked up). A word is asked about if it is dirty, or if all its letters look like letters of other scripts and
    nothing in the value shows its own script.
    """
    schema = "value string, pos int, word string, form string, keys array<string>, dirty boolean, asked boolean, n bigint"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form_of = lru_cache(maxsize=200_000)(by_table)
        scripts_of = lru_cache(maxsize=200_000)(lambda text: frozenset(told(ch) for ch in text if told(ch)[0]))
        for batch in batches:
            rows, words = [], {}
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = pieces(value)
                shown = {script for text, form in parts if form is None for script, shows in scripts_of(text) if shows}
                changed, open_, done = False, False, []
                for text, form in parts:
                    if form is None:
                        dirty, scripts = form_of(text) != text, {script for script, _ in scripts_of(text)}
                        asked = dirty or (bool(scripts) and not scripts & shown and "other" not in scripts)
                        before = words.get(text, (dirty, False, 0))
                        words[text] = (dirty, before[1] or asked, before[2] + n)
                        changed, open_ = changed or dirty, open_ or asked
                        form = None if asked else text
                    else:
                        changed |= form != text
                    done.append((text, form))
                if changed or open_:
                    rows += [(value, i, text, form, None, changed, None, None) for i, (text, form) in enumerate(done)]
            rows += [(None, None, w, None, sorted(variants(skeleton(w), budget)), dirty, asked, n) for w, (dirty, asked, n) in words.items()]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int64())
                names = ["value", "pos", "word", "form", "keys", "dirty", "asked", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return counted.select("value", "n").mapInArrow(split, schema)


def canonical_words(words: DataFrame, budget: int = 0) -> DataFrame:
    """word, canonical of every word that is asked about: the closest word of the vocabulary within the budget, else its form by table.

    words: word, keys, dirty, asked, n, distinct. The words that are not dirty are the vocabulary, with their numbers of
    occurrences: of several spellings that look the same the most frequent is canonical, whatever its script. Words that look the
    same have one skeleton; words within `budget` edits share what is left of their skeletons after at most so many
    omissions (keys). So the vocabulary is cut into tries by the hashes of its keys, each word is read by the tries of its
    own keys and the best match counts; none is missed. A task holds one trie at a time.
    """
    tries = TRIES_PER_PARTITION * shuffle_partitions(words.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = Trie(), None
        for batch in batches:
            found = []
            for number, word, dirty, asked, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if number != at:
                    trie, at = Trie(), number
                if n:
                    trie.add(word, n)
                else:
                    cost, less, swaps, best = trie.match(word, budget) or (budget + 1, 0, 0, by_table(word))
                    found.append((word, cost, less, swaps, best))
            if found:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["word", "cost", "less", "swaps", "canonical"])

    placed = words.withColumn("trie", F.explode(F.array_distinct(F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(tries))))))
    # every vocabulary word of a trie comes before the words that are asked about, which have no count of their own
    vocabulary = placed.where("NOT dirty").select("trie", "word", "dirty", "asked", "n")
    asked = placed.where("asked").select("trie", "word", "dirty", "asked", F.lit(0).cast("bigint").alias("n"))
    both = vocabulary.unionByName(asked).repartition("trie").sortWithinPartitions("trie", F.desc("n"))
    matches = both.mapInArrow(read, "word string, cost int, less bigint, swaps int, canonical string")
    return matches.groupBy("word").agg(F.min(F.struct("cost", "less", "swaps", "canonical")).alias("best")).select("word", "best.canonical")


def consistent_values(values: DataFrame, budget: int = 0) -> DataFrame:
    """value, canonical, cause of every distinct value that is not in the consistent form; `value` non-null.

    cause: `characters` (some characters are not those of the consistent form), `imitation` (a word wholly of letters that
    look like those of a more frequent word of another script, in a value that shows nothing of its own). Values that are in it
    already give no row. Distinct values are cut into words, words are brought to their form once each, and the values
    are put together by position. budget: edits beyond look-alikes and ignorables that a dirty word may be from a known one.
    """
    counted = values.groupBy("value").agg(F.count("*").alias("n"))
    parts = checkpointed(split_values(counted, budget))
    words = parts.where("value is null").groupBy("word", "keys", "dirty").agg(F.bool_or("asked").alias("asked"), F.sum("n").alias("n"))
    known = canonical_words(words, budget)
    open_ = parts.where("value is not null")
    ready = open_.where("form is not null").select("value", "pos", "dirty", F.col("form").alias("text"))
    looked_up = salted_join(open_.where("form is null").select("value", "pos", "dirty", "word"), known, ["word"], [F.col("value")]).select("value", "pos", "dirty", F.col("canonical").alias("text"))
    whole = ready.unionByName(looked_up).groupBy("value").agg(F.bool_or("dirty").alias("dirty"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("__all"))
    cause = F.when(F.col("dirty"), "characters").otherwise("imitation").alias("cause")
    return whole.select("value", F.array_join(F.transform("__all", lambda x: x["text"]), "").alias("canonical"), cause).where("canonical <> value")


def affected_rows(values: DataFrame, budget: int = 0) -> DataFrame:
    """The rows of field_values that are not in the consistent form, with their canonical value and the cause (see consistent_values).

    One value may be in a third of the rows: values are made distinct by partial aggregation, and the rows that hold
    anything but printable ASCII and breaks, or no Latin letter that shows its script, are joined to the affected
    values, which are broadcast if they are few and else joined with salts. Repeated rows stay repeated.
    """
    changed = consistent_values(values, budget)
    shows = "".join(ch for ch in map(chr, range(128)) if told(ch)[1])
    rows = values.where(F.col("value").rlike(r"[^\t\n\x0b\x0c\r -~]") | ~F.col("value").rlike(f"[{shows}]"))
    return sized_join(rows, changed, ["value"], [F.col("row_key")]).select("src_table", "src_field", "row_key", "value", "canonical", "cause")

import random
import unicodedata

from cadastra.llm import glyphs

CHANGED = {
    "Ｔｈｅ　Ｂａｎｄ": "The Band", "Bridɡe": "Bridge", "Ноllоw": "Hollow", "Nօrtհերո"[:0] + "Carօսsel": "Carousel", "Béke": "Béke", "Kelvin": "Kelvin", "M​irror": "Mirror",
    "Soft­ly": "Softly", "No Break": "No Break", "𝗕𝗼𝗹𝗱": "Bold", "ｶﾞﾗｽ": "ガラス", "パン": "パン", "Atⅼas": "Atlas", "Фидeль": "Фидель", "Ι'll stay": None, "bell\x07": "bell", "👩‍ plain": "👩 plain", "(（": "((",
}
SAME = ["", " ", "plain", "two  spaces\tand\r\nlines", "“Quoted” – dash…", "Élan naïve", "Снег и Пыль", "DJ Снег", "ラジオの庭 4 👩‍🎤", "❤️‍🔥", "🏴‍☠️ 5", "カゼノバンド二", "’tis", "#️⃣"]


def forms(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(3)
    return {r["value"]: r["canonical"] for r in glyphs.consistent_values(df.where("value is not null")).collect()}


def test_changed_and_unchanged(spark):
    got = forms(spark, [*CHANGED, *SAME, *SAME])
    for value, want in CHANGED.items():
        if want is not None:
            assert got[value] == want, value
    assert not set(got) & set(SAME)


def test_signs_are_emoji_only_with_a_selector_or_joiner(spark):
    want = {"\u24c2etal": "Metal", "Live\u2122": "LiveTM", "\u2139nfo": "info", "Stop\u203c": "Stop!!", "What\u2049": "What!?", "\u3297": "\u795d", "\u3299": "\u79d8"}
    emoji = ["\u24c2\ufe0fetal", "Live\u2122\ufe0f", "\u2139\u200d\u2764", "\U0001f21a", "5\u00a9"]
    assert forms(spark, [*want, *emoji]) == want


def test_the_vocabulary_decides(spark):
    # by table alone this mixed word has as many letters of either script
    got = forms(spark, ["Сор", "Cop", "Cop", "С​or", "сосo", "соco"])
    assert got["С​or"] in ("Cor",)
    trie = glyphs.Trie()
    trie.add("Cop", 5)
    trie.add("Сор", 1)
    assert trie.closest("Co​p") == trie.closest("Со​р") == "Cop"
    trie.add("Сор", 5)
    assert trie.closest("Co​p") == "Cop" and trie.closest("Со​р") == "Сор"
    assert trie.closest("Cup") is None and trie.closest("Cup", 1) == "Cop" and trie.closest("Coop", 1) == "Cop" and trie.closest("Cp", 1) == "Cop"


def test_automaton_against_brute_force():
    rng = random.Random(2)
    vocabulary = {"".join(rng.choice("abо") for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(60)}
    trie = glyphs.Trie()
    for word, n in vocabulary.items():
        trie.add(word, n)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (glyphs.look(x) != glyphs.look(y))))
        return row[-1]

    for _ in range(200):
        word = "".join(rng.choice("abo") for _ in range(rng.randint(1, 6)))
        for budget in (0, 1, 2):
            best = min(distance(word, w) for w in vocabulary)
            found = trie.closest(word, budget)
            assert (found is None) == (best > budget)
            assert found is None or distance(word, found) == best


def test_canonical_form_is_stable(spark):
    rng = random.Random(4)
    letters = "abcо еéе́Ａ​'’-ガﾊﾟ👩‍🎤"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = forms(spark, values)
    for value, form in got.items():
        assert form != value and not any(glyphs.ignorable(c) and c not in "‍️" for c in form)
    plain = [v for v in values if v.isascii()]
    assert not set(plain) & set(got)


def test_rows_nulls_repeats_and_empty(spark):
    items = spark.createDataFrame([("1", "M​oon", None, "x"), ("2", None, "Ｂ", "y"), ("2", None, "Ｂ", "y"), ("3", "Moon", "", "z"), ("4", "a" * 100_000 + "​", None, None)], "id string, title string, artist string, value string")
    credits = spark.createDataFrame([("i", 1, "t", 0, None, "artist"), ("i", 1, "t", 1, "Bе", "artist")], "catalog_instance_id string, published_generation bigint, track_id string, position int, display_name string, role string")
    rows = glyphs.affected_rows(glyphs.field_values(items, credits)).collect()
    assert sorted((r["src_table"], r["src_field"], r["row_key"], r["canonical"][:5]) for r in rows) == sorted([
        ("collection_items", "title", "1", "Moon"), ("collection_items", "artist", "2", "B"), ("collection_items", "artist", "2", "B"), ("collection_items", "title", "4", "aaaaa"), ("catalog_track_artists", "display_name", "i/1/t/1/artist", "Be")
    ])
    assert glyphs.affected_rows(glyphs.field_values(items.where("false"), credits.where("false"))).count() == 0


def test_skeleton_joins_what_looks_alike():
    assert glyphs.skeleton("Ｍօօո​") == glyphs.skeleton("Moon") == "Moon"
    assert glyphs.skeleton("é") == glyphs.skeleton("é") == unicodedata.normalize("NFD", "é")


def test_the_most_frequent_spelling_is_canonical(spark):
    twin, mixed = "Сосо", "Cосо"
    values = ["Coco"] * 5 + [twin, mixed, "песня " + twin, "dr " + mixed]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r["value"]: (r["canonical"], r["cause"]) for r in glyphs.consistent_values(df).collect()}
    assert got == {twin: ("Coco", "imitation"), mixed: ("Coco", "characters"), "dr " + mixed: ("dr Coco", "characters")}
    # the other way round: a Latin imitation of a more frequent Cyrillic word
    df = spark.createDataFrame([(v,) for v in [twin] * 5 + ["Coco", "Coco band"]], "value string")
    assert {r["value"]: r["canonical"] for r in glyphs.consistent_values(df).collect()} == {"Coco": twin}


def test_a_budget_finds_words_some_edits_away(spark):
    rng = random.Random(7)
    vocabulary = {"".join(rng.choice("abcdmrt") for _ in range(rng.randint(2, 6))) for _ in range(80)}
    asked = ["".join(rng.choice("abcdmrt") for _ in range(rng.randint(2, 6))) + "\u200b" for _ in range(60)]
    trie = glyphs.Trie()
    for word in vocabulary:
        trie.add(word, 1)
    df = spark.createDataFrame([(v,) for v in [*vocabulary, *asked]], "value string").repartition(3)
    for budget in (0, 1, 2):
        got = {r["value"]: r["canonical"] for r in glyphs.consistent_values(df, budget).where("cause = 'characters'").collect()}
        want = {w: trie.match(w, budget) for w in asked}
        assert set(got) == set(asked)
        for word in asked:
            assert got[word] == (want[word][3] if want[word] else word[:-1]), (word, budget)

import random
from collections import Counter

import pytest

from stepweave.llm import leakage, overlap, packing, sentences

ITEM = "Someone renamed the shopping list Fope Mogeko while Lonose was syncing Tripnest. Recover name 343468 via the search bar, although Regazo locked row 39. Should Thursday be greyed out, try 12:30 and the pinned calendar instead."
LIKE = "Someone renamed the invoice draft Miro Tivoko while Bipimi was syncing Recipio. Recover name 920262 via the date picker, although Tefepo locked row 28. Should Friday be greyed out, try 8:40 and the blurred calendar instead."


def test_packing(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randrange(0, 300) for _ in range(400)] + ["y" * 1050, None, "", "z" * 250]
    df = spark.createDataFrame([(i % 390, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, container string").repartition(20)
    got = packing.pack(df, count=len, capacity=250, fan_in=4).collect()
    fill, pieces = {}, {}
    for r in got:
        n = r.token_end - r.token_start
        fill[r.container] = fill.get(r.container, 0) + n
        pieces.setdefault(r.item, []).append((r.piece_no, r.token_start, r.token_end))
    assert max(fill.values()) <= 250 and len(pieces) == 403
    sizes = sorted(sum(e - s for _, s, e in p) for p in pieces.values())
    assert sizes == sorted(len(t) for t in texts if t is not None)
    for p in pieces.values():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and all(e - s == 250 for _, s, e in p[:-1])
        assert len(p) == max(1, -(-sum(e - s for _, s, e in p) // 250))
    assert sum(fill.values()) / (250 * len(fill)) > 0.93
    assert packing.pack(df.limit(0), count=len).collect() == []


def test_best_fit():
    where, fills = packing.best_fit([5, 5, 3, 7, 10, 1], 10)
    assert sorted(fills) == [1, 10, 10, 10] and len(where) == 6
    assert packing.best_fit([], 10) == ([], [])


def test_tokens():
    count = packing.token_count()
    assert count("") == 0 and count("Tap the map pin.") == 5 and count("a " * 150_000) > 100_000
    assert count("x" * 1_000_003) == len(packing._encoding(packing.TOKENIZERS, packing.VOCABULARY).encode_ordinary("x" * 1_000_003))


def test_vocabulary_travels(spark):
    count = packing.token_count(spark=spark)
    got = spark.createDataFrame([("Tap the map pin.",)], "text string").mapInPandas(lambda bs: (b.assign(n=[count(t) for t in b.text])[["n"]] for b in bs), "n bigint")
    assert got.first().n == 5


def leaked(spark, texts, items=((1, ITEM), (2, LIKE))):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("x", "y")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame(list(items), "item_id bigint, text string")).collect()}


def test_leaks(spark):
    words = ITEM.split()
    texts = [
        f"Note. {ITEM} End.", ITEM.upper().replace(".", "").replace(",", ""), '{"prompt": "' + ITEM.replace(". ", ".\\n") + '"}', " ".join(words[:20]), " ".join(words[:9]) + " A pause came. " + " ".join(words[12:26]),
        ITEM.replace("Recover", "Recoover").replace("pinned", "pined"), "Fope Mogeko met Lonose and Regazo on Thursday.", " ".join(words[:8]), LIKE, "", None, "nothing here", ITEM.replace(" ", "\n"),
    ]
    assert leaked(spark, texts) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 2), (12, 1)}
    assert leaked(spark, texts[:1], [(1, None), (2, ""), (3, "a b")]) == set()
    assert leaked(spark, texts, [(1, ITEM), (9, ITEM)]) >= {(0, 1), (0, 9)}


def test_stock_opening(spark):
    items = [(i, "Held-out task. Read all lines before acting. " + x) for i, x in enumerate([ITEM, LIKE, "The tester must merge two quiz deck entries named Lalegi and Chikega without touching Gemo Mazeza."])]
    assert leaked(spark, ["Held-out task. Read all lines before acting. Then we left."], items) == set()
    assert leaked(spark, [ITEM], items) == {(0, 0)}


def test_leaks_without_filter(spark):
    """Beyond the size at which a filter is made the join alone gives the same rows."""
    rng = random.Random(4)
    ws = ["".join(rng.choice("bdfgkl") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    items = [(i, " ".join(rng.choice(ws) for _ in range(rng.randrange(8, 40)))) for i in range(60)]
    items += [(100 + i, t) for i, t in items[:3]]
    texts = [" ".join(rng.choice(ws) for _ in range(rng.randrange(0, 60))) + " " + " ".join(t.split()[: rng.randrange(1, 30)]) + " " + rng.choice(ws) for _ in range(4) for _, t in items]
    docs, held = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    with_filter = key(leakage.leaks(docs, held))
    assert with_filter == key(leakage.leaks(docs, held, filtered=0)) and len(with_filter) > 50
    # no document is lost that shares a third of an item in one piece, word for word, with two of the item's own words
    found = {(d, i) for d, i, _ in with_filter}
    in_texts = Counter(x for t in {t for _, t in items} for x in set(t.split()))
    for d, text in enumerate(texts):
        for i, t in items:
            w = t.split()
            size = max(leakage.SHINGLE + 1, -(-len(w) // 3))
            if any(" " + " ".join(w[k : k + size]) + " " in f" {text} " and len({x for x in w[k : k + size] if in_texts[x] == 1}) > 1 for k in range(len(w) - size + 1)):
                assert (d, i) in found


def test_pieces_far_apart_and_swapped(spark):
    words = ITEM.split()
    far = " ".join(words[20:28]) + " pause" * 300 + " " + " ".join(words[3:11])
    assert leaked(spark, [far, " ".join(words[20:28])]) == {(0, 1)}


def test_repeated_words(spark):
    """Texts of one word, and brackets and quotes that never close, take time in proportion to their length."""
    again, signs = "la " * 100_000, "日本語" * 30_000
    assert leaked(spark, [again, signs, "la la la la"], [(1, "la " * 300), (2, "日本語" * 100)]) == {(0, 1), (1, 2)}
    model = sentences.BoundaryModel(CORPUS)
    for text in ('("' * 30_000, " 'a" * 30_000, '"' * 50_000, "(" * 50_000):
        assert sentences.units(text, model)


def test_filter():
    import numpy as np

    inside, outside = np.random.default_rng(1).integers(-(2**62), 2**62, 5000), np.random.default_rng(2).integers(-(2**62), 2**62, 50_000)
    made = leakage.Filter(inside)
    assert made.holds(inside).all() and made.holds(outside).mean() < 0.01


def test_one_item_for_many_documents(spark):
    """An item in a third of all documents, and an item text under many ids."""
    docs = spark.createDataFrame([(i, ITEM if i % 3 == 0 else f"note {i}") for i in range(600)], "doc_id bigint, text string")
    held = spark.createDataFrame([(i, ITEM) for i in range(5)] + [(9, LIKE)], "item_id bigint, text string")
    assert leakage.leaks(docs, held).count() == 200 * 5
    assert {(r.item_id, r.n_documents) for r in leakage.leaked_items(docs, held).collect()} == {(i, 200) for i in range(5)}
    assert leakage.leaks(docs.limit(0), held).count() == 0 == leakage.leaks(docs, held.limit(0)).count()


GOALS = [
    ("a", "train", "Open Bankery and add Tani Delape to the recipe card for Saturday"), ("b", "test", "open bankery and add tani-delape to the recipe card for saturday, please!"), ("c", "val", "For Saturday, add Tani Delpae to the recipe card; open Ban​kery first"),
    ("d", "test", "Open Bankery and add Tani Delape to the recipe card for Sunday"), ("e", "test", "Open Bankery and add Tani Rolape to the recipe card for Saturday"), ("f", " Training", "Book 25 seats to Nava Cheromi with Quizzard leaving Wednesday at 11:20"),
    ("g", "TEST", "Book 26 seats to Nava Cheromi with Quizzard leaving Wednesday at 11:20"), ("h", "validation", "with quizzard book 25 saets to Nava Cheromi leaving Wednesday at 11:20"), ("i", None, "Open Bankery and add Tani Delape to the recipe card for Saturday"),
    ("a", "test", "Open Bankery and add Tani Delape to the recipe card for Saturday"), ("j", "test", None), ("k", "test", " "), ("l", "odd", "x"), ("m", "train", "用Quizzard预订25张去Nava Cheromi的票，周三11:20出发"), ("n", "test", "麻烦你用Quizzard预订25张去Nava Cheromi的票，周三11:20出发 ."), ("b", "test", "Open Bankery and add Tani Delape to the recipe card for Saturday"),
]


def test_overlap(spark):
    df = spark.createDataFrame([(*g, "src", "w") for g in GOALS], "episode_id string, split string, goal string, source string, words string")
    got = {(r.episode_a, r.episode_b) for r in overlap.found(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("f", "h"), ("m", "n")}
    assert {(r.split, r.source): (r.n_episodes, r.n_pairs) for r in overlap.report(df).collect()} == {("test", "src"): (2, 2), ("validation", "src"): (2, 2)}
    assert overlap.found(df.limit(0)).collect() == []


def test_short_goals_meet(spark):
    """A sign left out takes a goal of at most five fingerprints to another size of selections."""
    pairs = [("打 开 蓝 牙 灯", "打 开 蓝 牙"), ("关 闭 网 络", "关 闭 网")]
    rows = [(words, "", side == 0, side == 1) for pair in pairs for side, words in enumerate(pair)]
    classes = spark.createDataFrame(rows, "words string, numbers string, in_train boolean, in_held boolean")
    assert sorted((r.words_a, r.words_b) for r in overlap.class_pairs(classes).collect()) == sorted(pairs)


TEMPLATES = {
    "add": ["Open {app} and add {a} {b} to the list for {d}", "For {d}, add {a} {b} to the list; open {app} first please", "could you launch {app} and put {a} {b} to the list for {d}"],
    "find": ["Find {a} {b} in {app} and share the top 3 results by {d}", "In {app}, look up {a} {b} and send round the top 3 results by {d}, thanks", "search {a} {b} in {app} share the top 3 results by {d}"],
    "delete": ["Delete {a} {b} in {app} on {d}", "on {d} delete {a} {b} in {app}, please", "I want to delete {a} {b} in {app} on {d}"],
}


def test_overlap_like_the_tasks(spark):
    """All pairs of goals that were written from one task, and no others."""
    rng = random.Random(5)
    names = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(16)]
    goals = []
    for i in range(500):
        task = (rng.choice(list(TEMPLATES)), rng.choice(names[:8]), rng.choice(names[8:]), rng.choice(["Bankery", "Podbarn"]), rng.choice(["Monday", "Friday"]))
        text = rng.choice(TEMPLATES[task[0]]).format(a=task[1], b=task[2], app=task[3], d=task[4])
        if rng.random() < 0.3:
            word = rng.choice([w for w in (task[1], task[2], task[3], task[4])])
            at = rng.randrange(1, len(word) - 2)
            text = text.replace(word, word[:at] + word[at + 1] + word[at] + word[at + 2 :], 1)
        goals.append((str(i), rng.choice(["train", "test"]), text, "s", task))
    got = {(r.episode_a, r.episode_b) for r in overlap.found(spark.createDataFrame([g[:4] for g in goals], "episode_id string, split string, goal string, source string")).collect()}
    want = {(min(i, j), max(i, j)) for i, s, _, _, x in goals for j, z, _, _, y in goals if s == "train" and z == "test" and x == y}
    assert got == want and len(want) > 50


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Send Anna a photo of Ben", "Send Ben a photo of Anna", False), ("Book hotel in Austria", "Book hotel in Australia", False), ("Search for Maria in Contacts", "Share Maria in Contacts", False), ("Set the timer", "Start the timer", False),
        ("Find Nava in Kola", "Find Kola in Nava", False), ("Move it from Rome to Oslo", "Move it from Oslo to Rome", False), ("Add 195,613,586 to the list", "add 195613586 to the list", True), ("Delete mail 12", "Delete mail 21", False),
        ("Use Mapwren to scan Rime Mopesha, crop page 43", "Could you scan Rime Mopesha with Mapwren, crop page 43", True), ("Book 25 seats to Nava with Cartigo leaving Sunday", "With Cartigo, book 25 seats to Nava leaving Sunday", True),
        ("Pon una alarma en Parcelly a las 5:55 del lunes con el nombre Papo", "Oye, en Parcelly pon una alarma con el nombre Papo a las 5:55 del lunes, gracias", True), ("在Parcelly搜索Dari Tevoke，并分享前52个结果", "请在Parcelly里查找Dari Tevoke，分享前52个结果", True), ("搜索Dari", "分享Dari", False),
    ],
)
def test_same_task(a, b, same):
    (x, n), (y, m) = overlap.content(a), overlap.content(b)
    assert (n == m and overlap.aligned(x, y) is not None) == same
    assert (n == m and overlap.aligned(y, x) is not None) == same


def test_very_long_goals(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    long, other = " ".join(words[:2000]), " ".join(words[1990:])
    rows = [("a", "train", long, "s"), ("b", "test", long.replace(words[7], words[7][1:]), "s"), ("c", "test", other, "s"), ("d", "train", "x" * 100_000, "s"), ("e", "test", "X" * 100_000 + "!", "s"), ("f", "test", "x" * 99_999, "s"), (None, "test", long, "s"), ("g", None, long, "s")]
    got = {(r.episode_a, r.episode_b) for r in overlap.found(spark.createDataFrame(rows, "episode_id string, split string, goal string, source string")).collect()}
    assert got == {("a", "b"), ("d", "e")}


def test_winnowing():
    assert overlap.fingerprints("ab") == ["^ab$"] and len(overlap.fingerprints("monday")) == 1
    whole = overlap.fingerprints("donaudampfschifffahrt")
    assert len(whole) > 1 and set(overlap.fingerprints("donaudampfschifffahrtx")) & set(whole)


def test_report_counts_like_the_pairs(spark):
    df = spark.createDataFrame([("a", "train", "Tap Bankery", "s"), ("a", "test", "tap bankery", "s"), ("b", "train", "Tap Bankery!", "s"), ("c", "test", "tap Bankery", "t"), ("d", "val", "tap Bnakery please", "t"), ("e", "test", "tap Podbarn", "t"), ("e", "train", "tap Podbarn", "t")], "episode_id string, split string, goal string, source string")
    pairs = overlap.overlaps(df).groupBy("split", "source").count().collect()
    assert {(r.split, r.source): r.n_pairs for r in overlap.report(df).collect()} == {(r.split, r.source): r["count"] for r in pairs}
    assert {(r.split, r.source): r.n_episodes for r in overlap.report(df).collect()} == {("test", "s"): 1, ("test", "t"): 1, ("validation", "t"): 1}


def test_slips():
    assert overlap.slips("rati", "rtai", 1) and overlap.slips("seats", "sats", 1) and overlap.slips("fashi", "fasshi", 1)
    assert not overlap.slips("monday", "sunday", 2) and not overlap.slips("tuesday", "thursday", 2) and not overlap.slips("tako", "taka", 1)


CORPUS = ["Dr. Lasoza re-checked shard 32 by hand. The run took 5.5 s. We saw approx. 6 boxes.\n\nNo. 5 is a copy. It failed again."] * 40 + ["The list opened. Dr. Mopa left early. It failed again.\n\nThe run took 4 s."] * 40


@pytest.fixture(scope="module")
def model():
    return sentences.BoundaryModel(CORPUS)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Lasoza left. It failed again.", ["Dr. Lasoza left.", "It failed again."]), ("# Head\nThe run took 5.5 s.", ["# Head", "The run took 5.5 s."]), ("- One item\n- The list opened. It failed again.", ["- One item", "- The list opened.", "It failed again."]),
        ('She wrote: "Open it. Press it." It failed again.', ['She wrote: "Open it. Press it."', "It failed again."]), ("He typed “Is it done?” and got no answer.", ["He typed “Is it done?” and got no answer."]), ("The\nlist\nopened.  It failed again!", ["The\nlist\nopened.", "It failed again!"]),
        ("第6屏没有节点。真的吗？！等一等……加载。", ["第6屏没有节点。", "真的吗？！", "等一等……加载。"]), ("संपर्क लौटा। रसीद खुली।", ["संपर्क लौटा।", "रसीद खुली।"]), ('Text\n\n{"a": "One. Two."}\nThe list opened.', ["Text", '{"a": "One. Two."}', "The list opened."]),
        ("(It failed again.) The list opened.", ["(It failed again.)", "The list opened."]), ("", []), (" \n\t\n", []), ("no end", ["no end"]), ("We saw approx. 6 boxes.", ["We saw approx. 6 boxes."]), ("1. The list opened.\n2. It failed again.", ["1. The list opened.", "2. It failed again."]),
    ],
)
def test_units(model, text, want):
    assert [text[a:b] for a, b in sentences.units(text, model)] == want


def test_long_quotes_hold_together(model):
    inside = "The list opened. It failed again. " * 60
    for text in (f"He typed “{inside.strip()}” and got no answer.", f"It failed again ({inside.strip()}) and stopped."):
        assert sentences.units(text, model) == [(0, len(text))]


def test_thai():
    model = sentences.BoundaryModel(["หน้าที่ 20 ไม่มีโหนดเลยครับ การเชื่อมต่อกลับมาแล้ว\n\nการเชื่อมต่อกลับมาแล้ว หน้าที่ 3 ไม่มีโหนดเลยครับ"] * 40)
    text = "หน้าที่ 58 ไม่มีโหนดเลยครับ การเชื่อมต่อกลับมาแล้ว"
    assert [text[a:b] for a, b in sentences.units(text, model)] == ["หน้าที่ 58 ไม่มีโหนดเลยครับ", "การเชื่อมต่อกลับมาแล้ว"]


def test_held_out_boundaries():
    """Accuracy on boundaries that are certain, of texts the model has not seen."""
    rng = random.Random(9)
    parts = ["Dr. Lasoza re-checked shard 3 by hand.", "The run took 5.5 s.", "We saw approx. 6 boxes.", "It failed again.", "No. 5 is a copy."]
    docs = [[rng.choice(parts) for _ in range(rng.randrange(1, 6))] for _ in range(900)]
    model = sentences.BoundaryModel([" ".join(a) + "\n\n" + " ".join(b) for a, b in zip(docs[:600:2], docs[1:600:2])])
    right = sum([" ".join(d)[a:b] for a, b in sentences.units(" ".join(d), model)] == d for d in docs[600:])
    assert right >= 0.98 * 300


def test_sentence_table(spark):
    rows = [(1, t, 9) for t in CORPUS[:3]] + [(2, None, 9), (3, "", 9), (None, "It failed again.", 9), (4, "It failed again. " * 20_000, 9)]
    got = sentences.sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int")).collect()
    assert sum(r.doc_id == 4 for r in got) == 20_000 and sum(r.doc_id is None for r in got) == 1 and not any(r.doc_id in (2, 3) for r in got)
    assert sentences.sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int").limit(0)).collect() == []

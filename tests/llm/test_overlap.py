import random

import pytest

from stepweave.llm import overlap

SPOILT = [
    ("Rename train ticket Gezo Rovili in Clockmoor and move it to folder 22", "Renme tain ticket Gezo Rvili in Clockmoor and move it to fodler 22"),
    ("Rename Rovili Clockmoor", "Renmae Rovli Clockmoor"), ("Rename Rovili", "Rnaeme Rovilii"), ("Delete Rovilda", "Delete Orvilad"), ("Delete rovildas", "Delete Orvilad"), ("tap Bankery", "tap " * 60 + "Bankery"), ("Rename the llist", "rename list"),
    ("打开蓝牙灯", "打开蓝牙"), ("灯 5", "5"), ("Search Rovili", "Serach Rovili"), ("!!! 7", "7 please"),
]


def goals_table(spark, goals):
    return spark.createDataFrame([(f"{i}", split, g, "s") for i, (split, g) in enumerate(goals)], "episode_id string, split string, goal string, source string")


def same(a, b):
    (x, n), (y, m) = overlap.content(a), overlap.content(b)
    return bool(x and y) and n == m and (x == y or overlap.aligned(x, y) is not None)


@pytest.mark.parametrize("turned", [False, True])
def test_slips_in_many_words(spark, turned):
    """Goals meet whichever of their words slips have spoilt."""
    goals = [(split, g) for pair in SPOILT for split, g in zip(("test", "train") if turned else ("train", "test"), pair)]
    want = {tuple(sorted((str(i), str(j)))) for i, (s, x) in enumerate(goals) for j, (z, y) in enumerate(goals) if s == "train" and z == "test" and same(x, y)}
    assert {tuple(r) for r in overlap.found(goals_table(spark, goals)).collect()} == want and len(want) >= len(SPOILT) - 1


def slipped(rng, word):
    at = rng.randrange(len(word) - 1)
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + word[at] + word[at:], word[:at] + word[at + 1] + word[at] + word[at + 2 :], word])


def test_classes_meet_as_all_pairs_do(spark):
    """The join gives what every pair of classes with equal numbers gives, with words asked alone or in pairs."""
    rng = random.Random(11)
    names = ["".join(rng.choice("bdgklmnr") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(14)] + ["search", "please", "named", "灯", "牙", "蓝"]
    classes = {}
    for _ in range(400):
        words = [w if len(w) < 2 else slipped(rng, w) for w in rng.choices(names, k=rng.randrange(1, 6))]
        sequence, numbers = overlap.content(" ".join(words) + rng.choice(["", " 5"]))
        if sequence:
            was = classes.get((sequence, " ".join(numbers)), (False, False))
            side = rng.random() < 0.5
            classes[sequence, " ".join(numbers)] = (was[0] or side, was[1] or not side)
    want = {(a, b) for (a, n), (x, _) in classes.items() for (b, m), (_, y) in classes.items() if x and y and a != b and n == m and overlap.aligned(a, b) is not None}
    rows = spark.createDataFrame([(*k, *v) for k, v in classes.items()], "words string, numbers string, in_train boolean, in_held boolean")
    for common in (0, 10, overlap.COMMON):
        assert {(r.words_a, r.words_b) for r in overlap.class_pairs(rows, common).collect()} == want
    assert len(want) > 50


def test_words_alike_share_a_variant():
    rng = random.Random(12)
    for _ in range(20_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 9)))
        b = slipped(rng, slipped(rng, a + "a"))
        if a != b and overlap._same_word(a, b):
            there = overlap.variants(b)
            assert any(v == w and (p != q or p == overlap.WHOLE) for v, p in overlap.variants(a) for w, q in there), (a, b)

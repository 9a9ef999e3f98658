import random

from stepweave.llm.completeness import TerminalContexts, TokenModel, segments, words
from stepweave.llm.evidence import complete_ends, measured, token_model
from stepweave.llm.pairs import broken_pairs
from stepweave.llm.truncation import truncated_outputs

OPEN = "I will tap the map pin next"
LONG = "The keyboard is up and the field is focused. " * 100 + "\n" + OPEN


def no_answers(spark):
    return (
        spark.createDataFrame([], "result_id bigint, example_id bigint, config_id int, raw_output string, generated_tokens bigint, full_model_calls int"),
        spark.createDataFrame([], "example_id bigint, prompt_text string, goal string"), spark.createDataFrame([], "config_id int, max_new_tokens int"),
    )


def test_long_texts_count_for_pairs(spark):
    """Ends are known from texts of any length."""
    rows = [(i, "Task goal: Open Bankery", LONG) for i in range(30)] + [(100, "Task goal: Open Bankery", OPEN), (101, "Task goal: Open Bankery", "The keyboard is up and the fie")]
    got = broken_pairs(spark.createDataFrame(rows, "example_id bigint, prompt_text string, response_text string"), *no_answers(spark))
    assert {(r.record_id, r.defect) for r in got.collect()} == {(101, "truncated")}


def made(spark, texts, tokens):
    rows = spark.createDataFrame([(i, t, n, True) for i, (t, n) in enumerate(zip(texts, tokens))], "id bigint, text string, tokens bigint, counts boolean").repartition(5)
    return measured(rows, "id bigint")


def test_models_of_all_rows(spark):
    """What tasks and groups add up is what all rows in one place give."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["tap", "the", "button", "again", "list", "42", "(x)", "Vesa"]) for _ in range(rng.randrange(5, 60))) + rng.choice([".", ".", ""]) for _ in range(400)]
    texts += ["list " * 30_000 + ".", "tap.", *texts[:20], "Tap the"]
    tokens = [len(t.split()) + t.count("(x)") * 2 for t in texts]
    tokens[7], tokens[8], tokens[9] = 10**9, None, -1
    here = made(spark, texts, tokens)
    done = [(t, n) for t, n in zip(texts, tokens) if n and n > 0 and t.endswith(".")]
    model, want = token_model(here), TokenModel(*map(list, zip(*done)))
    assert all(abs(model.excess(t, n) - want.excess(t, n)) < 1e-6 for t, n in done) and abs(model.excess(*done[0])) < 0.2
    contexts = TerminalContexts(texts)
    ends = {r["last"]: r.complete for r in complete_ends(here, here.select("last")).collect()}
    assert ends == {s[-1]: contexts.complete(t) for t in texts if not t.endswith(".") and (s := segments(t))} and set(ends.values()) == {True, False}
    assert token_model(here.limit(0)).weights is None


def test_ends_are_rates():
    """A loss that occurs among more texts, each time at the same place, is no complete end."""
    whole, cut = "The clock shows the right day.", "The clock shows"
    few, many = TerminalContexts([whole] * 20_000 + [cut] * 2), TerminalContexts([whole] * 200_000 + [cut] * 20)
    assert not few.complete(cut) and not many.complete(cut) and not few.ended(words("The cloc"), few.counts, few.scale)
    assert few.ended(["The"], {"whole The": 5, "known The": 2}, few.scale) and not many.ended(["The"], {"whole The": 5, "known The": 2}, many.scale)


def test_long_texts_count_for_cut_texts(spark):
    """A long output shows how texts may end, and tokens that no text of its source needs."""
    rows = [(i, "s", LONG, None, 1) for i in range(30)] + [(100, "s", OPEN, None, 1), (101, "s", "The keyboard is up and the fie", None, 1)]
    rng = random.Random(7)
    for i in range(60):
        said = [rng.choice(["tap", "the", "button", "again", "list", "42", "Vesa"]) for _ in range(rng.randrange(1200, 2500) if i % 3 else rng.randrange(4, 40))]
        rows.append((1000 + i, "s", " ".join(said) + ".", len(said) + 1, 1))
    rows.append((2000, "s", "tap the button again.", 500, 1))
    results = spark.createDataFrame(rows, "result_id bigint, source string, raw_output string, generated_tokens bigint, config_id int")
    got = truncated_outputs(results, spark.createDataFrame([(1, 64)], "config_id int, max_new_tokens int"))
    assert {(r.result_id, r.cut) for r in got.where("cut is not null").collect()} == {(101, "context"), (2000, "tokens")}

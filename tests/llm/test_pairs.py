import random

import pytest

from stepweave.llm.completeness import TerminalContexts, TokenModel, ending, open_items
from stepweave.llm.language import language
from stepweave.llm.pairs import broken_pairs, defect
from stepweave.llm.refusals import declines
from stepweave.llm.truncation import rates, truncated_outputs

PROMPT = "Task goal: Open Bankery and add Tani Delape to the recipe card for Saturday\nInstruction for the current step: Wait for the map pin to load\nActions already performed:\nclick: (done)"
SOUND = [
    '<thinking>\nThe dialog reads "Sorry, I cannot open this file", so I dismiss it.\n</thinking>\n<tool_call>\n{"name": "m", "arguments": {"action": "type", "text": "liste de courses"}}\n</tool_call>',
    "CLICK(3, 4)", "The keyboard is up and the field is focused.", "I still need to enter Vesa before the list updates.\nSCROLL(up)", "I will tap the Save button next",
]
CASES = {
    "empty": [None, "", " \n", "​", "{}", '""', "<thinking>\n</thinking>", "<tool_call>\n{}\n</tool_call>"],
    "truncated": ['<tool_call>\n{"name": "mobile_use", "arg', "<thinking>\nThe page shows", "<thinking>\nAll done.\n</thinking>\n<tool_ca", "Das ist gut. �", "The keyboard is up and the fie"],
    "refusal": ["I'm sorry, but I can't help with that.", "Tapping there is off limits to me.", "Leider liegt das außerhalb dessen, was mir erlaubt ist.", "No, eso no lo haré en Mapwren.", "抱歉，我无法协助完成这个请求。"],
    "echo": ["Open Bankery and add Tani Delape to the recipe card for Saturday", "Q: OPEN BANKERY AND ADD TANI DELAPE TO THE RECIPE CARD FOR SATURDAY?", PROMPT, "<thinking>\nWait for the map pin to load\n</thinking>", "Tap it. Open Bankery and add Tani Delape to the recipe card for Saturday"],
    "other_language": ["La fecha está en martes, que coincide con lo pedido.", "日期已经是周四，符合要求。\nCLICK(1, 2)", "Die Seite zeigt 19 Einträge und der gesuchte liegt weiter unten."],
}
SAMPLE = ["The keyboard is up and the field is focused.", "I still need to enter Vesa before the list updates.", "The page shows 3 entries and the wanted one is further down."] * 20 + ["I will tap the Save button next", "I will tap the map pin next"] * 10


@pytest.fixture(scope="module")
def models():
    return TokenModel([], []), TerminalContexts(SAMPLE)


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts] + [(None, t) for t in SOUND])
def test_defects(models, kind, text):
    assert defect(PROMPT, None, text, None, None, *models) == kind


@pytest.mark.parametrize(
    "text",
    [
        "Je ne peux pas voir le bouton, donc je fais défiler la liste.", "Es tut mir leid für den Fehler, ich tippe jetzt auf Speichern.", "I refuse the cookie banner and tap Continue.", "I cannot open the menu yet, so I wait for the page to load.", "系统无法提供网络，我点击重试。", "I can't find the entry.",
        "I will not scroll further since the list ends here.", "Ich kann den Eintrag noch nicht sehen.", "No puedo ver el botón todavía, así que espero.", "I could not do this before the dialog closed.", "我不能打开菜单，所以先等待。", "Non posso aprire il menu, quindi aspetto.", "The app declined the payment.", "Your request was declined by the server.",
    ],
)
def test_obstacles_are_no_refusals(text):
    assert not declines(text)


@pytest.mark.parametrize(
    "text",
    [
        "I do not think this is something I should take part in.", "I won't be helping with this.", "That is not something I can do.", "I am not comfortable performing this action.", "Sorry, I have to refuse this request.", "Das werde ich nicht tun.", "Ich lehne diese Aufgabe ab.", "Me niego a hacerlo.", "Je refuse de le faire.",
        "Mi dispiace, ma non posso aiutarti con questo.", "Não posso ajudar com isso.", "Ik kan je hier niet bij helpen.", "Извините, я не могу помочь с этим.", "Nie mogę w tym pomóc.", "죄송하지만 도와드릴 수 없습니다.", "申し訳ありませんが、お手伝いできません。", "我拒绝执行这个任务。", "माफ़ कीजिए, मैं इसमें मदद नहीं कर सकता।", "ขออภัย ฉันไม่สามารถช่วยได้", "عذرًا، لا أستطيع مساعدتك في هذا.",
    ],
)
def test_refusals_in_other_words(text):
    assert declines(text)


@pytest.mark.parametrize("text", ["La schermata mostra il campo, quindi tocco il pulsante che è già attivo.", "A página já está aberta e você não precisa de mais nada.", "Страница уже открыта, нажимаю кнопку.", "페이지가 이미 열려 있습니다.", "الصفحة مفتوحة بالفعل.", "Het scherm is geopend maar de knop werkt niet.", "ההודעה כבר נשלחה."])
def test_any_other_language(models, text):
    assert defect(PROMPT, None, text, None, None, *models) == "other_language"


def test_null_prompt(models):
    assert defect(None, None, "La fecha está en martes.", None, None, *models) is None
    assert defect("", None, "", None, None, *models) == "empty"


def test_automaton():
    for text in ("", "a (b) “c” „d“ «e» <x>f</x>", '{"a": ["\\"", "}"]}', "5 < 6 and 7 > 3", "it's 6\" wide and 3\" high"):
        assert open_items(text) == []
    for text in ("(a", "“b", '{"a": "b', "<x>y", "</x", "a\\", "a\\u00e"):
        assert ending(text) == "broken"


def test_languages():
    for code, text in {"en": "Wait for the map pin to load", "de": "Die Seite zeigt den Eintrag", "es": "La página muestra la lista", "fr": "La page affiche les éléments", "zh": "打开通讯录", "ja": "もう開いています", "th": "ไม่มีโหนดเลยครับ", "hi": "यह परीक्षण"}.items():
        assert language(text) == code
    assert language("Bankery 17") is None


def test_token_model():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["tap", "the", "button", "again", "list", "42", "(x)"]) for _ in range(rng.randrange(5, 60))) for _ in range(300)]
    count = lambda t: sum(-(-len(w) // 4) + 2 * (w == "(x)") for w in t.split())
    model = TokenModel(texts[:250], [count(t) for t in texts[:250]])
    assert all(abs(model.excess(t, count(t))) < 0.2 for t in texts[250:])
    whole = " ".join(["list"] * 80)
    assert model.excess(whole[:200], count(whole)) > 0.5


def tables(spark, results):
    schema = "result_id bigint, source string, raw_output string, generated_tokens bigint, config_id int, example_id bigint, full_model_calls int, prompt_text string"
    return spark.createDataFrame(results, schema), spark.createDataFrame([(1, 64), (1, 64)], "config_id int, max_new_tokens int")


def test_truncated_table(spark):
    rows = [(i, "s", SAMPLE[i % len(SAMPLE)], None, 1, 1, 1, "clash") for i in range(60)]
    rows += [(100, None, "The keyboard is up and the fie", None, None, 1, 1, ""), (101, "s", None, 5, 1, 1, 1, ""), (102, "s", "  ", 0, 1, 1, 1, ""), (103, "s", '{"a": "' + "x" * 200_000, -3, 9, None, None, None)]
    results, configs = tables(spark, rows)
    judged = truncated_outputs(results, configs)
    assert {r.result_id: r.cut for r in judged.collect() if r.cut} == {100: "context", 103: "structure"}
    assert {r.source: (r.n_outputs, r.n_truncated) for r in rates(judged).collect()} == {"s": (62, 1), None: (1, 1)}
    assert truncated_outputs(results.limit(0), configs).collect() == []


def test_baseline_of_a_source(spark):
    """An open ending of the expected tokens counts as cut only in a source whose texts nearly all end with a terminator."""
    done = "The keyboard is up and the field is focused."
    rows = [(i, "steady", done, 9, 1, 1, 1, "") for i in range(300)] + [(1000 + i, "loose", done if i % 2 else "I will tap the map pin next", 9 if i % 2 else 6, 1, 1, 1, "") for i in range(300)]
    rows += [(5000, "steady", "The keyboard is up and the fie", 6, 1, 1, 1, ""), (5001, "loose", "The keyboard is up and the fie", 6, 1, 1, 1, "")]
    results, configs = tables(spark, rows)
    assert {r.result_id for r in truncated_outputs(results, configs).where("cut is not null").collect()} == {5000}


def test_pairs_tables(spark):
    results, configs = tables(spark, [(1, "s", None, None, 1, 5, 0, "x"), (2, "s", None, None, 1, 5, 1, "x"), (3, "s", "I cannot help with that.", None, 1, 99, None, "x")])
    training = spark.createDataFrame([(7, PROMPT, CASES["echo"][0], "x"), (7, PROMPT, CASES["echo"][0], "x"), (None, None, None, None)], "example_id bigint, prompt_text string, response_text string, raw_output string")
    examples = spark.createDataFrame([(5, PROMPT, "Open it")], "example_id bigint, prompt_text string, goal string")
    got = sorted(map(tuple, broken_pairs(training, results, examples, configs).collect()), key=str)
    assert got == sorted([("training_examples", 7, "echo")] * 2 + [("training_examples", None, "empty"), ("step_results", 2, "empty"), ("step_results", 3, "refusal")], key=str)
    assert broken_pairs(training.limit(0), results.limit(0), examples.limit(0), configs.limit(0)).collect() == []

import json

import pandas as pd
import pytest

from stepweave.operators.inference import answer, retried
from stepweave.operators.payloads import key_paths, leaking_paths, repair
from stepweave.sources.nested_json import annotated, manifest_path, splits


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}), ('x {"a": {"b": [1, 2', {"a": {"b": [1, 2]}}), ('{"a": "tex', {"a": "tex"}), ('{"a": 1, "b', {"a": 1}), ('{"a": 1, "b":', {"a": 1}), ('{"a": 1,', {"a": 1}), ('{"a": [1, {"c": "d"}', {"a": [1, {"c": "d"}]}),
        ('{"a": "q\\"', {"a": 'q"'}), ('{"a": 1} tail', {"a": 1}), ('{"', {}), ("{", {}), (None, None), ("no", None), ("", None),
    ],
)
def test_repair(text, want):
    got = repair(text)
    assert (json.loads(got) if got else None) == want


def test_every_cut_is_readable():
    text = '{"name": "m", "arguments": {"action": "type", "text": "a \\"b\\" {c", "at": [1, 2.5, null]}}'
    for end in range(1, len(text)):
        assert isinstance(json.loads(repair(text[:end])), dict)


def test_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"future_x": 1}, "b": [{"c": 1}, {"c": 2}]}', "p"), (2, "{", "p"), (3, None, "p"), (None, '"{\\"d\\": 1}"', "p")], "k bigint, j string, path string")
    paths = key_paths(df, "k", "j")
    assert sorted((r.record_id or 0, r.path) for r in paths.collect()) == [(0, "d"), (1, "a"), (1, "a.future_x"), (1, "b"), (1, "b[].c")]
    assert [r.path for r in leaking_paths(paths).collect()] == ["a.future_x"]


def test_model_calls(spark):
    df = spark.createDataFrame([(i, f"q{i}") for i in range(50)], "id bigint, prompt string").repartition(3)
    got = answer(df, retried(lambda row: row["prompt"].upper()), "id").collect()
    assert {r.id: r.response for r in got} == {i: f"Q{i}" for i in range(50)}
    with pytest.raises(Exception, match="responses"):
        answer(df, lambda b: ["x"] * (len(b) - 1), "id").collect()
    tries = []

    def flaky(row):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert retried(flaky, wait=0.001)(pd.DataFrame({"a": [1]})) == ["ok"]
    with pytest.raises(TimeoutError):
        retried(lambda row: (_ for _ in ()).throw(TimeoutError()), attempts=2, wait=0.001)(pd.DataFrame({"a": [1]}))


def test_nested_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"prepared_path": "/x"}')
    (tmp_path / "e.json").write_text("{}")
    assert manifest_path(spark, str(tmp_path / "m.json")) == "/x"
    with pytest.raises(ValueError):
        manifest_path(spark, str(tmp_path / "e.json"))
    (tmp_path / "s.json").write_text('{"train": [1, 2], "test": [2, 3]}')
    assert {r.episode_id: r.split for r in splits(spark, str(tmp_path / "s.json")).collect()} == {1: "train", 2: "test", 3: "test"}
    a, b = "0" * 32, "f" * 32
    (tmp_path / "t.json").write_text(json.dumps({a: {"instruction": "go", "app": "x", "steps": [{"step_id": 4, "image_path": "p", "action": "CLICK"}, {"step_id": 5, "image_path": "q"}]}, b: {"instruction": "no"}}))
    (tmp_path / f"ann_{a}_1.json").write_text(json.dumps({"steps": [{"step_id": 5, "action": "old"}, {"step_id": 5, "action": "new", "touch_coord": [1, 2]}]}))
    rows = annotated(spark, str(tmp_path / "t.json"), str(tmp_path / "ann_*.json")).collect()
    got = sorted((r.episode_id, r.step_index, r.next_image_path, r.annotation and r.annotation.action) for r in rows if r.step_index is not None)
    assert got == [(a, 0, "q", None), (a, 1, None, "new")] and len(rows) == 3

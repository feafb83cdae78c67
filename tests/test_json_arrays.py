import json
import random

import numpy as np
import pytest

from chatloom.sources import files, json_arrays
from chatloom.sources.json_arrays import State, elements, ranges, structure, transitions


def dialogs(seed, n):
    rng = random.Random(seed)
    odd = ['"', "\\", "\\\\", '\\"', "[", "]", "{", "}", ",", "é", "日本", "\n", "𝄞", "a", "b c", '},{"', "\\n"]
    return [{"id": str(i), "image": rng.choice([None, "x.jpg"]), "conversations": [{"from": "human", "value": "".join(rng.choices(odd, k=rng.randint(0, 12)))} for _ in range(rng.randint(0, 3))]} for i in range(n)]


def written(path, text):
    path.write_bytes(text.encode())
    return str(path), len(text.encode())


FORMS = {
    "plain": lambda d: json.dumps(d),
    "characters": lambda d: json.dumps(d, ensure_ascii=False),
    "indented": lambda d: "  " + json.dumps(d, indent=3) + "\n\n",
    "tight": lambda d: json.dumps(d, separators=(",", ":")),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("split", [1, 7, 100, 10**9])
def test_ranges_give_every_element_once(tmp_path, monkeypatch, form, split):
    """Without Spark: whatever the ranges and blocks, also of a single byte, within strings, escapes and characters."""
    monkeypatch.setattr(json_arrays, "BLOCK", 13)
    data = dialogs(1, 12)
    path, size = written(tmp_path / "d.json", FORMS[form](data))
    got, state = [], State()
    for _, _, _, start, end in ranges([(path, size)], split):
        got += [json.loads(e) for e in elements(path, start, end, size, state)]
        after = transitions(path, start, end)[json_arrays.ASSUMED.index(State(state.inside, state.escaped))]
        state = State(after.inside, after.escaped, state.depth + after.depth)
    assert got == data and state == State()


def test_structure_equals_a_walk():
    rng = random.Random(2)
    for _ in range(300):
        data = np.frombuffer("".join(rng.choices('"\\[]{},ab', k=rng.randint(0, 30))).encode(), np.uint8)
        for begin in (*json_arrays.ASSUMED, State(depth=3)):
            inside, escaped, depth, places, depths = begin.inside, begin.escaped, begin.depth, [], []
            ok = True
            for i, c in enumerate(data.tobytes().decode()):
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped, ok = True, ok and inside  # outside a string it is no JSON
                elif c == '"':
                    inside = not inside
                elif not inside and c in "[]{},":
                    depth += {"[": 1, "{": 1, ",": 0}.get(c, -1)
                    places.append(i)
                    depths.append(depth)
            if ok:
                got = structure(data, begin)
                assert (got[0].tolist(), got[1].tolist(), got[2]) == (places, depths, State(inside, escaped, depth))


def test_one_file_by_many_tasks(spark, tmp_path):
    data = dialogs(3, 400)
    path, _ = written(tmp_path / "big.json", json.dumps(data, ensure_ascii=False))
    written(tmp_path / "small.json", json.dumps(dialogs(4, 3)))
    pattern = str(tmp_path / "*.json")
    got = files.read_dialog_json(spark, pattern, split_bytes=1500)
    want = spark.read.schema(got.schema).json(pattern, multiLine=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 403
    assert files.read_dialog_json(spark, path, split_bytes=1500).rdd.getNumPartitions() > 10
    assert files.read_dialog_json(spark, [str(tmp_path)], split_bytes=10**9).count() == 403


@pytest.mark.parametrize("text, n", [("[]", 0), ("", 0), (" [ ] ", 0), ("[1]", 1), ('[{"id": "1"}, {"id": "2"}]', 2), ("﻿[{}]", 1)])
def test_small_arrays(spark, tmp_path, text, n):
    path, size = written(tmp_path / "a.json", text)
    assert json_arrays.read_elements(spark, [(path, size)], 3).count() == n


def test_what_is_no_array(spark, tmp_path):
    path, size = written(tmp_path / "o.json", '{"id": [1, 2]}')
    with pytest.raises(Exception, match="no JSON array"):
        json_arrays.read_elements(spark, [(path, size)], 5).count()
    with pytest.raises(FileNotFoundError):
        files.read_dialog_json(spark, str(tmp_path / "none*.json"))
    assert json_arrays.read_elements(spark, []).count() == 0

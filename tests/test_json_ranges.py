"""JSON arrays in ranges: any place of the cuts gives the records of the standard parser."""

import json
import random

import pytest

from auditframe.errors import RefusedError
from auditframe.sources.json_ranges import Structure
from auditframe.sources.scans import read_json


def random_records(seed, n):
    draw = random.Random(seed)
    texts = ["", "plain", 'q"q', "a,b", "[1,2", "}]", '\\"', "\\", 'end\\\\"', "two\nlines", "é,ü", '{"a":1}', "x" * 200]
    return [{"id": i, "name": draw.choice(texts) + draw.choice(texts), "in": {"a,[": draw.choice(texts), "n": draw.choice([None, 1.5, 2])}} for i in range(n)]


def expected(records):
    return sorted((r["id"], r["in"]["a,["], r["in"]["n"], r["name"]) for r in records)


def found(df):
    assert sorted(df.columns) == ["id", "in.a,[", "in.n", "name"]
    return sorted(tuple(r) for r in df.select("id", "`in.a,[`", "`in.n`", "name").collect())


@pytest.mark.parametrize("range_bytes, indent", [(37, None), (120, 1), (1 << 20, 1)])
def test_arrays_and_wrapped_arrays(spark, tmp_path, range_bytes, indent):
    records = random_records(range_bytes, 12)
    path = tmp_path / "x.json"
    for payload, key in ((records, None), ({"n": [], "note": "a,[{", "deep": {"records": [1]}, "records": records, "z": {"k": [2]}}, None), ({"other": [1, 2], "records": records, "last": [3]}, "records")):
        path.write_text(json.dumps(payload, indent=indent))
        assert found(read_json(spark, str(path), key, range_bytes)) == expected(records)


def test_many_tasks_and_many_files(spark, tmp_path):
    records = random_records(5, 600)
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps(records[i * 200 : (i + 1) * 200], ensure_ascii=bool(i)))
    assert found(read_json(spark, str(folder), range_bytes=5_000)) == expected(records)


def test_scalars_in_ranges(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps(list(range(100))))
    assert sorted(r[0] for r in read_json(spark, str(path), range_bytes=50).collect()) == list(range(100))
    path.write_text(json.dumps({"v": ["a,b", 'c"', "]"] * 5, "w": 1}))
    assert sorted(r[0] for r in read_json(spark, str(path), range_bytes=16).collect()) == sorted(["a,b", 'c"', "]"] * 5)


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '{"a": [{"b": 1}]', '[{"a": "x}]', '[{"a": 1},, {"a": 2}]', '[{"a": 1} {"a": 2}]', '{"a" [1]}', "{}", '[{"a": 1}, null]'])
@pytest.mark.parametrize("range_bytes", [7, 1000])
def test_broken_text_is_refused(spark, tmp_path, text, range_bytes):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "x.json"), range_bytes=range_bytes).collect()


def test_a_key_of_an_empty_array_in_one_of_two_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r": [], "k": 1}')
    (tmp_path / "b.json").write_text('{"k": 1, "r": [{"x": 1}, {"x": 2}]}')
    assert sorted(r[0] for r in read_json(spark, str(tmp_path)).collect()) == [1, 2]
    with pytest.raises(RefusedError, match="multiple record arrays"):
        (tmp_path / "c.json").write_text('{"s": [{"x": 1}], "r": [{"x": 3}]}')
        read_json(spark, str(tmp_path))


def test_state_functions_compose():
    draw = random.Random(2)
    text = json.dumps(random_records(9, 30)).encode()
    cuts = sorted(draw.sample([i + 1 for i, c in enumerate(text) if c == 44], 12))
    in_string, depth = False, 0
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        part = Structure(text[a:b])
        in_string, depth = in_string != part.flips, depth + part.change(in_string)
        whole = Structure(text[:b])
        assert (in_string, depth) == (whole.flips, whole.change(False))
    assert (in_string, depth) == (False, 0)

"""Dumps: every layout and every place where a chunk may end."""

import gzip
import json
import random

from orrery.sources import dump

DOCS = [{"id64": 1, "name": "a\\ \" } { [ ü"}, {"id64": 2, "bodies": [{"n": 1}, [], {}, "x"], "s": {"t": None}}, {}, {"k": "\n\t", "v": [1, -2.5e3, True]}]


def split(text, size):
    raw = text.encode()
    return [d for d in map(parsed, dump.split_documents(raw[i : i + size] for i in range(0, len(raw), size))) if d is not None]


def parsed(raw):
    try:
        return json.loads(raw)
    except json.JSONDecodeError:  # as from_json does with what has the right brackets only
        return None


def test_layouts_and_chunks():
    compact, pretty = [json.dumps(d) for d in DOCS], [json.dumps(d, indent=1, ensure_ascii=False) for d in DOCS]
    for text in ("".join(compact), "\n".join(pretty), "[" + ",\n".join(compact) + "]", " ".join(pretty) + " ", "[\n" + ",".join(pretty) + "\n]\n"):
        for size in (1, 2, 3, 7, 64, 1 << 20):
            assert split(text, size) == DOCS


def test_broken_documents():
    good = [{"id64": i, "bodies": [{"id64": 7, "name": "b"}]} for i in range(4)]
    line = [json.dumps(d) for d in good]
    for broken in ('{"id64": 9, "name": "cut', '{"id64": 9, "bodies": [{"id64": 7}', '{"id64": 9]}', '{"id64": 9 "x": 1}', '{"a": [1, 2}', "}}]", '{"id64": 9, ', '"text"', "12 null", '{"a":', '{"a": [', '{"a": {"b": 1} {"c": 2}}', '{"a": "x"y"}'):
        text = "\n".join([line[0], broken, line[1], line[2], broken, line[3], broken])
        for size in (1, 5, 1 << 20):
            assert split(text, size) == good, (broken, size)
    assert split("", 5) == [] and split('{"never": [', 5) == []


def test_broken_document_over_lines():
    pretty = [json.dumps({"id64": i, "bodies": [{"id64": 7, "name": "b"}], "z": 0}, indent=2) for i in range(3)]
    broken = pretty[1].replace('"z"', '"z" "z"').replace('"bodies": [', '"bodies": {')
    for size in (1, 9, 1 << 20):
        assert split("\n".join([pretty[0], broken, pretty[2]]), size) == [json.loads(pretty[0]), json.loads(pretty[2])]


def test_random_cuts_lose_one_document():
    assert split('{"a":\n{"b": 1}', 3) == [{"b": 1}]
    rng = random.Random(2)
    line = [json.dumps(d) for d in DOCS[:2] * 20]
    for _ in range(200):
        k = rng.randrange(len(line))
        cut = line[k][: rng.randrange(1, len(line[k]))]
        got = split("\n".join([*line[:k], cut, *line[k + 1 :]]), 50)
        want = [json.loads(x) for i, x in enumerate(line) if i != k]
        assert got == want


def test_reader(spark, tmp_path):
    every = [{"id64": i, "name": f"n{i}", "pad": "x" * (i * 37 % 500)} for i in range(600)]
    parts = [gzip.compress("\n".join(map(json.dumps, every[a : a + 100])).encode()) for a in range(0, 600, 100)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "d.json.gz").write_bytes(b"".join(parts))
    (tmp_path / "one" / "_SUCCESS").write_bytes(b"")
    for members in (False, True):
        rows = dump.scan_dump(spark, str(tmp_path / "one"), members, split_bytes=3000)
        assert [json.loads(r.json) for r in rows.orderBy("seq").collect()] == every
        assert (rows.rdd.getNumPartitions() > 1) == members
    (tmp_path / "two.json").write_text("[" + ",".join(map(json.dumps, every)) + "]")
    assert [json.loads(r.json) for r in dump.scan_dump(spark, f"file://{tmp_path}/two.json").orderBy("seq").collect()] == every
    (tmp_path / "cut.gz").write_bytes(parts[0][:-40])
    assert 0 < dump.scan_dump(spark, str(tmp_path / "cut.gz")).count() <= 100
    (tmp_path / "none").mkdir()
    assert dump.scan_dump(spark, str(tmp_path / "none")).count() == 0

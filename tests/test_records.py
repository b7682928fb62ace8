"""Records in tool results, against plain Python on the parsed value."""

import json

from caseloom.functions import records as rec


def run(spark, texts, *cols):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_where_the_json_is(spark):
    cases = {
        '[{"a": 1}]': '[{"a": 1}]', 'said {"q": 1, "p": {"r": 2}} then': '{"q": 1, "p": {"r": 2}}', "open [3, {": None, "": None, None: None,
        'note [x] {"a": "]}"} [{"id": "]", "k": 1}]': '[{"id": "]", "k": 1}]', "Out[1]: {'a': 1}": "[1]", 'x {"s": "a \\" } b"} y': '{"s": "a \\" } b"}',
        "3": "3", 'a [1, [2]] b': "[1, [2]]", "[" * 40 + "]" * 39: "[" * 39 + "]" * 39, 'lone " quote [7]': "[7]"}
    got = [r[0] for r in run(spark, list(cases), rec.json_text("t"))]
    assert [None if g is None else json.loads(g) for g in got] == [None if w is None else json.loads(w) for w in cases.values()]


def test_summaries(spark):
    many = [{f"c{i}": 0} for i in range(40)]
    texts = ['[{"order_id": 7}, {"order_id": 8, "z": 0}, {"order_id": 9}]', '[{"b": 1}, {"id": "x", "c_id": 2}, {"id": null}]', json.dumps(many),
             '{"name": "Ann", "age": 5, "tags": ["a", "b"], "none": null, "ok": true, "long": "' + "é" * 60 + '", "z": 1}', "[4, 5]", "[]", '[{"a": 1}, 2]', '"text"', None, "{}"]
    got = [None if r[0] is None else (r[0]["count"], r[0]["id_field"], r[0]["first_ids"], r[0]["keys"], r[0]["values"]) for r in run(spark, texts, rec.record_summary("t", 2).alias("s"))]
    assert got[:3] == [(3, "order_id", ["7", "8"], ["order_id", "z"], None), (3, "c_id", [None, "2"], ["b", "c_id", "id"], None),
                       (40, None, None, sorted(f"c{i}" for i in range(40)), None)]
    assert got[3] == (1, None, None, ["age", "long", "name", "none", "ok", "tags", "z"],
                      {"age": "5", "long": "é" * 40, "name": "Ann", "none": None, "ok": "true", "tags": '["a","b"]'})
    assert got[4:9] == [None] * 5 and got[9] == (1, None, None, [], {})


def test_documentation(spark):
    doc = {"parameters": [{"name": "q", "required": True}, {"name": "page", "required": False}, 5, {"name": "size"}]}
    texts = [json.dumps(doc), 'Output: {"parameters": {}} end', f"arrays go first: {json.dumps(doc)}", '{"parameters": []}', '{"x": 1}', "plain", None, '[{"parameters": []}]']
    assert [r[0] for r in run(spark, texts, rec.signature("t"))] == ["(q, page?, size?)", None, None, "()"] + [None] * 4
    texts = ['[{"name": "login", "d": 1}, {"d": 2}, {"name": "show_songs"}]', 'broken [{"name": "a_b", "name":  "c"', '{"name": "one"}', None, "[3]"]
    assert [r[0] for r in run(spark, texts, rec.listed_names("t"))] == [["login", "show_songs"], ["a_b", "c"], [], [], []]

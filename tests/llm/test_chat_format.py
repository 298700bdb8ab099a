"""Chat formatting: layouts, escapes, round trips."""

import hashlib
import json
import random
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from stratasearch.llm import chat_format

TURNS = "conv_id long, turn long, role string, text string"


@given(st.lists(st.tuples(st.text(max_size=20), st.text(alphabet="ab\\#<>/turn: \n", max_size=40)), max_size=5))
def test_round_trip(turns):
    formatted = "".join(chat_format.format_turn(role, text) for role, text in turns)
    assert [(role, text) for role, text, _, _ in chat_format.parse_turns(formatted)] == turns


def test_cuts_fall_beside_escapes(monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", 2)
    for text in ("\\\\\\#<", "a\\", "\\\\", "<<##\\<\\", "</turn>\n"):
        test_round_trip.hypothesis.inner_test([("a:b\\", text), (text, "x")])


def test_no_turn():
    with pytest.raises(ValueError):
        list(chat_format.parse_turns("### user: x"))


@pytest.mark.parametrize(
    "record,turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"output": "b", "instruction": "a", "input": "c"}, [("user", "a"), ("user", "c"), ("assistant", "b")]),
        ({"something": "else"}, None),
    ],
)
def test_layouts(record, turns):
    assert chat_format.record_turns(json.dumps(record))[1] == turns


def test_new_layout(spark):
    chat_format.register(chat_format.Layout("q and a", ("ask", "reply.body"), fixed=(("user", "ask"),)))
    rows = [(1, '{"ask": "a", "reply": {"body": "b"}}'), (2, "not json"), (3, None), (4, '{"odd": 1}'), (5, '{"prompt": "p", "response": "r"}')]
    got = chat_format.json_turns(spark.createDataFrame(rows, "id long, j string"), "id", "j").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got] == [
        (1, 0, "user", "a"), (2, None, None, None), (3, None, None, None), (4, None, None, None), (5, 0, "user", "p"), (5, 1, "assistant", "r"),
    ]
    assert got[0]["layout"] == "q and a" and got[1]["layout"] == "not JSON"


def expected(rows):
    out = {}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort()
        loss = [t for _, r, t in turns if r == "assistant"]
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
            sum(map(len, loss)),
            hashlib.sha256("".join(loss).encode()).hexdigest(),
            sum(len(chat_format.format_turn(r, t)) for _, r, t in turns),
        )
    return out


def read_back(frame):
    got = chat_format.read_back(chat_format.format_conversations(chat_format.table_turns(frame))).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_whole_table(spark, data):
    frame = spark.read.parquet(f"{data}/conversations.parquet")
    assert read_back(frame) == expected([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a </turn>\n### user: b \\"), (1, 1, "assistant", "a"), (1, None, None, "x"), (2, 0, "assistant", ""),
        (None, 0, "user", "n"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (3, 0, "a: b", "é🙂" * 20_000),
        (2**60 + 1, 2**60, "assistant", "large"), (2**60 + 3, 0, "user", "large"),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    assert read_back(frame.selectExpr("*", "1 AS segment")) == expected(rows)
    assert read_back(frame.limit(0)) == {}
    with pytest.raises(ValueError):
        chat_format.table_turns(frame.drop("role"))


def both_ways(spark, records):
    """Turns of records by built-in expressions and in Python."""
    frame = spark.createDataFrame(list(enumerate(records)), "id long, j string")
    native = {}
    for r in chat_format.json_turns(frame, "id", "j").orderBy("conv_id", "turn").collect():
        native.setdefault(r["conv_id"], (r["layout"], r["record"], []))[2].append((r["turn"], r["role"], r["text"]))
    for k, record in enumerate(records):
        layout, turns = chat_format.record_turns(record)
        rows = [(n, *t) for n, t in enumerate(turns)] if turns else [(None, None, None)]
        assert native[k][1:] == (record if turns is None else None, rows), record
        assert turns is None or native[k][0] == layout, record


def random_record(rng):
    inside, fields = ["role", "content", "from", "value", "text", "x"], {f.split("[")[0].split(".")[0] for x in chat_format.LAYOUTS.values() for f in x.fields}

    def piece(depth=0):
        kind = rng.random()
        if kind < 0.55 or depth > 2:
            return rng.choice([None, True, -2, "", "a", "[", '{"a', "<: >", "user", "human", "gpt", 1.5])
        if kind < 0.8:
            return [piece(depth + 1) for _ in range(rng.randint(0, 3))]
        return {k: piece(depth + 1) for k in rng.sample(inside, rng.randint(0, 3))}

    if rng.random() < 0.3:
        return {"messages": [{"role": piece(3), "content": piece()} for _ in range(rng.randint(0, 3))]}
    return {k: piece() for k in rng.sample([*sorted(fields), "id"], rng.randint(0, 4))}


def test_built_in_as_in_python(spark):
    rng = random.Random(3)
    both_ways(spark, [json.dumps(random_record(rng)) for _ in range(1500)])


def test_odd_records(spark):
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    nested = '{"messages":' * 900 + "[]" + "}" * 900
    odd = [deep, nested, "", "null", "[1]", "3", '"x"', '{"prompt":"\\ud800 x","response":"y"}', '{"prompt":"a","prompt":"b","response":"c"}', "{" * 100_000, '{"prompt":"a","response":"b"} x', "{'prompt':'a','response':'b'}", '{"a b: STRING, c":1}']
    both_ways(spark, odd)
    frame = spark.createDataFrame([(1, None, 2), (1, None, 2)], "id long, j string, value int")
    assert [tuple(r) for r in chat_format.json_turns(frame, "id", "j").collect()] == [(1, None, None, None, "not JSON", None)] * 2
    assert chat_format.json_turns(frame.limit(0), "id", "j").count() == 0


def test_a_record_of_many_megabytes(spark):
    text = "é x" * 7_000_000
    frame = spark.createDataFrame([(1, json.dumps({"prompt": text, "response": "b"}, ensure_ascii=False))], "id long, j string")
    got = chat_format.json_turns(frame, "id", "j").select("turn", "role", F.length("text"), "layout").collect()
    assert sorted(map(tuple, got)) == [(0, "user", len(text), "prompt and response"), (1, "assistant", 1, "prompt and response")]


def test_a_long_turn_needs_no_memory_for_each_character():
    formatted = chat_format.format_turn("user", "a\\ <#" * 400_000)
    tracemalloc.start()
    role, text, _, _ = next(chat_format.parse_turns(formatted))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == "a\\ <#" * 400_000 and peak < 10 * len(formatted)


def test_tables_in_other_layouts(spark):
    pairs = spark.createDataFrame([(1, "a", None, 7)], "id long, prompt string, response string, extra int")
    assert [tuple(r) for r in chat_format.table_turns(pairs, "id").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "")]
    lists = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")]), (2, [])], "id long, conversations array<struct<from: string, value: string>>")
    assert [tuple(r) for r in chat_format.table_turns(lists, "id").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]


@pytest.mark.parametrize(
    "record,turns",
    [
        ({"id": 7, "source": "s", "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"messages": [{"role": "user", "content": "a"}], "tools": []}, [("user", "a")]),
        ({"id": 1, "messages": []}, []),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}]}, [("user", '[{"text":"a","type":"text"}]')]),
        ({"id": 1, "system": "s", "prompt": "a", "response": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"id": 1, "system": "", "prompt": "a", "response": ""}, [("user", "a"), ("assistant", "")]),
        ({"question": "a", "answer": 0}, [("user", "a"), ("assistant", "0")]),
        ({"conv_id": 1, "turn": 0, "role": "user", "text": "a", "lang": "en"}, [("user", "a")]),
        ({"messages": [{"role": "user", "content": "a"}, "b"]}, None),
        ({"messages": "a", "id": 1}, None),
    ],
)
def test_fields_beyond_the_layout(record, turns):
    assert chat_format.record_turns(json.dumps(record))[1] == turns


def test_unknown_records_stay(spark):
    rows = [(1, '{"odd": "x"}'), (2, "not json"), (3, '{"id": 3, "prompt": "p", "response": "r"}')]
    got = chat_format.json_turns(spark.createDataFrame(rows, "id long, j string"), "id", "j").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["text"], r["record"]) for r in got] == [(1, None, rows[0][1]), (2, None, "not json"), (3, "p", None), (3, "r", None)]

import hashlib
import json
import time
import random

import pytest

from tabularium.llm import queries, tool_chat

CALLS, RESULTS = "conv string, call string, turn long, name string, arguments string, needs array<string>", "conv string, call string, turn long, content string"


def test_query_against_brute_force(spark, sf_dir):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    wanted = {}
    for (conv, turn), r in turns.items():
        user = lambda t, conv=conv: (conv, t) in turns and turns[conv, t].role == "user"
        if r.role == "user":
            level, t = 0, turn
            while user(t - 2):
                level, t = level + 1, t - 2
            answer = turns.get((conv, turn + 1))
            answer = answer if answer is not None and answer.role == "assistant" else None
            record = {"id": f"{conv}-{turn}", "name": "answer", "arguments": {"prompt": r.text, "turn": turn, "words": len(r.text.split())}, "needs": [f"{conv}-{turn - 2}"] if turn >= 2 else [], "level": level, "result": answer and answer.text}
            digest = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            wanted[f"{conv}-{turn}"] = (turn, level, answer and turn + 1, "ok" if answer else "no result", digest)
        elif r.role == "assistant" and not user(turn - 1):
            digest = hashlib.sha256(json.dumps({"id": f"{conv}-{turn - 1}", "result": r.text}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            wanted[f"{conv}-{turn - 1}"] = (None, None, turn, "no call", digest)
    got = {r.call_id: (r.turn, r.level, r.result_turn, r.status, r.record_sha256) for r in queries.op10_tool_chat(spark, sf_dir).collect()}
    assert got == wanted


@pytest.mark.parametrize("most", [tool_chat.MOST_BYTES, 60])
def test_levels_of_any_graph(spark, most):
    rng = random.Random(8)
    rows, wanted = [], {}
    for conv in "abc":
        n = {"a": 12, "b": 2, "c": 9}[conv]
        needs = {f"k{i}": [f"k{j}" for j in rng.sample(range(n), min(2, n)) if j < i or conv == "c" and rng.random() < 0.2] + ["unknown"] * (i % 2) for i in range(n)}
        rows += [(conv, c, d) for c, d in needs.items()]

        def depth(c, seen=(), needs=needs):
            if c in seen:
                return None
            below = [depth(d, (*seen, c)) for d in needs[c] if d in needs]
            return None if None in below else 1 + max(below, default=-1)

        wanted |= {(conv, c): depth(c) for c in needs}
    frame = spark.createDataFrame(rows, "conv string, call string, needs array<string>")
    assert {(r.conv, r.call): r.level for r in tool_chat.levels(frame, most).collect()} == wanted


def test_statuses(spark):
    calls = [
        ("a", "1", 0, "t", '{"x": 1.0, "b": [true, null]}', None),
        ("a", "2", 1, "t", '{"x": "no"}', ["1"]),
        ("a", "3", 2, "t", "{oops", ["2"]),
        ("a", "4", 3, "other", '{"é": 2.50}', ["5"]),
        ("a", "5", 4, "other", "[]", ["4", None]),
        ("a", "6", 6, "other", "1", []),
        ("a", "6", 5, "other", "2", []),
        ("a", "7", 7, "other", None, []),
        ("a", "8", 8, "other", '"late"', ["9"]),
        (None, "1", 0, "other", "{}", []),
        ("a", None, 0, "other", "NaN", []),
    ]
    results = [("a", "1", 1, "fine"), ("a", "6", 9, "b"), ("a", "8", 9, "second"), ("a", "8", 8, "first"), ("a", "99", 3, "lost"), (None, None, 1, "stray")]
    schema = {"t": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    got = tool_chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schema).collect()
    assert len(got) == 12
    of = {(r.conv, r.call): r for r in got}
    status = {k[1]: r.status for k, r in of.items() if k[0] == "a"}
    assert status == {"1": "ok", "2": "invalid", "3": "invalid", "4": "cycle", "5": "cycle", "6": "several calls", "7": "invalid", "8": "several results", "99": "no call", None: "no identifier"}
    assert of["a", "1"].record == '{"arguments":{"b":[true,null],"x":1},"id":"1","level":0,"name":"t","needs":[],"result":"fine"}'
    assert of["a", "2"].errors == ["$.x: not of type integer"] and of["a", "3"].level == 2
    assert json.loads(of["a", "6"].record)["arguments"] == 2
    assert json.loads(of["a", "8"].record)["result"] == "first"
    assert json.loads(of["a", "4"].record)["arguments"] == {"é": 2.5}
    assert of[None, "1"].status == "no identifier" and of[None, None].status == "no call"


def test_violations():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number", "maximum": 3}, "maxItems": 2}, "s": {"type": ["string", "null"], "pattern": "^x", "minLength": 2}, "e": {"enum": [1, "b"]}}, "additionalProperties": False}
    assert tool_chat.violations({"a": [1, 2.5], "s": None, "e": "b"}, schema) == []
    assert tool_chat.violations({"a": [4, True, 1], "s": "y", "e": 2, "z": 0}, schema) == ["$.a[0]: out of bounds", "$.a[1]: not of type number", "$.a: length 3", "$.s: length 1", "$.s: no match", "$.e: not allowed", "$.z: not expected"]


def test_odd_rows(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", None), (None, 2, "user", "hi"), (2, None, "user", "x"), (3, 0, None, "x"), (4, 5, "user", "w " * 5000), (4, 5, "user", "w " * 5000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as call", "3 as needs")
    calls, results = tool_chat.calls_of(frame)
    got = tool_chat.link(calls, results, tool_chat.TURN_SCHEMAS).collect()
    assert sorted(r.status for r in got) == ["invalid", "invalid", "no identifier", "no identifier"]
    calls, results = tool_chat.calls_of(frame.limit(0))
    assert tool_chat.link(calls, results, {}).count() == 0


def test_arguments_that_are_hard_to_read(spark):
    schema = {"t": {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "string"}}}}
    bad = ['{"a":"\\ud800"}', "[" * 3000 + "]" * 3000, '{"a":' * 3000 + "1" + "}" * 3000, "9" * 5000, '{"\\udfff":1}', "1e999"]
    good = ['{"a":"\\ud83d\\ude00"}', "[" * 50 + "]" * 50]
    rows = [("c", str(k), k, "t" if k % 2 else "u", x, None) for k, x in enumerate(bad + good)]
    got = {int(r.call): r for r in tool_chat.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), schema).collect()}
    assert len(got) == len(rows)
    for k in range(len(bad)):
        assert got[k].status == "invalid" and got[k].errors == ["$: no JSON"] and json.loads(got[k].record)["arguments"] is None
    assert "\U0001f600" in got[len(bad)].record and got[len(bad)].status == "no result"


def test_a_long_chain(spark):
    """In few rounds; with a cycle, what leads into it, and a call that needs two chains."""
    n = 3000
    rows = [("a", f"{k}", [f"{k - 1}"] if k else []) for k in range(n)] + [("a", "x", ["y"]), ("a", "y", ["x"]), ("a", "z", ["y"]), ("a", "both", ["100", "2000"]), ("a", "lost", ["100", "z"]), ("a", "after", ["both"]), ("b", "1", ["0"])]
    frame = spark.createDataFrame(rows, "conv string, call string, needs array<string>")
    got = {(r.conv, r.call): r.level for r in tool_chat.levels(frame, 5).collect()}
    assert all(got["a", str(k)] == k for k in range(n))
    assert [got["a", c] for c in ("x", "y", "z", "both", "lost", "after")] == [None, None, None, 2001, None, 2002] and got["b", "1"] == 0


def test_arguments_of_any_depth(spark):
    """Up to DEPTH they are kept, beyond it refused; no depth ends the job."""
    opened = {"list": ("[", "]"), "object": ('{"a":', "}")}
    rows = [(kind, str(d), d, "t", a * d + "1" + b * d, None) for kind, (a, b) in opened.items() for d in [*range(1, 1101), 20_000]]
    for r in tool_chat.link(spark.createDataFrame(rows, CALLS).repartition(8), spark.createDataFrame([], RESULTS), {"t": {}}).collect():
        (a, b), d = opened[r.conv], int(r.call)
        text = a * d + "1" + b * d if d <= tool_chat.DEPTH else "null"
        assert r.record.startswith(f'{{"arguments":{text},"id":"{d}"') and r.status == ("no result" if d <= tool_chat.DEPTH else "invalid")


def test_depth():
    assert [tool_chat.depth(x) for x in (1, [], {}, [[], {"a": [1]}], {"a": 1})] == [0, 1, 1, 3, 1]


def test_a_ladder_takes_one_pass(spark):
    """Each call needs the two before it, so that no chain can be jumped over."""
    n = 100_001
    rows = spark.range(n).selectExpr("'a' as conv", "cast(id as string) as call", "filter(array(cast(id - 1 as string), cast(id - 2 as string)), x -> x not like '-%') as needs")
    began = time.time()
    assert tool_chat.levels(rows).where("level = cast(call as int)").count() == n
    assert time.time() - began < 60

"""Contracts, model answers and the checks of the console's actions."""

import json

import pytest

from newsloom import contracts
from newsloom.contracts import ACTIONS, ANSWER, Contract, Field
from newsloom.operators import answers

GOOD = {"title": "storm hits city", "summary": "said", "country": "BY", "location": "Minsk", "category": "nature", "importance": "high", "tags": ["wind"]}


def problems(spark, contract, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [list(r.p) for r in rows.select("k", contract.problems("t").alias("p")).orderBy("k").collect()]


def test_one_declaration_for_schema_and_check(spark):
    inner = Contract((Field("n", "whole", False, least=2, most=9),), strict=True, some=True)
    contract = Contract((Field("a", least=2, most=4, pattern="^[a-z]*$"), Field("b", choices=("x", "y"), required=False), Field("c", "texts", False, least=1), Field("d", "object", False, inner=inner), Field("e", "flag", False), Field("u", required=False, upper=True)))
    assert contract.schema() == {
        "type": "object", "required": ["a"],
        "properties": {
            "a": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]*$"}, "b": {"type": "string", "enum": ["x", "y"]},
            "c": {"type": "array", "items": {"type": "string"}, "minItems": 1},
            "d": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 2, "maximum": 9}}, "required": [], "additionalProperties": False, "minProperties": 1},
            "e": {"type": "boolean"}, "u": {"type": "string"},
        },
    }
    told = problems(
        spark, contract,
        '{"a": "abc", "b": "x", "c": ["q"], "d": {"n": 2}, "e": false, "u": "UP", "other": 1}', '{"a": 1, "b": "z", "c": "q", "d": {"n": "2"}, "e": 0}',
        '{"a": "a", "c": [], "d": {}, "u": "Up"}', '{"a": "abcde", "c": [1], "d": {"n": 1, "m": 1, "k": 2}, "e": null}', '{"a": "ABC", "d": {"n": 10}}', "{}",
        None, '{"a": ', "[1]", '"a"', "", '{"a": "abc", "a": "abc"}', '{"a": "abc", "d": {"n": 3.5}}',
    )
    assert told == [
        [], ["a: not a text", "b: not one of the known values", "c: not a list of texts", "d.n: not a whole number", "e: not true or false"],
        ["a: at least 2 characters", "c: at least 1 entries", "d.nothing to change", "u: not in capitals"],
        ["a: at most 4 characters", "c: not a list of texts", "d.n: at least 2", "d.k: not a known field", "d.m: not a known field", "e: not true or false"],
        ["a: not of the known form", "d.n: at most 9"], ["a: missing"], ["a: missing"], ["not an object"], ["not an object"], ["not an object"], ["not an object"], ["not an object"], ["d.n: not a whole number"],
    ]


def test_the_schema_of_an_answer():
    schema = json.loads(json.dumps(ANSWER.schema()))
    assert schema["required"] == ["title", "summary", "country", "location", "category", "importance"]
    assert "war" in schema["properties"]["category"]["enum"] and "220" in schema["properties"]["summary"]["description"]
    assert all("description" in p for p in schema["properties"].values())


def response(answer, *more):
    text = answer if isinstance(answer, str) else json.dumps(answer)
    return json.dumps({"content": [*more, {"type": "text", "text": text[:5]}, {"type": "text", "text": text[5:]}]})


def test_answers_are_conserved(spark):
    """Good, cut off, mistyped, incomplete and over-full answers."""
    cases = {
        "good": response(GOOD), "more": response({**GOOD, "extra": {"x": 1}}, {"type": "thinking", "text": "hm"}), "long": response({**GOOD, "summary": "word " * 60}),
        "cut": response(json.dumps(GOOD)[:40]), "typed": response({**GOOD, "title": 7, "tags": "wind"}), "category": response({**GOOD, "category": "gossip"}),
        "missing": response({k: v for k, v in GOOD.items() if k != "country"}), "silent": json.dumps({"content": []}), "html": "<html>", "null": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "id string, response string")
    good, rejects = answers.classified(rows)
    good, rejects = {r.id: r for r in good.collect()}, {r.id: r for r in rejects.collect()}
    assert set(good) == {"good", "more", "long"} and set(good) | set(rejects) == set(cases) and len(good) + len(rejects) == len(cases)
    assert good["more"].asDict() == {"id": "more", **{f.name: GOOD.get(f.name) for f in ANSWER.fields}}
    assert len(good["long"].summary) <= 220 and good["long"].summary.endswith("word…")
    assert {i: list(r.problems) for i, r in rejects.items()} == {
        "cut": ["not an object"], "typed": ["title: not a text", "tags: not a list of texts"], "category": ["category: not one of the known values"], "missing": ["country: missing"],
        "silent": ["no text in the response"], "html": ["no text in the response"], "null": ["no text in the response"],
    }
    assert all(rejects[i].raw == cases[i] for i in rejects)


def test_verdicts_count_whole_or_not_at_all(spark):
    said = lambda *v: response({"verdicts": [{"id": i, "same": s} for i, s in v]})
    rows = [
        ("ok", ["a", "b"], said(("b", True), ("a", False))), ("twice", ["c"], said(("c", True), ("c", True))), ("strange", ["d"], said(("d", True), ("z", False))),
        ("partial", ["e", "f"], said(("e", True))), ("typed", ["g"], said(("g", "yes"))), ("nameless", ["h"], said(("", True))), ("list", ["i"], response([1])), ("none", [], said()),
    ]
    verdicts, rejects = answers.adjudicated(spark.createDataFrame(rows, "id string, pairs array<string>, response string"))
    assert {r.id: r.same for r in verdicts.collect()} == {"a": False, "b": True}
    each = "verdicts: each needs an id and true or false"
    assert {r.id: list(r.problems) for r in rejects.collect()} == {
        "twice": ["said twice: c"], "strange": ["not asked: z"], "partial": ["not answered: f"], "typed": [each], "nameless": [each], "list": ["not an object"],
    }


def test_diagnoses(spark):
    rows = spark.createDataFrame([("a", response({"summary": "s", "cause": "c", "fix": "f"})), ("b", response({"summary": "s"}))], "id string, response string")
    good, rejects = answers.diagnosed(rows)
    assert [tuple(r) for r in good.collect()] == [("a", "s", "c", "f")] and [list(r.problems) for r in rejects.collect()] == [["cause: missing", "fix: missing"]]


# a good input of each action, and bad ones with what is wrong
CALLS = {
    "listMessages": ({"status": "published"}, [({"status": "lost"}, "status: not one of the known values"), ({}, "status: missing")]),
    "loadMembers": ({"messageId": "a/1"}, [({"messageId": "a"}, "messageId: not of the known form")]),
    "loadPosts": ({"messageId": "a/1"}, [({"messageId": 1}, "messageId: not a text")]),
    "loadAudit": ({}, [({"messageId": "a"}, "messageId: not of the known form")]),
    "inspectQueue": ({"queueName": "publish"}, [({"queueName": "scrape"}, "queueName: not one of the known values")]),
    "inspectItem": ({"id": "x"}, [({"id": ""}, "id: at least 1 characters")]),
    "listItems": ({"status": "done"}, [({"status": "gone"}, "status: not one of the known values")]),
    "exportTable": ({"table": "sources"}, [({"table": "tags"}, "table: not one of the known values")]),
    "upsertRecord": ({"table": "tags", "id": "t", "delta": {}}, [
        ({"table": "tags", "id": "a,b", "delta": {}}, "id: not of the known form"), ({"table": "sources", "id": "s", "delta": {}}, "delta.nothing to change"),
        ({"table": "messages", "id": "s", "delta": {"members": []}}, "delta.members: not a known field"), ({"table": "none", "id": "s"}, "table: not one of the known values"),
        ({"table": "targets", "id": "s"}, "delta: missing"), ({"table": "targets", "id": "s", "delta": {"tags": 1}}, "delta.tags: not a text or a list of texts")]),
    "deleteRecords": ({"table": "tags", "ids": ["a"]}, [({"table": "tags", "ids": []}, "ids: at least 1 entries")]),
    "republishMessage": ({"messageId": "a/1"}, [({}, "messageId: missing")]),
    "publishPending": ({"max": 10}, [({"max": 11}, "max: at most 10"), ({"max": 0}, "max: at least 1"), ({"max": "1"}, "max: not a whole number")]),
    "retryErrors": ({"max": 5000}, [({"max": -1}, "max: at least 1")]),
    "diagnoseError": ({"id": "x"}, [({"id": None}, "id: not a text")]),
    "runStage": ({"queueName": "analyze"}, [({"queueName": "analyze", "max": True}, "max: not a whole number")]),
    "runItem": ({"id": "x"}, [([], "not an object")]),
    "editItem": ({"id": "x", "raw": {"messageId": "m"}}, [({"id": "x", "raw": "{}"}, "raw: not an object")]),
    "pauseStage": ({"queueName": "analyze", "paused": True}, [({"queueName": "analyze", "paused": "yes"}, "paused: not true or false")]),
}


def test_every_action_is_checked(spark):
    rows, want = [], []
    for name, (least, _) in ACTIONS.items():
        good, bad = CALLS.get(name, ({}, []))
        for given, wrong in [(good, None), *bad]:
            rows.append((len(rows), name, "admin", json.dumps(given)))
            want.append([wrong] if wrong else [])
        if least != "viewer":
            rows.append((len(rows), name, "editor" if least == "admin" else "viewer", "{"))
            want.append(["forbidden"])
    rows += [(len(rows), "format", "admin", "{}"), (len(rows) + 1, "overview", "guest", "{}"), (len(rows) + 2, "overview", "viewer", None)]
    want += [["unknown action"], ["forbidden"], []]
    df = spark.createDataFrame(rows, "k long, action string, role string, input string")
    got = [list(r.p) for r in df.select("k", contracts.call_problems("action", "role", "input").alias("p")).orderBy("k").collect()]
    assert got == want and set(CALLS) <= set(ACTIONS) and len(ACTIONS) == 30


@pytest.mark.parametrize("stage, raw, wrong", [
    ("publish", '{"messageId": "m"}', []), ("publish", "{}", ["messageId: missing"]), ("other", "{}", ["no such stage"]),
    ("analyze", '{"id": "a/1", "body": "b", "date": "2024-01-01", "kind": "post"}', []), ("analyze", '{"id": "a", "body": 1, "date": "x", "kind": "post"}', ["id: not of the known form", "body: not a text", "date: not of the known form"]),
    ("aggregate", '{"id": "a/1", "body": "b", "date": "", "kind": "post", "title": "t", "summary": "s", "country": "by", "location": "", "importance": "high"}', ["country: not in capitals"]),
])
def test_payloads_of_the_stages(spark, stage, raw, wrong):
    (row,) = spark.createDataFrame([(stage, raw)], "s string, r string").select(contracts.payload_problems("s", "r").alias("p")).collect()
    assert list(row.p) == wrong

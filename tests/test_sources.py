import json

import pytest
from pyspark.sql import functions as F

from convlytics.sources import ledgers
from convlytics.sources import requests as rq

USAGE = {"input_tokens": 1, "output_tokens": 2}


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_costs_drop_bad_lines_and_read_legacy_providers(spark, tmp_path):
    good = {"schema_version": 1, "provider": "open_ai", "model": "m", "usage": USAGE}
    path = write(tmp_path / "c.jsonl", [good, "{broken", {**good, "provider": {"other": "x"}}, {"schema_version": 1, "model": "m", "usage": USAGE}, {**good, "provider": "anthropic", "observed_billing_usd": 0.5}])
    rows = ledgers.read_costs(spark, path).orderBy("seq").collect()
    assert [r.provider for r in rows] == ["openai", "x", "anthropic"]
    assert rows[2].observed_billing_usd == 0.5 and rows[0].usage.total_tokens is None
    assert ledgers.read_costs(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_order_follows_files_and_lines(spark, tmp_path):
    def row(i):
        return {"schema_version": 1, "provider": "anthropic", "model": str(i), "usage": USAGE}

    write(tmp_path / "ledger.jsonl.1", [row(i) for i in range(100)])
    write(tmp_path / "ledger.jsonl", [row(i) for i in range(100, 400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ledgers.read_costs(spark, str(tmp_path / "ledger.jsonl*")).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [int(r.model) for r in rows] == list(range(400))
    assert len({r.seq for r in rows}) == 400


def test_transcripts_strict_and_lenient(spark, tmp_path):
    good = {"schema_version": 2, "timestamp": "1", "session_id": "s", "role": "user", "content": "x", "receipts": [{"signal": "terminal", "schema_version": 1, "state": "done"}]}
    path = write(tmp_path / "t.jsonl", [good, "nope"])
    rows = ledgers.read_transcripts(spark, path, strict=False).collect()
    assert len(rows) == 1 and rows[0].lint == [] and rows[0].receipts[0].state == "done" and rows[0].session_turn is None
    with pytest.raises(Exception):
        ledgers.read_transcripts(spark, path).collect()
    missing = write(tmp_path / "m.jsonl", [good, {**good, "role": None}])
    with pytest.raises(Exception):
        ledgers.read_transcripts(spark, missing).collect()


def test_health_labels_and_served(spark, tmp_path):
    path = write(tmp_path / "h.jsonl", [{"schema_version": 1, "provider": "anthropic", "model": "m", "text_responses": 3}])
    row = ledgers.read_health(spark, path).first()
    assert row.text_responses == 3 and row.table_runs == 0
    labels = tmp_path / "l.json"
    labels.write_text(json.dumps([{"session_id": "s", "completed": False}, {"session_id": "s", "completed": True, "correct": False}, {"session_id": "t"}]))
    got = {r.session_id: (r.completed, r.correct) for r in ledgers.read_labels(spark, str(labels)).collect()}
    assert got == {"s": (True, False), "t": (None, None)}
    served = write(tmp_path / "s.jsonl", [{"digest": "a" * 64, "served_at_secs": 5}, {"digest": "zz", "served_at_secs": 5}, "x"])
    assert ledgers.read_served(spark, served).count() == 1


def test_eval_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "a", "prompt": "p", "required_terms": ["x"], "expected_structure": "e"}]}))
    assert ledgers.read_eval_cases(spark, str(tmp_path / "cases.json")).first().case_id == "a"
    (tmp_path / "corpus.json").write_text(json.dumps({"corpus_version": "v1", "tasks": [{"id": "a", "prompt": "p"}, {"id": "b", "prompt": "q"}]}))
    assert ledgers.read_eval_corpus(spark, str(tmp_path / "corpus.json")).count() == 2


def test_append_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "anthropic", "m", (1, 2))], "schema_version int, provider string, model string, usage struct<input_tokens:bigint,output_tokens:bigint>")
    ledgers.append_ledger(df, path)
    ledgers.append_ledger(df, path)
    assert ledgers.read_costs(spark, path).count() == 2
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).json(path)
    ledgers.append_ledger(stream, str(tmp_path / "copy")).awaitTermination()
    assert spark.read.json(str(tmp_path / "copy")).count() == 2


@pytest.mark.parametrize("appends", [3, 5])
def test_appends_keep_their_order(spark, tmp_path, appends):
    schema = "schema_version int, provider string, model string, usage struct<input_tokens:bigint,output_tokens:bigint>"
    path = str(tmp_path / "ledger")
    for batch in range(appends):
        rows = [(1, "anthropic", str(batch * 10 + i), (1, 2)) for i in range(10)]
        ledgers.append_ledger(spark.createDataFrame(rows, schema).repartitionByRange(3, "model"), path)
    read = ledgers.read_costs(spark, path).orderBy("seq").collect()
    assert [int(r.model) for r in read] == list(range(10 * appends))


def test_files_of_others_go_by_time_and_name(spark, tmp_path):
    import os

    for name, when, model in (("a.jsonl", 300, "3"), ("b.jsonl", 100, "1"), ("c.jsonl", 200, "2"), ("d.jsonl", 300, "4")):
        path = write(tmp_path / name, [{"schema_version": 1, "provider": "anthropic", "model": model, "usage": USAGE}])
        os.utime(path, (when, when))
    rows = ledgers.read_costs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.model for r in rows] == ["1", "2", "3", "4"]


def requests(spark, items):
    rows = [(i, p, x if isinstance(x, str) else json.dumps(x)) for i, (p, x) in enumerate(items)]
    return spark.createDataFrame(rows, "request_id bigint, provider string, payload string")


def test_messages_of_both_protocols(spark):
    df = requests(spark, [
        ("openai", {"messages": [{"role": "user", "content": "[\"x\"]"}, {"role": "assistant", "content": None}]}),
        ("anthropic", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}]}),
        ("openai", "not json"),
        ("openai", {"nothing": 1}),
    ])
    rows = rq.explode_messages(df).orderBy("request_id", "pos").collect()
    assert [(r.role, r.text, r.is_plain_text) for r in rows] == [("user", '["x"]', True), ("assistant", None, False), ("user", "a\nb", False)]


def test_tool_events(spark):
    call = {"id": "c1", "function": {"name": "Edit", "arguments": '{"Path":"Src/A b","n":[1,true,null]}'}}
    nameless = {"id": "c9", "function": {"arguments": "{}"}}
    df = requests(spark, [("openai", {"messages": [
        {"role": "assistant", "tool_calls": [nameless, call]},
        {"role": "tool", "content": '{"success":false}'},
        {"role": "tool", "content": '{"error":null}', "tool_call_id": "c1"},
        {"role": "tool", "content": "plain", "tool_call_id": "zz"},
    ]}), ("anthropic", {"messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": "u", "name": "grep", "input": {}}]}, {"role": "user", "content": [{"type": "tool_result", "content": "x", "is_error": True}]}]})])
    rows = rq.tool_events(df).orderBy("request_id", "pos", "index").collect()
    made, first, second, third, use, out = rows
    assert made.kind == "call" and made.is_edit and len(made.tokens) == 8
    assert first.failed and first.call_key == made.call_key
    assert not second.failed and second.call_key == made.call_key
    assert third.call_key not in (None, made.call_key)
    assert not use.is_edit and out.failed and out.call_key == use.call_key


def test_value_tokens(spark):
    df = spark.createDataFrame([('{"k\\"q":"Hello, wörld-2","n":{"x":-1.5,"y":[true]}}',)], "j string")
    got = df.select(F.array_sort(rq.value_tokens(F.parse_json("j"))).alias("t")).first().t
    assert got == ["bool:true", "key:k q", "key:n", "key:x", "key:y", "number:-1.5", "value:2", "value:hello", "value:rld", "value:w"]


def test_cache_slots(spark):
    mark = {"cache_control": None}
    base = {"model": "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "x", **mark}], **mark}], "tools": [{"name": "t", **mark}]}
    df = requests(spark, [
        ("anthropic", {**base, "system": [{"type": "text", "text": "s"}]}),
        ("anthropic", {**base, "system": [{"type": "text", "text": "s"}, {"type": "text", **mark}]}),
        ("anthropic", {**base, "system": "plain"}),
        ("anthropic", {**base, "system": [{"type": "text", "text": "s", **mark}], "tools": []}),
        ("anthropic", base),
    ])
    rows = rq.cache_slot_audit(df).orderBy("request_id").collect()
    assert [(r.breakpoints, r.can_place) for r in rows] == [(3, True), (4, False), (3, True), (3, False), (3, False)]


def test_constraint_coverage(spark):
    text = "[m]\nbe safe"
    df = requests(spark, [
        ("openai", {"messages": [{"role": "system", "content": text}]}),
        ("openai", {"messages": [{"role": "system", "content": text + "!"}]}),
        ("anthropic", {"system": [{"type": "text", "text": text}]}),
        ("anthropic", {"system": text}),
        ("responses", {"instructions": "hello\n\n" + text}),
    ])
    got = {r.provider: (r.requests, r.covered) for r in rq.constraint_coverage(df, "[m]", "be safe").collect()}
    assert got == {"openai": (2, 1), "anthropic": (2, 1), "responses": (1, 1)}

import json
import random

from pyspark.sql import functions as F

from convlytics.operators.render import render
from convlytics.streaming import assemble
from convlytics.streaming.sink import run_available, stateful_session

SCHEMA = "stream_id bigint, chunk_seq bigint, provider string, data string, closed boolean"


def event(body):
    return "data: " + json.dumps(body, ensure_ascii=False) + "\n\n"


def delta(text):
    return event({"choices": [{"delta": {"content": text}}]})


def run(spark, tmp_path, rows, files=1):
    session = stateful_session(spark)
    df = session.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000)))
    for part in range(files):
        df.where(f"chunk_seq % {files} = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = session.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = spark.read.parquet(run_available(assemble.assemble_stream(stream), "assembled"))
    records = {r.stream_id: r for r in out.where("kind = 'record'").collect()}
    pieces = {}
    for r in assemble.render_pieces(out).orderBy("stream_id", "piece").collect():
        pieces.setdefault(r.stream_id, []).append(r.rendered)
    return records, pieces


def test_deltas_records_and_usage(spark, tmp_path):
    rows = [
        (1, 0, "openai", delta("§ Sta"), False), (1, 2, "openai", delta("ne"), False), (1, 1, "openai", delta("tus\n. do"), False),
        (1, 3, "openai", event({"usage": {"prompt_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}, "completion_tokens": 4}}) + "data: [DO", False),
        (1, 4, "openai", "NE]\n\n", True),
        (2, 0, "anthropic", event({"type": "message_start", "message": {"usage": {"input_tokens": 4, "output_tokens": 1}}}), False),
        (2, 1, "anthropic", event({"type": "content_block_delta", "index": 1, "delta": {"type": "text_delta", "text": "second"}}), False),
        (2, 2, "anthropic", event({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "- first"}}), False),
        (2, 3, "anthropic", event({"type": "content_block_delta", "index": 0, "delta": {"type": "thinking_delta", "text": "no"}}), False),
        (2, 4, "anthropic", "event: x\r\ndata: " + json.dumps({"type": "message_delta", "usage": {"output_tokens": 6}}) + "\r\n\r\n", True),
        (3, 0, "openai", delta("never closed"), False),
        (4, 0, "openai", event({"choices": [{"delta": {"content": "a"}}, {"delta": {"content": "b"}}]}) + "data: x\n\ndata: a\ndata: b\n\n", True),
        (5, 1, "openai", delta("waits for chunk 0"), True),
    ]
    records, pieces = run(spark, tmp_path, rows, files=2)
    assert set(records) == {1, 2, 4}
    assert records[1].text == "§ Status\n. done" and pieces[1] == ["## Status\n", "**Done.** done"]
    assert (records[1].input_tokens, records[1].output_tokens, records[1].cache_read_tokens) == (3, 4, 2)
    assert records[2].text == "- first\nsecond" and (records[2].input_tokens, records[2].output_tokens, records[2].total_tokens) == (4, 6, 5)
    assert records[4].text == ""


def test_stream_equals_batch_at_every_split(spark, tmp_path):
    rng = random.Random(8)
    parts = ["§ a\n", ". b\n", "x c\n", "- d\n", "-- e\n", "|f|1\n", "|g|2\n", "```\n", "plain *h\n", "\n", "? i", "tail"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for i in range(60)}
    rows = []
    for i, text in texts.items():
        wire = "".join(delta(text[a : a + 3]) for a in range(0, len(text), 3))
        cuts = sorted(rng.randrange(len(wire) + 1) for _ in range(5))
        chunks = [wire[a:b] for a, b in zip([0, *cuts], [*cuts, len(wire)])]
        rows += [(i, n, "openai", c, n == len(chunks) - 1) for n, c in enumerate(chunks)]
    rng.shuffle(rows)
    records, pieces = run(spark, tmp_path, rows, files=3)
    want = spark.createDataFrame(list(texts.items()), "id bigint, t string").select("id", render(F.col("t")).alias("r"))
    rendered = {r.id: r.r for r in want.collect()}
    assert {i: r.text for i, r in records.items()} == texts
    assert {i: "".join(pieces.get(i, [])) for i in texts} == rendered


def test_chunks_cut_inside_characters(spark, tmp_path):
    """Raw files of single bytes and of cuts inside records give the whole text."""
    from convlytics.sources import ledgers

    texts = {1: "é日🙂 ünd\n. döne 🙂", 2: "§ plain\n"}
    rows = []
    for i, text in texts.items():
        wire = (delta(text[:3]) + delta(text[3:])).encode().replace(b"\n\n", b"\r\n\r\n" if i == 2 else b"\n\n")
        size = 1 if i == 1 else 7
        chunks = [bytearray(wire[a : a + size]) for a in range(0, len(wire), size)]
        rows += [(i, n, "openai", c, n == len(chunks) - 1) for n, c in enumerate(chunks)]
    session = stateful_session(spark)
    frame = session.createDataFrame(rows, SCHEMA.replace("data string", "data binary")).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000)))
    for part in (1, 0):
        ledgers.append_ledger(frame.where(f"chunk_seq % 2 = {part}"), str(tmp_path / "chunks"))
    stream = ledgers.read_response_chunks(session, str(tmp_path / "chunks"), files_per_trigger=2)
    out = spark.read.parquet(run_available(assemble.assemble_stream(stream), "assembled"))
    assert {r.stream_id: r.text for r in out.where("kind = 'record'").collect()} == texts


def test_settling_holds_what_may_change():
    assert assemble.settle("|a|b\n|1", False, False) == ([], "|a|b\n|1", False)
    assert assemble.settle(". done\n\n", False, False) == ([], ". done\n\n", False)
    pieces, rest, _ = assemble.settle(". done\n\nmore", False, False)
    assert pieces == [(". done\n", False, False), ("\n", False, False)] and rest == "more"
    assert assemble.settle("```\n. x\n", False, False) == ([("```\n", True, False), (". x\n", True, False)], "", True)


def test_record_lines_end_at_line_feeds_only():
    from convlytics.streaming.assemble import record_data

    for inside in (" ", "\u0085", "\x0b", "\x1c"):
        assert record_data('event: x\r\ndata: {"t":"a%sb"}\r' % inside) == '{"t":"a%sb"}' % inside
    assert record_data("data: 1\ndata: 2") is None
    assert record_data("data: 1\nother") is None

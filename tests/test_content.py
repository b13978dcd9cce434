import json
import random

import pytest
from frame_values import values
from pyspark.sql import functions as F

from convlytics.operators import content

CLASSES = [
    ("pub struct Cart {\n    total: u32,\n}\nlet cart = Cart { total: 3 };\n", "code"),
    ("make clean\ndocker ps -a\npython run.py; ls", "code"),
    ('[{"k":null},2]', "json"),
    ("would you look at it on Monday?", "text"),
    ("diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -3 +3 @@\n-five\n+six\n", "diff"),
    ("intro\n  @@ -5 +6 @@", "diff"),
    ("\x1b[1mbold\x1b[22m", "terminal"),
    ("<p>hi</p>", "text"),
    ("<br />", "text"),
    ("2031-01-02 03:04:05 DEBUG open\n2031-01-02 03:04:09 ERROR closed", "log"),
    ("[db] up\n[web] down", "log"),
    ("Warning signs are listed below", "log"),
    ("app/main.go:7: x := 1\napp/main.go:9: y := 2\n", "search-result"),
    ("todo: buy milk", "search-result"),
    ("Vec::new builds an empty list", "code"),
    ("x,y,z,w\n5,6,7,8", "tabular"),
    ("p | q\nr | s\nt | u\nlast\n", "tabular"),
    ("", "text"),
    (" \n ", "text"),
    ("{almost json", "code"),
    ("read https://host.test/x/y", "code"),
    ("https://host.test/x/y", "text"),
]


def test_classes(texts):
    got = values(content.classify_content(texts([t for t, _ in CLASSES])), "content_class")
    assert got == [c for _, c in CLASSES]


def test_log_test_is_skipped_above_200_lines(texts):
    short, long = "\n".join(["INFO x"] * 200), "\n".join(["INFO x"] * 201)
    assert values(content.classify_content(texts([short, long])), "content_class") == ["log", "text"]


NORMAL = [
    ("  so   many   gaps   \n\n\n\n   here", "so many gaps\n\n   here"),
    ("first one,   then two:  ", "first one, then two"),
    ("please close the door thank you", "close the door"),
    ("thanks to the index, it is quick", "thanks to the index, it is quick"),
    ("Thanks  for lunch", "for lunch"),
    ("list:\n    one", "list\n    one"),
    ("please read:\n    two", "read\n    two"),
    ("what a fucking mess of shit", "what a @% mess of @%"),
    ("please    say   it", "say it"),
    ("a typist pleases us", "a pist s us"),
    ("a\n \n \n b", "a\n\n  b"),
    ("a\t\tb\n, ,\nc,", "a b\n, ,\nc"),
    ("ok   now", "ok now"),
]


def test_normalisation(texts):
    got = values(content.normalize_prose(texts([t for t, _ in NORMAL])), "normalized")
    assert got == [n for _, n in NORMAL]


def test_normalisation_can_close_its_words(texts):
    df = content.normalize_prose(texts(["the type is pleased, thx"]), whole_words=True)
    assert values(df, "normalized") == ["the type is pleased"]


def test_code_is_not_touched(texts):
    code = 'fn main() {\n    let x = 1;\n    println!("hi", x);\n}'
    row = content.normalize_prose(texts([code])).first()
    assert row.normalized == code and not row.changed and row.bytes_before == row.bytes_after


def reference_collapse(s):
    out, space, newlines, start = [], False, 0, True
    for c in s:
        if c == "\n":
            newlines += 1
            if newlines <= 2:
                out.append(c)
            space = start = True
        elif c.isspace():
            if start:
                out.append(c)
            elif not space:
                out.append(" ")
                space = True
        else:
            out.append(c)
            space, newlines, start = False, 0, False
    return "".join(out)


def test_collapse_against_a_character_loop(texts):
    rng = random.Random(11)
    samples = ["".join(rng.choice("ab  \n\n\t") for _ in range(rng.randrange(25))) for _ in range(300)]
    df = texts(samples).select("id", content.collapse_whitespace(F.col("text")).alias("c"))
    assert values(df, "c") == [reference_collapse(s) for s in samples]


SECRETS = [
    ("curl -H authorization: bearer hunter2hunter2\nlast row", ["hunter2hunter2"]),
    ('[{"deep":{"api-key":"k-99-q"}},{"fine":1}]\nafter', ["k-99-q"]),
    (
        "password: 'two words here'\napi_key=zz81\nsee http://ann:pw77@host.test/a?b",
        ["two words here", "zz81", "ann:", "pw77"],
    ),
    ('{"open": token=br0ken\nplain words', ["br0ken"]),
    ("-----BEGIN EC PRIVATE KEY-----\nMIIrow1\nMIIrow2\n-----END EC PRIVATE KEY-----\nbelow the key", ["MIIrow1", "MIIrow2"]),
    ("session-id=s1 s2 s3\nproxy-authorization=\"Bearer pr0xy\"\nCookie: a=1; b=2", ["s1", "s3", "pr0xy", "b=2"]),
    ("head\n-----BEGIN PRIVATE KEY-----\nnever closed\ntail", ["never closed", "tail"]),
]


def test_no_secret_survives_and_lines_stay(texts):
    got = values(content.redact(texts([t for t, _ in SECRETS]), "text"), "redacted")
    for (raw, secrets), clean in zip(SECRETS, got):
        assert not any(s in clean for s in secrets), clean
        assert len(clean.split("\n")) == len(raw.split("\n"))
        assert content.MASK in clean
    assert got[0].endswith("\nlast row") and got[4].endswith("\nbelow the key")


def test_json_lines_are_masked_by_key_and_text(texts):
    line = json.dumps({"b": [{"Session-Id": 5}, "password=abc"], "a": 1.5, "n": None})
    got = values(content.redact(texts([line + "\nthe end", "12", "true story"]), "text"), "redacted")
    assert got[0] == '{"a":1.5,"b":[{"Session-Id":"[REDACTED]"},"password=[REDACTED]"],"n":null}\nthe end'
    assert got[1:] == ["12", "true story"]


def test_secret_counts(texts):
    df = texts(['token = "abc" and token=def\nhttps://u:p@h/', "Authorization: Bearer x", "nothing"])
    row = content.secret_counts(df, [], "text").first()
    assert (row.double_quoted, row.named, row.uri_userinfo, row.authorization, row.cookie) == (1, 1, 1, 1, 0)


def test_collapse_repeats(texts):
    got = values(content.collapse_repeats(texts(["INFO tick\nINFO tick\nINFO done", "a\nb", "", "x\nx"]), "t"), "collapsed")
    bodies = [g.split("\n", 1)[1] for g in got]
    # The last line has no newline, so it differs from the one before it.
    assert bodies == ["INFO tick\n[t:repeat:2]\nINFO done", "a\nb", "", "x\nx"]


def test_compaction(texts):
    got = values(content.compact_structured(texts(['{ "b": 1, "a": [1, 2] }', "  x  \n y"]), "t"), "compacted")
    assert got[0].split("\n")[1] == '{"a":[1,2],"b":1}'
    assert got[1].split("\n")[1:3] == ["x", "y"]


def test_tool_result_selection(spark):
    rows = [
        ("json", '{"a":1}', 100, "tool_result", False, False, "toon"),
        ("json", "plain words", 100, "tool_result", False, False, None),
        ("log", "INFO a\nINFO b", 100, "tool_result", False, False, "repeated_log"),
        ("file_read", "anything", 100, "tool_result", False, False, "file_reference"),
        ("file_read", "anything", 100, "tool_result", False, True, None),
        ("json", '{"a":1}', 100, "other", False, False, None),
        ("json", '{"a":1}', 100, "tool_result", True, False, None),
        ("json", '{"a":1}', None, "tool_result", False, False, None),
        ("json", '{"a":1}', 401, "tool_result", False, False, None),
        ("json", '{"a":1}', 99, "tool_result", False, False, None),
    ]
    df = spark.createDataFrame(
        [(i, k, bytearray(t.encode()), at, s, p, w) for i, (k, t, at, s, p, w, _) in enumerate(rows)],
        "id int, kind string, bytes binary, captured_at_secs bigint, source string, protected boolean, in_recent_window boolean",
    )
    assert values(content.select_tool_results(df, 400), "transform") == [r[-1] for r in rows]


@pytest.mark.parametrize("kind, ccr, verdict", [("S0", False, "allowed"), ("S3", False, "allowed"), ("S4", True, "allowed_with_ccr"), ("S4", False, "denied")])
def test_safety(spark, kind, ccr, verdict):
    df = spark.createDataFrame([(kind, ccr)], "safety_class string, ccr_available boolean")
    assert content.safety_verdict(df).first().verdict == verdict


def test_redaction_is_total(spark, texts):
    """Lines that only look like JSON, Unicode spellings of names and blanks, and borders of lines."""
    deep = "[" * 990 + "]" * 990
    cases = [
        ('{"a":"\\ud800","token":"abc"}', '{"a":"\\ud800","token":"[REDACTED]"}'),
        (deep, deep),
        ("[" * 127 + "]" * 127, "[" * 127 + "]" * 127),
        ("token =abcSECRET", "token =[REDACTED]"),
        ("toKen=abcSECRET", "toKen=[REDACTED]"),
        ("paſſword=abcSECRET", "paſſword=[REDACTED]"),
        ('{"note":"toKen =abc"}', '{"note":"toKen =[REDACTED]"}'),
        ('{"TOKEN":"abc"}', '{"TOKEN":"abc"}'),
        (" -----BEGIN PRIVATE KEY-----\nabc\n -----END PRIVATE KEY----- \nrest", " -----BEGIN PRIVATE KEY-----\n[REDACTED]\n -----END PRIVATE KEY----- \nrest"),
        ("x -----BEGIN PRIVATE KEY-----\nkept", "x -----BEGIN PRIVATE KEY-----\nkept"),
        ('{"token":1}\n\n{"a":[{"x-api-key":"k"}]}', '{"token":"[REDACTED]"}\n\n{"a":[{"x-api-key":"[REDACTED]"}]}'),
        (None, None),
        ("", ""),
    ]
    assert values(content.redact(texts([t for t, _ in cases]), "text"), "redacted") == [w for _, w in cases]


def test_redaction_is_linear_in_lines(spark, texts):
    import time

    def spent(n):
        frame = texts(["\n".join('{"token":"a%d"}' % i for i in range(n))])
        started = time.perf_counter()
        (got,) = values(content.redact(frame, "text"), "redacted")
        assert got.count("[REDACTED]") == n
        return time.perf_counter() - started

    spent(1000)
    assert spent(40_000) < 10 * max(1.0, spent(5_000))


def test_redaction_runs_its_input_once(texts):
    lines = texts(['{"password": "abc"}', "token=abc", None])
    assert content.redact(lines, "text")._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert values(content.redact(lines, "text"), "redacted") == ['{"password":"[REDACTED]"}', "token=[REDACTED]", None]

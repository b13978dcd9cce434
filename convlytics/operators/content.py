"""Classify, clean, redact and compact text in bulk."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.functions import text as tx
from convlytics.plans.once import evaluate_once
from convlytics.plans.packaging import ship_package

# --------------------------------------------------------------------- classification

# The words that open a log line, a code line and a command line.
LOG_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "PANIC"]
CODE_KEYWORDS = [
    "fn", "pub", "import", "def", "class", "function", "return", "const", "let", "var", "public",
    "private", "static", "void", "struct", "enum", "impl", "trait", "match", "async", "await",
    "package", "fun", "end", "then", "if", "else", "for", "while",
]
COMMANDS = [
    "sudo", "git", "npm", "pnpm", "yarn", "brew", "cd", "ls", "cat", "rg", "grep", "python",
    "node", "curl", "gh", "export", "pip", "cargo", "rustc", "make", "docker", "kubectl",
]
ACTION_SENSITIVE = ["code", "diff", "terminal", "json"]

_LOG_TIME = r"(?s)^.{4}-.{2}-.{2} .{2}:"
_SEARCH = rf"\A[{tx.ALNUM}./\-_~]++:++[0-9]*+(?:[:{tx.WS}]|\z)"
_CODE_SYMBOLS = ["=>", "::", "->", ";", "{", "}"]
_CODE_OPENING = rf"\A(?:{'|'.join(CODE_KEYWORDS + COMMANDS)})(?:[{tx.WS}]|\z)"


def _log_line(line: Column) -> Column:
    """A level word, an ISO time or a bracketed tag opens the line."""
    level = tx.starts_with_any(F.upper(F.substring(line, 1, 5)), LOG_LEVELS)
    dated = (
        (F.substring(line, 5, 1) == "-")
        & (F.octet_length(line) >= 19)
        & F.substring(line, 1, 14).rlike(_LOG_TIME)
    )
    return level | dated | (line.startswith("[") & line.contains("]"))


def _search_line(line: Column) -> Column:
    return (
        line.contains(":")
        & (F.octet_length(line) <= 300)
        & ~line.startswith("http")
        & line.rlike(_SEARCH)
    )


def _code_line(line: Column) -> Column:
    # The longest opening word has eight letters, so its end shows in twelve.
    return (
        tx.contains_any(line, _CODE_SYMBOLS)
        | line.startswith("```")
        | (line.contains("/") & ~line.startswith("http"))
        | F.substring(line, 1, 12).rlike(_CODE_OPENING)
    )


def _commas(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(","), F.lit("")))


def content_class(text: Column) -> Column:
    """One of terminal, text, json, diff, log, search-result, tabular, code."""

    def by_lines(raw: Column, ls: Column) -> Column:
        total = F.size(ls)

        def share(test) -> Column:
            return F.size(F.filter(ls, test)) / total

        diff = F.exists(ls, lambda l: l.startswith("@@ ")) | F.exists(
            raw, lambda l: l.startswith("+++ ") | l.startswith("--- ")
        )
        return (
            F.when(F.get(raw, F.lit(0)).startswith("diff --git") | diff, "diff")
            .when((total <= 200) & (share(_log_line) > 0.5), "log")
            .when(share(_search_line) > 0.5, "search-result")
            .when(
                (total >= 2)
                & ((share(lambda l: l.contains("|")) > 0.7) | (share(lambda l: _commas(l) >= 3) > 0.6)),
                "tabular",
            )
            .when(share(_code_line) > 0.4, "code")
            .otherwise("text")
        )

    def of(s: Column) -> Column:
        return (
            F.when(s.contains("\x1b"), "terminal")
            .when(s.startswith("<") & (s.contains("</") | s.contains("/>")), "text")
            .when((s.startswith("{") | s.startswith("[")) & tx.is_json(s), "json")
            .when(s == "", "text")
            .otherwise(
                tx.let(
                    tx.lines(s),
                    lambda raw: tx.let(F.transform(raw, tx.trim), lambda ls: by_lines(raw, ls)),
                )
            )
        )

    return tx.let(tx.trim(text), of)


def classify_content(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``content_class`` and whether its exact tokens carry meaning."""
    classed = evaluate_once(docs, {"content_class": content_class(F.col(text_col))})
    return classed.withColumn("action_sensitive", F.col("content_class").isin(ACTION_SENSITIVE))


def content_census(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """Documents, bytes and action-sensitive documents per group and class."""
    classed = classify_content(docs, text_col).withColumn("__b", F.octet_length(text_col))
    return classed.groupBy(*by, "content_class").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("__b").cast("bigint").alias("bytes"),
        F.count_if("action_sensitive").alias("action_sensitive_docs"),
    )


def census_shares(census: DataFrame, by: list[str]) -> DataFrame:
    """Per group: action-sensitive share of documents and number of classes."""
    return census.groupBy(*by).agg(
        F.sum("docs").alias("docs"),
        (F.sum("action_sensitive_docs") / F.sum("docs")).alias("action_sensitive_share"),
        F.count(F.lit(1)).alias("classes"),
    )


# ----------------------------------------------------------------------------- safety

# Class, byte-safe, requires recovery, reversible.
SAFETY_CLASSES = [
    ("S0", True, False, True),
    ("S1", True, False, True),
    ("S2", False, False, True),
    ("S3", False, False, False),
    ("S4", False, True, False),
]


def safety_verdict(transforms: DataFrame) -> DataFrame:
    """Add the contract of each ``safety_class`` and the verdict, given ``ccr_available``."""
    contract = transforms.sparkSession.createDataFrame(
        SAFETY_CLASSES,
        "safety_class string, byte_safe boolean, requires_ccr boolean, reversible boolean",
    )
    verdict = (
        F.when(F.col("byte_safe") | ~F.col("requires_ccr"), "allowed")
        .when(F.col("ccr_available"), "allowed_with_ccr")
        .otherwise("denied")
    )
    return transforms.join(contract, "safety_class").withColumn("verdict", verdict)


# ---------------------------------------------------------------------- normalisation

# Filler words in removal order, and the profanity pattern.
PROFANE_STEMS = ["fuck", "shit", "bitch", "damn", "piss"]
POLITE = ["please", "thanks", "thank you", "thx", "ty"]
PROFANITY = (
    r"(?iU)\b(?:fuck(?:ing|ed|er)?|shit(?:ty|s)?|bitch(?:es|ing)?|damn(?:ed|it)?|piss(?:ed|ing)?)\b"
)


def collapse_whitespace(text: Column) -> Column:
    """One space inside a line, indentation kept, at most two newlines in a run."""
    # A single plain space needs no change, so only other runs are matched.
    odd = rf"[{tx.HSPACE}&&[^ ]]"
    run = rf"(?: {tx.HSPACE}++|{odd}{tx.HSPACE}*+)"
    inner = F.when(
        text.contains("  ") | text.rlike(odd),
        F.regexp_replace(text, rf"(?<=[^{tx.WS}]){run}", " "),
    ).otherwise(text)
    extra_newline = rf"(?:(?!\A)\G({tx.HSPACE}*+)|(\n{tx.HSPACE}*+\n{tx.HSPACE}*+))\n"
    return F.regexp_replace(inner, extra_newline, "$1$2")


def strip_politeness(text: Column, whole_words: bool = False) -> Column:
    """Remove filler words.

    The patterns are open at the end, so longer words lose a matching prefix;
    ``whole_words`` closes them.
    """
    close = r"\b" if whole_words else ""
    out = text
    for word in POLITE:
        keep = r"(?!(?-i:to ))" if word == "thanks" else ""
        out = F.regexp_replace(out, rf"(?iU)\b{word}{close}\s*+{keep}", "")
    return F.when(tx.let(tx.fold_case(text), lambda low: tx.contains_any(low, POLITE)), out).otherwise(
        text
    )


def replace_profanity(text: Column) -> Column:
    found = tx.let(tx.fold_case(text), lambda low: tx.contains_any(low, PROFANE_STEMS))
    return F.when(found, F.regexp_replace(text, PROFANITY, "@%")).otherwise(text)


def _trim_line_edges(text: Column) -> Column:
    def edge(line: Column) -> Column:
        return F.coalesce(F.nullif(F.rtrim(line, F.lit(";:, \t")), F.lit("")), line)

    return F.array_join(F.transform(tx.lines(text), lambda l: tx.let(tx.trim_end(l), edge)), "\n")


def normalize_text(
    text: Column, politeness: bool = True, profanity: bool = True, whole_words: bool = False
) -> Column:
    """Clean prose; callers check the class first."""
    out = tx.let(text, collapse_whitespace)
    if politeness:
        # Only removing a word can leave blanks to collapse again.
        out = tx.let(
            out,
            lambda t: tx.let(
                strip_politeness(t, whole_words),
                lambda s: F.when(s != t, collapse_whitespace(s)).otherwise(s),
            ),
        )
    if profanity:
        out = tx.let(out, replace_profanity)
    return tx.trim(tx.let(out, _trim_line_edges))


def normalize_prose(docs: DataFrame, text_col: str = "text", **options: bool) -> DataFrame:
    """Add ``normalized``, byte counts and ``changed``; only prose is touched."""
    cleaned = F.when(
        content_class(F.col(text_col)) == "text", normalize_text(F.col(text_col), **options)
    ).otherwise(F.col(text_col))
    out = evaluate_once(docs, {"normalized": cleaned})
    return out.select(
        "*",
        F.octet_length(text_col).alias("bytes_before"),
        F.octet_length("normalized").alias("bytes_after"),
        (F.col("normalized") != F.col(text_col)).alias("changed"),
    )


def normalization_savings(normalized: DataFrame, by: list[str]) -> DataFrame:
    return normalized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if("changed").alias("changed_docs"),
        F.sum(F.greatest(F.col("bytes_before") - F.col("bytes_after"), F.lit(0)))
        .cast("bigint")
        .alias("saved_bytes"),
    )


# -------------------------------------------------------------------------- redaction

# Key names whose JSON values are secret, and the line patterns by kind, in
# the order they apply.  Each pattern captures what is kept before the secret.
SECRET_KEYS = [
    "authorization", "proxy_authorization", "x_api_key", "api_key", "access_token", "token",
    "password", "secret", "cookie", "set_cookie", "session", "session_id", "session_token",
]
_NAMES = r"(?:x-api-key|api[_-]?key|access[_-]?token|token|password|secret)"
REDACTIONS = [
    ("authorization", r"""(?iU)((?:["']?(?:proxy-)?authorization["']?\s*[:=]\s*["']?)(?:bearer\s+)?)[^\s,;"'}]+""", ""),
    ("cookie", r"""(?iU)((?:["']?(?:set-cookie|cookie|session(?:[_-]?(?:id|token))?)["']?\s*[:=]\s*["']?))[^"'\r\n]+""", ""),
    ("double_quoted", rf"""(?iU)("?{_NAMES}"?\s*[:=]\s*")[^"\r\n]*\"""", '"'),
    ("single_quoted", rf"""(?iU)('?{_NAMES}'?\s*[:=]\s*')[^'\r\n]*'""", "'"),
    ("named", rf"""(?iU)((?:["']?{_NAMES}["']?\s*[:=]\s*["']?))[^\s,;&"'}}]+""", ""),
    ("uri_userinfo", r"(?iU)\b(https?://)[^/\s@]+@", "@"),
]
MASK = "[REDACTED]"
_PEM_LABEL = rf"(?:[A-Z0-9 ]+ )?PRIVATE KEY-----{tx.HSPACE}*+"
_PEM_BEGIN = rf"{tx.HSPACE}*+-----BEGIN {_PEM_LABEL}"
_PEM_END = rf"{tx.HSPACE}*+-----END {_PEM_LABEL}"
# One private-key block (to its END line or the end of the text), or one other line.
_PEM_OR_LINE = (
    rf"(?d){_PEM_BEGIN}(?:\n|\z)(?s:.*?)(?:(?<=\n){_PEM_END}(?=\n|\z)|\z)\n?+"
    r"|[^\n]*+\n|[^\n]++"
)


# Every pattern needs one of these substrings; most lines hold none and skip them all.
_SECRET_HINTS = ["authorization", "cookie", "session", "api", "token", "password", "secret", "://"]


def _may_hold_secret(text: Column) -> Column:
    return tx.let(tx.fold_case(text), lambda low: tx.contains_any(low, _SECRET_HINTS))


def _mask_line(line: Column) -> Column:
    masked = line
    for _, pattern, tail in REDACTIONS:
        masked = F.regexp_replace(masked, pattern, "$1" + MASK + tail)
    return F.when(_may_hold_secret(line), masked).otherwise(line)


# The same patterns for strings inside JSON; white space is Unicode's, as in the columns.
_PY_REDACTIONS = [
    (re.compile(p.replace("(?iU)", "(?i)").replace(r"[^\s", f"[^{tx.WS_CHARS}").replace(r"/\s@", f"/{tx.WS_CHARS}@").replace(r"\s", f"[{tx.WS_CHARS}]")), rf"\g<1>{MASK}{t}")
    for _, p, t in REDACTIONS
]
_ASCII_LOWER = str.maketrans(tx.ASCII_UPPER + "-", tx.ASCII_UPPER.lower() + "_")
# Fixed value: JSON nested deeper than this is not taken as JSON.
_MOST_DEPTH = 127


def _depth(line: str) -> int:
    """How deep brackets nest outside of strings."""
    deepest = depth = 0
    for bracket in re.sub(r'"(?:[^"\\]|\\.)*"', "", line):
        if bracket in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif bracket in "]}":
            depth -= 1
    return deepest


def _mask_json(value):
    """Mask secret keys and the strings of one parsed JSON value."""
    if isinstance(value, dict):
        return {k: MASK if k.translate(_ASCII_LOWER) in SECRET_KEYS else _mask_json(v) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [_mask_json(v) for v in value]
    if isinstance(value, str):
        for pattern, replacement in _PY_REDACTIONS:
            value = pattern.sub(replacement, value)
    return value


def _mask_json_text(line: str | None) -> str | None:
    """The masked line; None for what is no JSON: nested too deep, or with half of a surrogate pair."""
    if line is None or (line.count("[") + line.count("{") > _MOST_DEPTH and _depth(line) > _MOST_DEPTH):
        return None
    try:
        masked = json.dumps(_mask_json(json.loads(line)), ensure_ascii=False, separators=(",", ":"))
        masked.encode()
    except ValueError:  # a UnicodeEncodeError too
        return None
    return masked


def redact(df: DataFrame, text_col: str = "content", out: str = "redacted") -> DataFrame:
    """Add ``out``: the text without recognised secrets; the number of lines is kept.

    Only texts with a line that may be JSON pass through Python (of others a NULL), which walks
    values of any shape; a line that turns out to be none is masked like any other.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def mask_json_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda found: None if found is None else [_mask_json_text(line) for line in found])

    opens = r'[ \t\r]*(?:[{\["]|-?[0-9]|(?:true|false|null)\s*$)'

    def looks_json(line: Column) -> Column:
        return line.rlike(f"^{opens}") & tx.is_json(line)

    def mask_block(block: Column) -> Column:
        """Mask the body of a private-key block: every line but its BEGIN and END."""
        edge = rf"\A(?:{_PEM_BEGIN}|{_PEM_END})\z"
        return F.array_join(F.transform(tx.lines(block), lambda l: F.when(l.rlike(edge), l).otherwise(MASK)), "\n")

    def plain(part: Column) -> Column:
        return F.when(part.rlike(rf"\A{_PEM_BEGIN}(?:\n|\z)"), mask_block(part)).otherwise(_mask_line(part))

    text = F.col(text_col)
    parts = F.regexp_extract_all(F.regexp_replace(text, "\r\n", "\n"), F.lit(_PEM_OR_LINE), F.lit(0))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"\n\z", ""))
    walks = F.coalesce(text.rlike(f"(?md)^{opens}"), F.lit(False))

    # One pass: two branches by ``walks`` would run the whole input twice.
    staged = evaluate_once(df, {"__parts": parts, "__walks": walks})
    found = F.when(F.col("__walks"), F.transform("__parts", lambda p: F.when(looks_json(p), p)))
    staged = staged.withColumn("__masked", mask_json_lines(found))
    result = F.array_join(F.transform("__parts", lambda p, i: F.coalesce(F.get("__masked", i), plain(p))), "\n")
    kept = [c for c in df.columns if c != out]
    return evaluate_once(staged, {out: result}).select(*kept, out)


def _on_mask(pattern: str) -> str:
    """The same pattern, restricted to values that are already masked."""
    kept, closing = pattern.rfind("[^"), pattern.rfind("]") + 2
    return pattern[:kept] + re.escape(MASK) + pattern[closing:]


def secret_counts(df: DataFrame, by: list[str], text_col: str = "content") -> DataFrame:
    """How many secrets of each kind the raw text of each group holds."""
    counts = []
    rest = F.col(text_col)
    for kind, pattern, tail in REDACTIONS:
        # A value that an earlier kind has masked is not a second secret.
        masked = F.regexp_count(rest, F.lit(_on_mask(pattern)))
        counts.append((F.regexp_count(rest, F.lit(pattern)) - masked).alias(kind))
        rest = F.regexp_replace(rest, pattern, "$1" + MASK + tail)
    hinted = F.when(_may_hold_secret(F.col(text_col)), F.struct(*counts))
    keys = F.when(
        F.contains(text_col, F.lit("PRIVATE KEY")),
        F.regexp_count(F.col(text_col), F.lit(rf"(?md)^{_PEM_BEGIN}$")),
    )
    counted = evaluate_once(df, {"__c": hinted, "__keys": keys})
    kinds = [kind for kind, _, _ in REDACTIONS]
    return counted.groupBy(*by).agg(
        *[F.coalesce(F.sum(f"__c.{k}"), F.lit(0)).alias(k) for k in kinds],
        F.coalesce(F.sum("__keys"), F.lit(0)).alias("private_key"),
    )


# ------------------------------------------------------------- tool-result compaction

def select_tool_results(results: DataFrame, now: Column | int, max_age: int = 300) -> DataFrame:
    """Add ``transform``: toon, repeated_log, file_reference, or NULL when none may apply.

    Columns: ``bytes, source, kind, captured_at_secs, protected, in_recent_window``.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    at = F.col("captured_at_secs")
    fresh = (at <= now) & (now - at <= max_age)
    eligible = (F.col("source") == "tool_result") & ~F.col("protected") & fresh
    kind = F.col("kind")
    declared = F.when(kind.isin("json", "tabular", "log"), kind)
    agreed = declared == content_class(F.col("bytes").cast("string"))
    transform = F.when(
        eligible & F.is_valid_utf8(F.col("bytes").cast("string")),
        F.when(kind.isin("json", "tabular") & agreed, "toon")
        .when((kind == "log") & agreed, "repeated_log")
        .when((kind == "file_read") & ~F.col("in_recent_window"), "file_reference"),
    )
    return evaluate_once(results, {"transform": transform})


def compact_structured(results: DataFrame, tag: str = "convlytics", text_col: str = "text") -> DataFrame:
    """Add ``compacted``: minified JSON with sorted keys, or trimmed lines, under a digest."""
    text = F.col(text_col)
    minified = F.when(tx.is_json(text), F.to_json(F.try_parse_json(text)))
    trimmed = F.array_join(F.transform(tx.lines(text), tx.trim), "\n")
    head = F.concat(F.lit(f"[{tag}:toon:"), F.sha2(text.cast("binary"), 256), F.lit("]\n"))
    body = F.coalesce(minified, trimmed)
    return evaluate_once(results, {"compacted": F.concat(head, body, F.lit("\n"))})


def collapse_runs(text: Column, tag: str) -> Column:
    """Run-length collapse of equal neighbouring lines, compared with their newline."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\n]*+\n|[^\n]++"), F.lit(0))

    def of(ls: Column) -> Column:
        n = F.size(ls)
        starts = F.filter(
            F.transform(
                ls,
                lambda l, i: F.when((i == 0) | (l != F.get(ls, i - 1)), i),
            ),
            lambda i: i.isNotNull(),
        )

        def render(ss: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                length = F.coalesce(F.get(ss, k + 1), n) - start
                mark = F.when(
                    length > 1, F.concat(F.lit(f"[{tag}:repeat:"), length.cast("string"), F.lit("]\n"))
                ).otherwise("")
                return F.concat(F.get(ls, start), mark)

            return F.array_join(F.transform(ss, run), "")

        return tx.let(starts, render)

    return tx.let(pieces, of)


def collapse_repeats(logs: DataFrame, tag: str = "convlytics", text_col: str = "text") -> DataFrame:
    """Add ``collapsed``: the log with each repeated line written once and counted."""
    text = F.col(text_col)
    head = F.concat(F.lit(f"[{tag}:log:"), F.sha2(text.cast("binary"), 256), F.lit("]\n"))
    return evaluate_once(logs, {"collapsed": F.concat(head, collapse_runs(text, tag))})

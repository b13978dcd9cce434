"""Decode marker lines to Markdown in bulk, and restore originals from rendered text.

A text is cut into segments by one regular expression: a fenced block, a run of table
lines, a run of dash lines, or one line.  Each segment is then rendered by itself; only
the nesting of dash lines needs a fold, and a run of dash lines always starts at depth 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.operators.health import table_is_valid
from convlytics.operators.store import put_originals
from convlytics.plans.once import evaluate_once

SEGMENTS = (
    r"```(?s:.*?)(?:\n```[^\n]*+|\z)\n?+"
    r"|\|(?s:.*?)(?:\n(?!\|)|\z)"
    r"|-(?s:.*?)(?:\n(?!-)|\z)"
    r"|[^\n]*+\n|[^\n]++"
)

# What each marker becomes.
LINE_MARKERS = {
    "§": "##", ">": ">", "!": "> **Blocking:**", "~": "> Note:",
    ".": "**Done.**", "?": "**Decision needed:**", "x": "**Blocked:**",
}
NESTED_MARKERS = {"#": "1. ", ">": "> ", "!": "> **Blocking:** ", "~": "> Note: "}
_NUMBER = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"
_INLINE = (
    rf"`[^`]*+`|`(?s:.*+)|(?<![^{tx.WS}])\*[{tx.ALNUM}][^{tx.WS}]*+|[^`*]++|\*"
)


def inline(text: Column) -> Column:
    """Bold each ``*word`` that opens a word outside back-ticks."""
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_INLINE), F.lit(0)),
        lambda p: F.when(
            p.startswith("*") & (F.length(p) > 1),
            F.concat(F.lit("**"), F.substring(p, 2, F.length(p)), F.lit("**")),
        ).otherwise(p),
    )
    return F.when(text.contains("*"), F.array_join(pieces, "")).otherwise(text)


def _nested_inline(body: Column) -> Column:
    opening = F.regexp_extract(body, rf"\A\*([{tx.ALNUM}][^{tx.WS}]*+)", 1)
    rest = F.substring(body, F.length(opening) + 2, F.length(body))
    return F.when(
        opening != "", F.concat(F.lit("**"), opening, F.lit("**"), rest)
    ).otherwise(inline(body))


def _line(line: Column, final: Column) -> Column:
    """One line outside fences, tables and dash runs; ``final`` = last visible line."""
    marked = line.rlike(rf"^[§>!~.?x](?:[{tx.WS}]|\z)")
    rest = F.substring(line, 2, F.length(line))
    head = F.lit(None).cast("string")
    for marker, rendered in LINE_MARKERS.items():
        head = F.when(line.startswith(marker), rendered).otherwise(head)
    return (
        F.when(marked & line.rlike(r"^[.?x]") & ~final, line)
        .when(marked, F.concat(head, inline(rest)))
        .when(line.startswith("\\"), inline(rest))
        .otherwise(inline(line))
    )


def _dash_run(run: Column) -> Column:
    ls = F.split(F.regexp_replace(run, r"\n\z", ""), "\n")
    depths = F.transform(
        ls, lambda l: F.length(F.regexp_extract(l, rf"^-++(?=[#>!~]?(?:[{tx.WS}]|\z))", 0))
    )
    # A depth is accepted or 0, so the fold keeps one character per line and not an array.
    fold = F.aggregate(
        depths,
        F.struct(F.lit(0).alias("last"), F.lit("").alias("flags")),
        lambda acc, d: F.when(
            d <= acc["last"] + 1, F.struct(d.alias("last"), F.concat(acc["flags"], F.lit("1")).alias("flags"))
        ).otherwise(F.struct(F.lit(0).alias("last"), F.concat(acc["flags"], F.lit("0")).alias("flags"))),
        lambda acc: F.split(acc["flags"], ""),
    )

    def item(line: Column, depth: Column) -> Column:
        rest = F.substring(line, depth + 1, F.length(line))
        prefix = F.lit("- ")
        for marker, rendered in NESTED_MARKERS.items():
            prefix = F.when(rest.startswith(marker), rendered).otherwise(prefix)
        body = F.regexp_replace(rest, rf"\A[#>!~]?[{tx.WS}]?", "")
        return F.when(
            depth > 0, F.concat(F.repeat(F.lit("  "), depth - 1), prefix, _nested_inline(body))
        ).otherwise(inline(line))

    accepted = F.zip_with(depths, fold, lambda d, flag: F.when(flag == "1", d).otherwise(F.lit(0)))
    rendered = F.zip_with(ls, accepted, item)
    ending = F.when(run.endswith("\n"), "\n").otherwise("")
    return F.concat(F.array_join(rendered, "\n"), ending)


def _table(run: Column) -> Column:
    rows = F.transform(
        F.split(F.regexp_replace(run, r"\n\z", ""), "\n"), lambda r: F.regexp_replace(r, r"\r\z", "")
    )

    def of(rs: Column) -> Column:
        cells = F.transform(
            rs, lambda r: F.transform(F.split(F.substring(r, 2, F.length(r)), r"\|"), tx.trim)
        )

        def rule(cs: Column) -> Column:
            def numeric(_: Column, column: Column) -> Column:
                values = F.filter(
                    F.transform(F.slice(cs, 2, F.size(cs)), lambda row: F.get(row, column)),
                    lambda v: v != "",
                )
                ok = (F.size(values) > 0) & F.forall(values, lambda v: v.rlike(_NUMBER))
                return F.when(ok, "---:|").otherwise("---|")

            return F.concat(F.lit("|"), F.array_join(F.transform(F.get(cs, F.lit(0)), numeric), ""))

        out = F.concat(
            F.array(F.concat(F.get(rs, F.lit(0)), F.lit("|")), tx.let(cells, rule)),
            F.transform(F.slice(rs, 2, F.size(rs)), lambda r: F.concat(r, F.lit("|"))),
        )
        ending = F.when(run.endswith("\n"), "\n").otherwise("")
        return F.concat(F.array_join(out, "\n"), ending)

    return F.when(table_is_valid(run), tx.let(rows, of)).otherwise(run)


def render_segment(part: Column, final: Column) -> Column:
    """Markdown of one segment; ``final`` = it holds the last visible line."""
    ending = F.when(part.endswith("\n"), "\n").otherwise("")
    return (
        F.when(part.startswith("```"), part)
        .when(part.startswith("|"), _table(part))
        .when(part.startswith("-"), _dash_run(part))
        .otherwise(
            F.concat(tx.let(F.regexp_replace(part, r"\n\z", ""), lambda l: _line(l, final)), ending)
        )
    )


def render(content: Column) -> Column:
    """Markdown of a marker-formatted text; anything malformed stays as it is."""

    def of(parts: Column) -> Column:
        last = F.array_max(F.transform(parts, lambda p, i: F.when(~tx.is_blank(p), i)))
        return tx.let(
            last,
            lambda final: F.array_join(F.transform(parts, lambda p, i: render_segment(p, i == final)), ""),
        )

    return tx.let(F.regexp_extract_all(content, F.lit(SEGMENTS), F.lit(0)), of)


def render_responses(responses: DataFrame, text_col: str = "content") -> DataFrame:
    return evaluate_once(responses, {"rendered": render(F.col(text_col))})


def restore_originals(
    messages: DataFrame, originals: DataFrame, text_col: str = "content"
) -> DataFrame:
    """Replace each text by the original recorded under its normalised hash.

    Misses keep their text.  A very frequent text is one hot join key against a single
    row, which adaptive execution splits.
    """
    keyed = evaluate_once(messages, {"__key": tx.normalized_hash(F.col(text_col))})
    lookup = originals.select(F.col("key").alias("__key"), F.col("original").alias("__original"))
    joined = keyed.join(lookup, "__key", "left")
    return joined.select(
        *messages.columns,
        F.coalesce("__original", text_col).alias("restored"),
        F.col("__original").isNull().alias("missed"),
    )


def substitution_counts(restored: DataFrame, by: list[str]) -> DataFrame:
    return restored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("substitution_attempts"),
        F.count_if("missed").alias("substitution_misses"),
    )


def roundtrip_audit(responses: DataFrame, text_col: str = "content") -> DataFrame:
    """Render, store what changed, look the rendered text up again and compare."""
    rendered = render_responses(responses, text_col)
    changed = rendered.where(F.col("rendered") != F.col(text_col)).select(
        "seq", F.col("rendered").alias("text"), F.col(text_col).alias("original")
    )
    restored = restore_originals(rendered, put_originals(changed), "rendered")
    same = F.col("restored") == F.col(text_col)
    return restored.withColumn("identical", same)

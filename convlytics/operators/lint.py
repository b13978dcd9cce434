"""Communication rules on assistant text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.functions import text as tx
from convlytics.plans.once import evaluate_once
from convlytics.plans.ordered import Nearest, carry

# Rule phrases.
NOISE = ["got it", "sounds good", "great question", "thanks for"]
HEDGES = ["perhaps", "maybe", "might", "possibly", "i think"]
ACTIONS = ["must", "need to", "should", "fix", "change", "run"]
VERBS = [
    "is", "are", "was", "were", "be", "been", "run", "add", "use", "fix", "check", "pass", "fails",
    "failed", "works", "will", "can", "has", "have", "need",
]
STRUCTURED = rf"^[{tx.WS}]*+(?:[|\-]|[§>!~.?x](?:[{tx.WS}]|\z))"

_FINDING = "struct<rule: string, message: string, heuristic: boolean, line: bigint>"


def _finding(rule: str, message: str, heuristic: bool = False, line: Column | None = None) -> Column:
    line = F.lit(None) if line is None else line
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(message).alias("message"),
        F.lit(heuristic).alias("heuristic"),
        line.cast("bigint").alias("line"),
    )


def _first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"\A[^\n]*+", 0)


def _unfenced(text: Column) -> Column:
    """The text with every line of a fenced block emptied, so line numbers stay right."""
    blanked = F.array_join(
        F.transform(
            F.regexp_extract_all(
                text, F.lit(r"(?d)```(?s:.*?)(?:\n```[^\n]*+|\z)\n?+|[^\n]*+\n|[^\n]++"), F.lit(0)
            ),
            lambda p: F.when(p.startswith("```"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p),
        ),
        "",
    )
    return F.when(text.contains("```"), blanked).otherwise(text)


def _long_lines(text: Column) -> Column:
    """Number, text, words and fence state of the lines with four words or more."""

    def facts(line: Column, i: Column, outside: Column) -> Column:
        return tx.let(
            tx.words(tx.without_code_spans(line)),
            lambda w: F.when(
                F.size(w) >= 4,
                F.struct(
                    (i + 1).alias("n"),
                    line.alias("line"),
                    w.alias("words"),
                    (F.get(outside, i) == line).alias("open"),
                ),
            ),
        )

    return tx.let(
        tx.lines(_unfenced(text)),
        lambda outside: F.array_compact(
            F.transform(tx.lines(text), lambda line, i: facts(line, i, outside))
        ),
    )


def _parallel_prose(long_lines: Column) -> Column:
    """First line of the smallest opening word pair that three prose lines share."""
    pairs = F.array_sort(
        F.transform(
            F.filter(long_lines, lambda r: r["open"] & ~r["line"].rlike(STRUCTURED)),
            lambda r: F.struct(
                F.get(r["words"], F.lit(0)).alias("a"), F.get(r["words"], F.lit(1)).alias("b"), r["n"].alias("n")
            ),
        )
    )

    def first_shared(ps: Column) -> Column:
        third = lambda i: F.get(ps, i + 2)
        hits = F.transform(
            ps,
            lambda p, i: F.when((third(i)["a"] == p["a"]) & (third(i)["b"] == p["b"]), p["n"]),
        )
        return F.get(F.array_compact(hits), F.lit(0))

    return tx.let(pairs, first_shared)


def _verbless_lines(long_lines: Column) -> Column:
    verbs = F.array(*[F.lit(v) for v in VERBS])
    suspects = F.filter(
        long_lines,
        lambda r: ~r["line"].rlike(rf"^[{tx.WS}]*+`") & ~F.arrays_overlap(r["words"], verbs),
    )
    return F.transform(suspects, lambda r: r["n"])


def lint_findings(text: Column) -> Column:
    """All document findings of a text, as an array in report order.

    The rule names and messages are fixed values.
    """
    none = F.array().cast(f"array<{_FINDING}>")

    def one(condition: Column, finding: Column) -> Column:
        return F.when(condition, F.array(finding).cast(f"array<{_FINDING}>")).otherwise(none)

    def of(low: Column, long_lines: Column) -> Column:
        opening = _first_line(low)
        hedges = sum((low.contains(h).cast("int") for h in HEDGES), F.lit(0))
        labelled = tx.has_marker_line(text, "!~")
        return F.concat(
            one(
                opening.contains("here's") | opening.startswith("sure"),
                _finding("B2", "preamble on first line", line=F.lit(1)),
            ),
            *[
                one(low.contains(p), _finding("B4", f"acknowledgment noise: {p}")) for p in NOISE
            ],
            one(hedges >= 3, _finding("R8", "high hedge density")),
            one(~tx.has_marker_line(text, ".?x"), _finding("G1", "missing typed terminal")),
            one(
                tx.contains_any(low, ACTIONS) & ~labelled,
                _finding("R3", "actionable statement lacks severity label"),
            ),
            F.transform(
                _verbless_lines(long_lines),
                lambda n: _finding(
                    "B5", "retained sentence may lack a finite verb (heuristic)", True, n
                ),
            ).cast(f"array<{_FINDING}>"),
            tx.let(
                _parallel_prose(long_lines),
                lambda n: one(
                    n.isNotNull(),
                    _finding("F4", "parallel prose may be clearer as bullets (heuristic)", True, n),
                ),
            ),
        )

    return tx.let(F.lower(text), lambda low: tx.let(_long_lines(text), lambda ls: of(low, ls)))


def lint_documents(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """One row per finding."""
    return docs.select(*id_cols, F.inline(lint_findings(F.col(text_col))))


def turn_overlap(turns: DataFrame, per_session: bool = True) -> DataFrame:
    """Assistant turns that share three or more words with the assistant turn before.

    ``per_session=False`` compares across session boundaries, in append order.
    """
    keys = ["session_id"] if per_session else []
    spoken = evaluate_once(
        turns.where("role = 'assistant'").select("session_id", "seq", "content"),
        {"words": F.array_distinct(tx.words(tx.without_code_spans(F.col("content"))))},
    ).drop("content")
    paired = carry(spoken, keys, "seq", {"before": Nearest(F.col("words"), inclusive=False)})
    shared = F.size(F.array_intersect("words", "before"))
    return paired.where(shared >= 3).select("session_id", "seq", shared.alias("shared_words"))


def lint_transcript(turns: DataFrame, per_session: bool = True) -> DataFrame:
    """Document findings of every assistant turn plus turn-to-turn overlap."""
    documents = lint_documents(
        turns.where("role = 'assistant'"), ["session_id", "seq"], "content"
    )
    overlap = turn_overlap(turns, per_session).select(
        "session_id",
        "seq",
        F.lit("B3/G2").alias("rule"),
        F.lit("overlap with prior assistant turn (heuristic)").alias("message"),
        F.lit(True).alias("heuristic"),
        F.col("seq").alias("line"),
    )
    return documents.unionByName(overlap)


def lint_trend(turns: DataFrame, by: list[str]) -> DataFrame:
    """Stored findings per group and rule."""
    findings = turns.select(*by, F.explode("lint").alias("f"))
    return findings.groupBy(*by, F.col("f.rule").alias("rule")).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("f.heuristic")).alias("heuristic_findings"),
    )

"""Schemas of the ledgers.

Every ledger also has a unique ``seq BIGINT`` in append order: Spark rows carry no order
of their own, and several reports depend on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, BIGINT = T.StringType(), T.IntegerType(), T.LongType()
DOUBLE, BOOLEAN = T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FINDING = struct(rule=STRING, message=STRING, heuristic=BOOLEAN, line=BIGINT)

SLOTS = struct(
    task=STRING,
    target_artifact=STRING,
    success_criterion=STRING,
    constraints=STRING,
    environment_reproduction=STRING,
    unresolved_unknowns=STRING,
)

# One struct covers readiness, terminal, advisory and thrash receipts.
RECEIPT = struct(
    signal=STRING,
    schema_version=INT,
    variant=STRING,
    conversation_start=BOOLEAN,
    score=INT,
    slots=SLOTS,
    reasons=T.ArrayType(STRING),
    state=STRING,
    arm=STRING,
    template_version=INT,
    injected=BOOLEAN,
    exact_repeated_tool_results=BIGINT,
    expensive_exact_repeated_tool_results=BIGINT,
    wire_cheap_exact_repeated_tool_results=BIGINT,
    near_repeated_tool_calls=BIGINT,
    edit_fail_edit_cycles=BIGINT,
)

TURN = struct(
    schema_version=INT,
    timestamp=STRING,
    session_id=STRING,
    session_turn=BIGINT,
    role=STRING,
    content=STRING,
    skill_version=STRING,
    lint=T.ArrayType(FINDING),
    receipts=T.ArrayType(RECEIPT),
)

USAGE = struct(
    input_tokens=BIGINT,
    output_tokens=BIGINT,
    total_tokens=BIGINT,
    cache_read_tokens=BIGINT,
    cache_creation_tokens=BIGINT,
)

COST = struct(
    schema_version=INT,
    provider=STRING,
    model=STRING,
    recorded_at_secs=BIGINT,
    session_id=STRING,
    session_turn=BIGINT,
    usage=USAGE,
    observed_billing_usd=DOUBLE,
    estimated_savings_usd=DOUBLE,
    compressor=STRING,
)

HEALTH_COUNTERS = [
    "substitution_attempts",
    "substitution_misses",
    "text_responses",
    "zero_sigil_responses",
    "table_runs",
    "malformed_table_runs",
]
HEALTH = struct(
    schema_version=INT,
    provider=STRING,
    model=STRING,
    skill_version=STRING,
    session_id=STRING,
    session_turn=BIGINT,
    **{counter: BIGINT for counter in HEALTH_COUNTERS},
)

LABEL = struct(session_id=STRING, completed=BOOLEAN, correct=BOOLEAN)

PRICING = struct(
    provider=STRING,
    input_per_million_usd=DOUBLE,
    output_per_million_usd=DOUBLE,
    cache_read_per_million_usd=DOUBLE,
    cache_write_per_million_usd=DOUBLE,
)

SERVED = struct(digest=STRING, served_at_secs=BIGINT)

TRANSFORM_RECEIPT = struct(digest=STRING, transform=STRING, original_bytes=BIGINT, at_secs=BIGINT)

EVAL_CORPUS = struct(
    corpus_version=STRING,
    tasks=T.ArrayType(
        struct(id=STRING, prompt=STRING, expected_outcome=STRING, follow_up_classification=STRING)
    ),
)
EVAL_CASES = struct(
    cases=T.ArrayType(
        struct(id=STRING, prompt=STRING, required_terms=T.ArrayType(STRING), expected_structure=STRING)
    )
)

CHUNK = struct(
    stream_id=BIGINT,
    chunk_seq=BIGINT,
    event_time=T.TimestampType(),
    provider=STRING,
    data=T.BinaryType(),
    closed=BOOLEAN,
)

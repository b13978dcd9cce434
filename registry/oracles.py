"""SQL that must give the same rows as each registered query.

The texts share only the derivation of the inputs with the Spark side; the computations
are written separately, in plain SQL without regard to scale.
"""

from __future__ import annotations

from registry import views

NL = "chr(10)"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"

TURNS = f"""
turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 1000 + turn AS seq,
    CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session_turn,
    role, {views.TURN_CONTENT} AS content, {views.PROVIDER} AS provider, 'm0' AS model,
    {views.SKILL_VERSION} AS skill_version
  FROM conversations WHERE role IN ('user', 'assistant'))"""

LONG = """
long_turns AS (
  SELECT seq, role, content,
    ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(seq / 2000.0) AS BIGINT) ORDER BY seq) AS session_turn,
    CAST(CAST(FLOOR(seq / 2000.0) AS BIGINT) AS VARCHAR) AS session_id
  FROM turns)"""

COSTS = """
costs AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session_id, 1 + event_id % 4 AS session_turn,
    CASE WHEN user_id % 3 = 0 THEN 'openai' WHEN user_id % 3 = 1 THEN 'anthropic' ELSE 'local' END AS provider,
    'm' || CAST(user_id % 2 AS VARCHAR) AS model,
    CAST(FLOOR(epoch(ts)) AS BIGINT) AS recorded_at_secs,
    100 + event_id % 900 AS input_tokens, 10 + event_id % 90 AS output_tokens,
    CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 0 ELSE (event_id % 5) * 20 END AS cache_read_tokens,
    CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS cache_creation_tokens,
    CASE WHEN event_type = 'click' THEN NULL
      ELSE CAST((100 + event_id % 900) * 3 + (10 + event_id % 90) * 15 AS DOUBLE) / 1000000.0 END AS observed_billing_usd,
    CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 1000.0 END AS estimated_savings_usd
  FROM events)"""

LABELS = """
outcomes AS (
  SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id,
    CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 3 <> 0 END AS completed,
    CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id % 4 <> 1 END AS correct
  FROM conversations WHERE conv_id % 11 <> 0)"""

BILLED = """
billed AS (
  SELECT session_id, SUM(GREATEST(COALESCE(observed_billing_usd, 0.0), 0.0)) AS usd, COUNT(*) AS n
  FROM costs WHERE session_id IS NOT NULL GROUP BY session_id)"""

TOOLS = """
tools AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session_id, 1 + event_id % 4 AS session_turn,
    'e' || CAST(event_id AS VARCHAR) AS event_key,
    CASE WHEN event_type IN ('error', 'signup') THEN 'result' ELSE 'call' END AS kind,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN 'c' || CAST(event_id AS VARCHAR) END AS call_key,
    CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_type END AS tool,
    CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE
      ['path', 'src', 'k' || CAST(event_id % 3 AS VARCHAR), 'v' || CAST(event_id % 2 AS VARCHAR)] END AS tokens,
    event_type = 'purchase' AS is_edit, event_type = 'error' AS failed, event_id % 7 = 0 AS wire_cheap,
    CASE WHEN event_type IN ('error', 'signup') THEN 'r' || CAST(event_id % 50 AS VARCHAR) END AS result_text
  FROM events)"""

DOCS = f"docs AS (SELECT doc_id, source, lang, text AS raw, {views.DOC_TEXT_SQL} AS text FROM documents)"
PROSE = f"prose AS (SELECT doc_id, source, {views.PROSE_TEXT} AS text FROM documents)"

def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def lines(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace({x}, '\\n$', ''), {NL}) END)"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def last_line(x: str) -> str:
    return f"list_last(list_filter({lines(x)}, lambda l: {strip('l')} <> ''))"


def state(x: str) -> str:
    line = last_line(x)
    return (
        f"CASE WHEN regexp_matches({line}, '^\\.(\\s|$)') THEN 'done'"
        f" WHEN regexp_matches({line}, '^\\?(\\s|$)') THEN 'decision'"
        f" WHEN regexp_matches({line}, '^x(\\s|$)') THEN 'blocked' ELSE 'missing' END"
    )


def words(x: str) -> str:
    bare = "lower(regexp_replace(w, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g'))"
    return (
        f"list_filter(list_transform(string_split_regex({x}, '\\s+'), lambda w: {bare}),"
        f" lambda w: strlen(w) > 2)"
    )


def classes(source: str, out: str, text: str = "text") -> str:
    """CTEs that add ``class`` to every row of ``source``."""
    kw = (
        "fn pub import def class function return const let var public private static void struct enum impl"
        " trait match async await package fun end then if else for while sudo git npm pnpm yarn brew cd ls cat"
        " rg grep python node curl gh export pip cargo rustc make docker kubectl"
    ).replace(" ", "|")
    log = (
        "regexp_matches(l, '^(?i:trace|debug|info|warn|error|fatal|panic)')"
        " OR (strlen(l) >= 19 AND regexp_matches(l, '^.{4}-.{2}-.{2} .{2}:'))"
        " OR (starts_with(l, '[') AND contains(l, ']'))"
    )
    search = (
        "strlen(l) <= 300 AND NOT starts_with(l, 'http')"
        " AND regexp_matches(l, '^[\\pL\\pN./_~-]+(:+[0-9]+(:|\\s|$)|:+(\\s|$))')"
    )
    code = (
        "regexp_matches(l, '^```|=>|::|->|[;{}]') OR"
        f" regexp_matches(l, '^({kw})(\\s|$)') OR (contains(l, '/') AND NOT starts_with(l, 'http'))"
    )

    def hits(test: str) -> str:
        return f"len(list_filter(ls, lambda l: {test}))"

    return f"""
{out}_a AS (SELECT *, {strip(text)} AS s FROM {source}),
{out}_b AS (SELECT *, list_transform({lines('s')}, lambda l: {strip('l')}) AS ls FROM {out}_a),
{out}_c AS (SELECT *, len(ls) AS total, {hits(log)} AS log_hits, {hits(search)} AS search_hits,
    {hits("contains(l, '|')")} AS pipe_hits,
    {hits("strlen(l) - strlen(replace(l, ',', '')) >= 3")} AS comma_hits, {hits(code)} AS code_hits FROM {out}_b),
{out} AS (SELECT *, CASE
    WHEN contains(s, chr(27)) THEN 'terminal'
    WHEN starts_with(s, '<') AND (contains(s, '</') OR contains(s, '/>')) THEN 'text'
    WHEN regexp_matches(s, '^[\\[{{]') AND json_valid(s) THEN 'json'
    WHEN total = 0 THEN 'text'
    WHEN starts_with(s, 'diff --git') OR regexp_matches(s, '(?m)^[ \\t]*@@ ')
      OR regexp_matches(s, '(?m)^(\\+\\+\\+|---) ') THEN 'diff'
    WHEN total <= 200 AND log_hits / total > 0.5 THEN 'log'
    WHEN search_hits / total > 0.5 THEN 'search-result'
    WHEN total >= 2 AND (pipe_hits / total > 0.7 OR comma_hits / total > 0.6) THEN 'tabular'
    WHEN code_hits / total > 0.4 THEN 'code'
    ELSE 'text' END AS class FROM {out}_c)"""


def normalized(x: str) -> str:
    """Prose cleaning for texts whose blanks are spaces and newlines."""

    def collapse(t: str) -> str:
        inner = f"regexp_replace({t}, '([^\\s]) +', '\\1 ', 'g')"
        return f"regexp_replace({inner}, '\\n\\n\\n+', {NL} || {NL}, 'g')"

    def drop(t: str, word: str) -> str:
        return f"regexp_replace({t}, '(?i)(^|[^\\pL\\pN\\pM_]){word}\\s*', '\\1', 'g')"

    t = collapse(x)
    t = drop(t, "please")
    t = f"replace({drop(f'''replace({t}, 'thanks to ', chr(1))''', 'thanks')}, chr(1), 'thanks to ')"
    t = drop(drop(drop(t, "thank you"), "thx"), "ty")
    t = collapse(t)
    t = (
        f"regexp_replace({t}, '(?i)(^|[^\\pL\\pN\\pM_])(fuck(ing|ed|er)?|shit(ty|s)?|bitch(es|ing)?|damn(ed|it)?|piss(ed|ing)?)($|[^\\pL\\pN\\pM_])',"
        " '\\1@%\\8', 'g')"
    )
    edge = "CASE WHEN regexp_matches(l, '[^;:, ]') THEN regexp_replace(l, '[;:, ]+$', '') ELSE rtrim(l) END"
    t = f"array_to_string(list_transform({lines(t)}, lambda l: {edge}), {NL})"
    return strip(t)


def outcome(alias: str) -> str:
    return f"{alias}.completed, {alias}.correct, {alias}.session_id IS NOT NULL AS labelled"


ORACLES: dict[str, str] = {}


def oracle(name: str, *parts: str) -> None:
    ORACLES[name] = "".join(parts)


# ------------------------------------------------------------------------ trajectories

oracle(
    "terminal_trajectories",
    with_(
        TURNS, LONG, COSTS, LABELS, BILLED,
        f"""spoken AS (SELECT session_id, seq, {state('content')} AS state, {last_line('content')} AS line
              FROM long_turns WHERE role = 'assistant')""",
        """marks AS (SELECT *, LAG(state, 1) OVER w AS s1, LAG(state, 2) OVER w AS s2,
              CASE WHEN state = 'blocked' THEN array_to_string(list_filter(
                string_split_regex(lower(substr(line, 2)), '\\s+'), lambda v: strlen(v) > 2), ' ') END AS cause
              FROM spoken WINDOW w AS (PARTITION BY session_id ORDER BY seq))""",
        """per AS (SELECT session_id, COUNT(*) AS spoken_n,
              COUNT(*) FILTER (WHERE state = 'done') AS done, COUNT(*) FILTER (WHERE state = 'decision') AS decision,
              COUNT(*) FILTER (WHERE state = 'blocked') AS blocked, COUNT(*) FILTER (WHERE state = 'missing') AS missing,
              bool_or(state = 'decision' AND s1 = 'decision' AND s2 = 'decision') AS ping,
              COUNT(NULLIF(cause, '')) > COUNT(DISTINCT NULLIF(cause, '')) AS again
              FROM marks GROUP BY session_id)""",
    ),
    f"""SELECT t.session_id, t.turns, COALESCE(spoken_n, 0) AS assistant_turns, COALESCE(done, 0) AS done_turns,
      COALESCE(decision, 0) AS decision_turns, COALESCE(blocked, 0) AS blocked_turns, COALESCE(missing, 0) AS missing_turns,
      COALESCE(ping, FALSE) AS decision_ping_pong, COALESCE(again, FALSE) AS repeated_blocked_cause,
      COALESCE(spoken_n >= 5 AND done = 0, FALSE) AS long_run_without_done,
      ROUND(COALESCE(b.usd, 0.0), 6) AS observed_billing_usd, {outcome('o')}
    FROM (SELECT session_id, COUNT(*) AS turns FROM long_turns GROUP BY session_id) t
    LEFT JOIN per USING (session_id) LEFT JOIN billed b USING (session_id)
    LEFT JOIN outcomes o ON o.session_id = t.session_id""",
)
oracle(
    "terminal_states",
    with_(TURNS),
    f"SELECT session_id, seq, {state('content')} AS state FROM turns WHERE role = 'assistant'",
)
oracle(
    "terminal_sequence",
    with_(TURNS, LONG),
    f"""SELECT session_id, seq, {state('content')} AS state,
      ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seq) AS position
    FROM long_turns WHERE role = 'assistant'""",
)

# ------------------------------------------------------------------------------- usage

RAW_USAGE = """
raw AS (SELECT event_id AS response_id, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider,
  100 + event_id % 900 AS tin, 10 + event_id % 90 AS tout, (event_id % 5) * 60 AS cached FROM events),
usage_rows AS (
  SELECT response_id, response_id * 2 AS seq, provider, tin AS input_tokens,
    CASE WHEN provider = 'anthropic' THEN 1 END AS output_tokens,
    CASE WHEN provider = 'anthropic' THEN tin + 1 END AS total_tokens,
    CASE WHEN provider = 'anthropic' THEN cached END AS cache_read_tokens,
    CAST(NULL AS BIGINT) AS cache_creation_tokens FROM raw
  UNION ALL
  SELECT response_id, response_id * 2 + 1, provider,
    CASE WHEN provider = 'openai' THEN GREATEST(tin - cached, 0) END, tout,
    CASE WHEN provider = 'openai' THEN tin + tout END,
    CASE WHEN provider = 'openai' THEN cached END, NULL FROM raw)"""
USAGE_COLUMNS = "input_tokens, output_tokens, total_tokens, cache_read_tokens, cache_creation_tokens"

oracle("normalize_usage", with_(RAW_USAGE), f"SELECT seq, provider, {USAGE_COLUMNS} FROM usage_rows")
oracle(
    "merge_usage",
    with_(RAW_USAGE),
    """SELECT a.response_id, COALESCE(b.input_tokens, a.input_tokens) AS input_tokens,
      COALESCE(b.output_tokens, a.output_tokens) AS output_tokens,
      COALESCE(b.total_tokens, a.total_tokens) AS total_tokens,
      COALESCE(b.cache_read_tokens, a.cache_read_tokens) AS cache_read_tokens,
      COALESCE(b.cache_creation_tokens, a.cache_creation_tokens) AS cache_creation_tokens
    FROM usage_rows a JOIN usage_rows b ON b.seq = a.seq + 1 AND a.seq % 2 = 0""",
)
oracle(
    "bill_usage",
    with_(COSTS),
    """SELECT seq, provider, ROUND(CASE provider
      WHEN 'openai' THEN input_tokens * 2.0 + output_tokens * 4.0 + COALESCE(cache_read_tokens, 0) * 1.0 + COALESCE(cache_creation_tokens, 0) * 2.0
      WHEN 'anthropic' THEN input_tokens * 3.0 + output_tokens * 15.0 + COALESCE(cache_read_tokens, 0) * 0.3 + COALESCE(cache_creation_tokens, 0) * 3.75
      END / 1000000.0, 9)::DOUBLE AS observed_billing_usd FROM costs""",
)
oracle(
    "usage_totals",
    with_(COSTS),
    """SELECT COUNT(*) AS records, ROUND(GREATEST(COALESCE(SUM(observed_billing_usd), 0), 0), 6) AS observed_billing_usd,
      COUNT(observed_billing_usd) AS priced_records, ROUND(COALESCE(SUM(estimated_savings_usd), 0), 6) AS estimated_savings_usd,
      COUNT(estimated_savings_usd) AS savings_records FROM costs""",
)
oracle(
    "session_costs",
    with_(COSTS, BILLED),
    "SELECT session_id, ROUND(usd, 6) AS observed_billing_usd, n AS cost_records FROM billed",
)
TURN_COSTS = """
turn_costs AS (SELECT session_id, session_turn, COUNT(*) AS cost_records,
  COUNT(*) FILTER (WHERE observed_billing_usd >= 0) AS priced_cost_records,
  COALESCE(SUM(observed_billing_usd) FILTER (WHERE observed_billing_usd >= 0), 0.0) AS observed_billing_usd
  FROM costs WHERE session_id IS NOT NULL AND session_turn IS NOT NULL GROUP BY session_id, session_turn)"""
oracle(
    "turn_costs",
    with_(COSTS, TURN_COSTS),
    "SELECT * REPLACE (ROUND(observed_billing_usd, 6) AS observed_billing_usd) FROM turn_costs",
)

VERBS = (
    "['is','are','was','were','be','been','run','add','use','fix','check','pass','fails','failed','works',"
    "'will','can','has','have','need']"
)
STRUCTURED = "'^\\s*([|\\-]|[§>!~.?x](\\s|$))'"


def findings(source: str, key: str, text: str) -> str:
    """CTEs for the rule findings of texts without fences or back-ticks."""
    low = f"lower({text})"
    noise = " UNION ALL ".join(
        f"SELECT {key}, 'B4' AS rule, 'acknowledgment noise: {p}' AS message, FALSE AS heuristic, NULL AS line"
        f" FROM {source} WHERE contains({low}, '{p}')"
        for p in ("got it", "sounds good", "great question", "thanks for")
    )
    hedges = " + ".join(
        f"CAST(contains({low}, '{h}') AS INT)" for h in ("perhaps", "maybe", "might", "possibly", "i think")
    )
    actions = " OR ".join(
        f"contains({low}, '{a}')" for a in ("must", "need to", "should", "fix", "change", "run")
    )
    return f"""
rows_ AS (SELECT {key}, UNNEST({lines(text)}) AS l, UNNEST(range(1, len({lines(text)}) + 1)) AS n FROM {source}),
worded AS (SELECT *, {words('l')} AS w FROM rows_),
parallel AS (SELECT {key}, w[1] AS a, w[2] AS b, MIN(n) AS first_line FROM worded
  WHERE len(w) >= 4 AND NOT regexp_matches(l, {STRUCTURED}) GROUP BY {key}, a, b HAVING COUNT(*) >= 3),
findings AS (
  SELECT {key}, 'B2' AS rule, 'preamble on first line' AS message, FALSE AS heuristic, 1 AS line FROM {source}
    WHERE contains(lower({lines(text)}[1]), 'here''s') OR starts_with(lower({lines(text)}[1]), 'sure')
  UNION ALL {noise}
  UNION ALL SELECT {key}, 'R8', 'high hedge density', FALSE, NULL FROM {source} WHERE {hedges} >= 3
  UNION ALL SELECT {key}, 'G1', 'missing typed terminal', FALSE, NULL FROM {source}
    WHERE NOT regexp_matches({text}, '(?m)^[.?x](\\s|$)')
  UNION ALL SELECT {key}, 'R3', 'actionable statement lacks severity label', FALSE, NULL FROM {source}
    WHERE ({actions}) AND NOT regexp_matches({text}, '(?m)^[!~](\\s|$)')
  UNION ALL SELECT {key}, 'B5', 'retained sentence may lack a finite verb (heuristic)', TRUE, n FROM worded
    WHERE len(w) >= 4 AND NOT list_has_any(w, {VERBS})
  UNION ALL SELECT {key}, 'F4', 'parallel prose may be clearer as bullets (heuristic)', TRUE, MIN_BY(first_line, (a, b))
    FROM parallel GROUP BY {key})"""


SPOKEN = "spoken AS (SELECT * FROM turns WHERE role = 'assistant')"
oracle(
    "transcript_cost",
    with_(TURNS, COSTS, SPOKEN, findings("spoken", "seq", "content")),
    """SELECT (SELECT COUNT(*) FROM turns) AS turns, (SELECT COUNT(*) FROM findings) AS lint_findings,
      (SELECT COUNT(*) FROM findings WHERE heuristic) AS heuristic_findings,
      ROUND(GREATEST(COALESCE(SUM(observed_billing_usd) FILTER (WHERE hit), 0), 0), 6) AS cost_usd,
      COUNT(*) FILTER (WHERE NOT hit) AS cost_records_excluded
    FROM (SELECT *, session_id IN (SELECT session_id FROM turns) AS hit FROM costs)""",
)
oracle(
    "cache_health",
    with_(
        COSTS,
        """seen AS (SELECT *, input_tokens + cache_read_tokens AS cacheable, ROW_NUMBER() OVER (ORDER BY seq) AS rn,
              COUNT(*) OVER () AS n FROM costs WHERE cache_read_tokens IS NOT NULL)""",
        """churn AS (SELECT COUNT(*) AS sessions FROM (SELECT session_id FROM seen GROUP BY session_id
              HAVING MIN(seq) FILTER (WHERE cache_read_tokens > 0) < MAX(seq) FILTER (WHERE cache_read_tokens = 0)))""",
    ),
    """SELECT COUNT(*) AS observed_records, COUNT(*) FILTER (WHERE cache_read_tokens > 0) AS cache_read_records,
      COUNT(*) FILTER (WHERE cache_read_tokens = 0) AS cache_miss_records,
      CAST(SUM(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(SUM(cacheable) AS BIGINT) AS cacheable_input_tokens,
      ROUND(SUM(cache_read_tokens) / SUM(cacheable), 9) AS cache_read_rate,
      ROUND(SUM(cache_read_tokens) FILTER (WHERE rn > n // 2) / SUM(cacheable) FILTER (WHERE rn > n // 2)
        - SUM(cache_read_tokens) FILTER (WHERE rn <= n // 2) / SUM(cacheable) FILTER (WHERE rn <= n // 2), 9) AS cache_read_rate_trend,
      (SELECT sessions FROM churn) AS cache_read_to_miss_sessions,
      ROUND(COALESCE(SUM(CASE WHEN observed_billing_usd > 0 THEN observed_billing_usd ELSE 0 END)
        FILTER (WHERE cache_read_tokens = 0), 0), 6) AS cache_miss_observed_billing_usd
    FROM seen""",
)
oracle(
    "cost_burn",
    with_(
        COSTS,
        """active AS (SELECT session_id, GREATEST(observed_billing_usd, 0) AS price FROM costs
              WHERE observed_billing_usd IS NOT NULL
                AND (SELECT MAX(recorded_at_secs) FROM costs) - recorded_at_secs <= 86400)""",
        "per AS (SELECT session_id, SUM(price) AS total, quantile_disc(price, 0.5) AS median FROM active GROUP BY session_id)",
        "mid AS (SELECT quantile_disc(total, 0.5) AS m FROM per)",
    ),
    """SELECT COUNT(*) AS active_cost_sessions, ROUND(MAX(m), 6) AS session_median_observed_billing_usd,
      COUNT(*) FILTER (WHERE m > 0 AND total > m * 3.0) AS sessions_above_three_x_median,
      ROUND(SUM(median), 6) AS next_turn_estimated_billing_usd,
      ROUND(SUM(total) + SUM(median), 6) AS projected_billing_after_next_turn_usd
    FROM per, mid""",
)
oracle(
    "transform_gate",
    with_(
        """gate_rows AS (SELECT conv_id AS request_id, turn AS pos, role, CASE WHEN conv_id % 3 = 0 AND turn >= 2
              THEN 'please  ' || text || ' ;' ELSE text END AS text FROM conversations)""",
        classes("gate_rows", "classed"),
        f"cleaned AS (SELECT *, CASE WHEN class = 'text' THEN {normalized('text')} ELSE text END AS clean FROM classed)",
        """marked AS (SELECT request_id, pos, strlen(to_json({'content': text, 'role': role})) AS bytes,
              CASE WHEN role = 'user' THEN GREATEST(strlen(text) - strlen(clean), 0) ELSE 0 END AS saved,
              role = 'user' AND clean <> text AS changed FROM cleaned)""",
        "firsts AS (SELECT request_id, MIN(pos) AS first_pos FROM marked WHERE changed GROUP BY request_id)",
        """sums AS (SELECT request_id, CAST(SUM(saved) AS BIGINT) AS saved_bytes,
              CAST(COALESCE(SUM(bytes) FILTER (WHERE pos >= first_pos), 0) AS BIGINT) // 4 AS invalidated_tokens
              FROM marked LEFT JOIN firsts USING (request_id) GROUP BY request_id)""",
    ),
    """SELECT request_id, saved_bytes, ROUND(saved_bytes / 4.0 * 2.0 / 1000000.0, 12)::DOUBLE AS savings_usd, invalidated_tokens,
      CASE WHEN saved_bytes / 4.0 * 2.0 / 1000000.0 > invalidated_tokens * 0.5 * 0.000000001 THEN 'allowed' ELSE 'denied' END AS verdict
    FROM sums""",
)

# ------------------------------------------------------------------------------ health


def counters(source: str, key: str, text: str, extra: str = "") -> str:
    """CTEs for the format counters of texts without fences or back-ticks."""
    return f"""
rows_ AS (SELECT {key}, UNNEST({lines(text)}) AS l, UNNEST(range(1, len({lines(text)}) + 1)) AS n FROM {source}),
runs AS (SELECT *, n - ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY n) AS run FROM rows_ WHERE starts_with(l, '|')),
tables AS (SELECT {key}, run, COUNT(*) >= 2 AND COUNT(DISTINCT len(string_split(l, '|'))) = 1
    AND NOT bool_or(ends_with(l, '|') AND length(l) > 1) AS good FROM runs GROUP BY {key}, run),
table_counts AS (SELECT {key}, COUNT(*) AS table_runs, COUNT(*) FILTER (WHERE NOT good) AS malformed_table_runs
    FROM tables GROUP BY {key}),
visible AS (SELECT {key}, MAX(n) AS last_n FROM rows_ WHERE {strip('l')} <> '' GROUP BY {key}),
marked AS (SELECT DISTINCT r.{key} FROM rows_ r JOIN visible v USING ({key})
    WHERE NOT starts_with(l, '|') AND (regexp_matches(l, '^[§>!~](\\s|$)') OR (n = last_n AND regexp_matches(l, '^[.?x](\\s|$)'))
      OR regexp_matches(l, '^-[#>!~]?(\\s|$)') OR regexp_matches(l, '(^|\\s)\\*[\\pL\\pN]'))
    UNION SELECT {key} FROM tables WHERE good),
counted AS (SELECT s.*{extra}, CAST({text} <> '' AS BIGINT) AS text_responses,
    CAST({text} <> '' AND m.{key} IS NULL AS BIGINT) AS zero_sigil_responses,
    COALESCE(t.table_runs, 0) AS table_runs, COALESCE(t.malformed_table_runs, 0) AS malformed_table_runs
    FROM {source} s LEFT JOIN marked m USING ({key}) LEFT JOIN table_counts t USING ({key}))"""


COUNTED = with_(
    TURNS, SPOKEN, counters("spoken", "seq", "content", ", 1 AS substitution_attempts, seq % 3 AS substitution_misses")
)
COUNTERS = "text_responses, zero_sigil_responses, table_runs, malformed_table_runs"
oracle("format_counters", COUNTED, f"SELECT seq, {COUNTERS} FROM counted")
oracle(
    "document_format_counters",
    with_(DOCS, counters("docs", "doc_id", "text")),
    f"SELECT doc_id, {COUNTERS} FROM counted",
)


def sums(*names: str) -> str:
    return ", ".join(f"CAST(SUM({n}) AS BIGINT) AS {n}" for n in names)


oracle(
    "model_health",
    COUNTED,
    f"""SELECT *, ROUND(substitution_misses / NULLIF(substitution_attempts, 0), 9) AS miss_rate,
      ROUND(zero_sigil_responses / NULLIF(text_responses, 0), 9) AS zero_sigil_rate,
      ROUND(malformed_table_runs / NULLIF(table_runs, 0), 9) AS malformed_table_rate
    FROM (SELECT provider, model, {sums('substitution_attempts', 'substitution_misses', *COUNTERS.split(', '))}
      FROM counted GROUP BY provider, model)""",
)
oracle(
    "format_health",
    COUNTED,
    f""", versions AS (SELECT provider, model, skill_version, {sums(*COUNTERS.split(', '))}, MIN(seq) AS first_seq
      FROM counted WHERE trim(skill_version) <> '' GROUP BY provider, model, skill_version),
    paired AS (SELECT *, LAG(skill_version) OVER w AS baseline_skill_version,
      {', '.join(f'LAG({c}) OVER w AS baseline_{c}' for c in COUNTERS.split(', '))}
      FROM versions WINDOW w AS (PARTITION BY provider, model ORDER BY first_seq, skill_version)),
    deltas AS (SELECT *, zero_sigil_responses / NULLIF(text_responses, 0)
        - baseline_zero_sigil_responses / NULLIF(baseline_text_responses, 0) AS zd,
      COALESCE(malformed_table_runs / NULLIF(table_runs, 0)
        - baseline_malformed_table_runs / NULLIF(baseline_table_runs, 0), 0) AS md FROM paired)
    SELECT * EXCLUDE (zd, md),
      ROUND(CASE WHEN baseline_skill_version IS NOT NULL THEN zd END, 9) AS zero_sigil_delta,
      ROUND(CASE WHEN baseline_skill_version IS NOT NULL THEN md END, 9) AS malformed_table_delta,
      CASE WHEN baseline_skill_version IS NULL THEN 'no_baseline'
        WHEN text_responses < 40 OR baseline_text_responses < 40 THEN 'insufficient_samples'
        WHEN zd > 0.05 OR md > 0.02 THEN 'rollback_recommended' ELSE 'monitoring' END AS assessment
    FROM deltas""",
)
PROBE = with_(
    TURNS, SPOKEN,
    f"rows_ AS (SELECT seq, provider, model, UNNEST({lines('content')}) AS l, UNNEST(range(1, len({lines('content')}) + 1)) AS n FROM spoken)",
    f"""line_facts AS (SELECT seq, provider, model, n, {strip('l')} <> '' AS visible,
          regexp_matches(l, '^[§>!~.?x](\\s|$)') OR regexp_matches(l, '^-+[#>!~]?(\\s|$)') OR regexp_matches(l, '^\\\\[§>!~.?x-]') AS marker,
          regexp_matches(l, '^[.?x](\\s|$)') AS terminal,
          starts_with(l, '|') AND ends_with(l, '|') AS closed, regexp_matches(l, '^-[^-#>!~ \\t]') AS dash FROM rows_)""",
    """probed AS (SELECT seq, provider, model, COUNT(*) FILTER (WHERE marker) AS sigil_line_count,
          COUNT(*) FILTER (WHERE terminal) AS terminal_count, bool_or(closed) AS closed, bool_or(dash) AS dash,
          COUNT(*) FILTER (WHERE terminal) > 0 AND (COUNT(*) FILTER (WHERE terminal) <> 1
            OR MAX(n) FILTER (WHERE terminal) <> MAX(n) FILTER (WHERE visible)) AS misplaced
          FROM line_facts GROUP BY seq, provider, model)""",
)
oracle(
    "probe_compliance",
    PROBE,
    """SELECT seq, sigil_line_count, terminal_count, sigil_line_count = 0 AS zero_sigil,
      closed OR dash OR misplaced AS malformed,
      concat_ws(',', CASE WHEN dash THEN 'ambiguous dash prefix' END,
        CASE WHEN misplaced THEN 'terminal is missing, duplicated, or not final' END,
        CASE WHEN closed THEN 'trailing table separator' END) AS reasons FROM probed""",
)
oracle(
    "probe_planted",
    PROBE.replace(TURNS.strip() + ",\n" + SPOKEN, f"spoken AS (SELECT doc_id AS seq, 'p' AS provider, 'm' AS model, {views.PROBE_TEXT} AS content FROM documents)"),
    """SELECT reasons, reasons <> '' AS malformed, COUNT(*) AS responses, CAST(SUM(seq) AS BIGINT) AS doc_sum, CAST(SUM(sigil_line_count) AS BIGINT) AS marker_lines
    FROM (SELECT *, concat_ws(',', CASE WHEN dash THEN 'ambiguous dash prefix' END,
        CASE WHEN misplaced THEN 'terminal is missing, duplicated, or not final' END,
        CASE WHEN closed THEN 'trailing table separator' END, CASE WHEN seq % 8 = 5 THEN 'unterminated fence' END) AS reasons FROM probed) GROUP BY reasons""",
)
oracle(
    "compliance_rates",
    PROBE,
    """SELECT provider, model, COUNT(*) AS responses, ROUND(AVG(CAST(sigil_line_count = 0 AS DOUBLE)), 9) AS zero_sigil_rate,
      ROUND(AVG(CAST(closed OR dash OR misplaced AS DOUBLE)), 9) AS malformed_rate FROM probed GROUP BY provider, model""",
)
# The derived turns end in one terminal line, optionally after one table.
RENDERED = f"""
rendered AS (SELECT seq, provider, content,
  regexp_replace(regexp_replace(regexp_replace(
    replace(content, '|Name|Count' || {NL} || '|one|2' || {NL}, '|Name|Count|' || {NL} || '|---|---:|' || {NL} || '|one|2|' || {NL}),
    '\\n\\. (done|shipped)$', '\n**Done.** \\1'), '\\n\\? need scope; options: a, b$', '\n**Decision needed:** need scope; options: a, b'),
    '\\nx dependency unavailable$', '\n**Blocked:** dependency unavailable') AS rendered FROM spoken)"""
oracle("render_responses", with_(TURNS, SPOKEN, RENDERED), "SELECT seq, rendered FROM rendered")
oracle(
    "restore_originals",
    with_(TURNS, SPOKEN, RENDERED),
    """SELECT provider, COUNT(*) AS substitution_attempts,
      COUNT(*) FILTER (WHERE rendered NOT IN (SELECT rendered FROM rendered WHERE rendered <> content)) AS substitution_misses,
      COUNT(*) AS identical FROM rendered GROUP BY provider""",
)

# ----------------------------------------------------------------------------- content

oracle(
    "content_classes",
    with_(DOCS, classes("docs", "classed")),
    """SELECT doc_id, class AS content_class, class IN ('code', 'diff', 'terminal', 'json') AS action_sensitive FROM classed""",
)
oracle("page_classes", with_(classes("pages", "classed", "html")), "SELECT page_id, class AS content_class FROM classed")
oracle(
    "raw_document_classes",
    with_(classes("documents", "classed")),
    "SELECT doc_id, class AS content_class FROM classed",
)
CENSUS = """
census AS (SELECT source, lang, class AS content_class, COUNT(*) AS docs, CAST(SUM(strlen(text)) AS BIGINT) AS bytes,
  COUNT(*) FILTER (WHERE class IN ('code', 'diff', 'terminal', 'json')) AS action_sensitive_docs
  FROM classed GROUP BY source, lang, class)"""
oracle("content_census", with_(DOCS, classes("docs", "classed"), CENSUS), "SELECT * FROM census")
oracle(
    "census_shares",
    with_(DOCS, classes("docs", "classed")),
    """SELECT source, COUNT(*) AS docs,
      ROUND(COUNT(*) FILTER (WHERE class IN ('code', 'diff', 'terminal', 'json')) / COUNT(*), 9) AS action_sensitive_share,
      COUNT(DISTINCT class) AS classes FROM classed GROUP BY source""",
)
oracle(
    "safety_verdicts",
    """SELECT 'S' || CAST(doc_id % 5 AS VARCHAR) AS safety_class, doc_id % 5 < 2 AS byte_safe, doc_id % 5 = 4 AS requires_ccr,
      doc_id % 5 < 3 AS reversible, doc_id % 2 = 0 AS ccr_available,
      CASE WHEN doc_id % 5 < 4 THEN 'allowed' WHEN doc_id % 2 = 0 THEN 'allowed_with_ccr' ELSE 'denied' END AS verdict,
      COUNT(*) AS transforms FROM documents GROUP BY ALL""",
)
CLEAN = f"cleaned AS (SELECT *, CASE WHEN class = 'text' THEN {normalized('text')} ELSE text END AS normalized FROM classed)"
oracle(
    "normalize_prose",
    with_(PROSE, classes("prose", "classed"), CLEAN),
    """SELECT doc_id, normalized, strlen(text) AS bytes_before, strlen(normalized) AS bytes_after, normalized <> text AS changed
    FROM cleaned""",
)
oracle(
    "normalization_savings",
    with_(PROSE, classes("prose", "classed"), CLEAN),
    """SELECT source, COUNT(*) AS docs, COUNT(*) FILTER (WHERE normalized <> text) AS changed_docs,
      CAST(SUM(GREATEST(strlen(text) - strlen(normalized), 0)) AS BIGINT) AS saved_bytes FROM cleaned GROUP BY source""",
)
oracle(
    "recovery_map",
    with_(
        PROSE, classes("prose", "classed"), CLEAN,
        f"""keyed AS (SELECT doc_id, text, sha256(array_to_string(list_transform({lines('normalized')},
              lambda l: rtrim(l, {BLANKS})), {NL})) AS key FROM cleaned WHERE normalized <> text)""",
        "ranked AS (SELECT *, FIRST_VALUE(text) OVER (PARTITION BY key ORDER BY doc_id) AS winner FROM keyed)",
    ),
    """SELECT key, COUNT(*) AS writers, COUNT(*) FILTER (WHERE text <> winner) AS rejected, MIN(doc_id) AS first_seq
    FROM ranked GROUP BY key""",
)


def masked(x: str) -> str:
    """Redaction of lines that hold only ``name = "value"`` secrets or ``name=value``."""
    quoted = f"""regexp_replace({x}, '(?i)((?:x-api-key|api[_-]?key|access[_-]?token|token|password|secret)\\s*[:=]\\s*")[^"\\n]*"', '\\1[REDACTED]"', 'g')"""
    return f"""regexp_replace({quoted}, '(?i)((?:x-api-key|api[_-]?key|access[_-]?token|token|password|secret)\\s*[:=]\\s*)([^\\s,;&"''}}]+)', '\\1[REDACTED]', 'g')"""


def no_final_newline(x: str) -> str:
    return f"regexp_replace({x}, '\\n$', '')"


def escaped(x: str) -> str:
    """A string as JSON writes it."""
    marks = {"'\\'": "'\\\\'", "'\"'": "'\\\"'", "chr(10)": "'\\n'", "chr(13)": "'\\r'", "chr(9)": "'\\t'"}
    for plain, written in marks.items():
        x = f"replace({x}, {plain}, {written})"
    return x


def sorted_json(text: str) -> str:
    """The generated JSON documents, minified with their keys sorted."""
    return f"""'{{"a":[1,2],"b":' || CAST(doc_id AS VARCHAR) || ',"text":"' || {escaped(text)} || '"}}'"""


oracle(
    "redact_secrets",
    with_(DOCS),
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN {sorted_json(masked('raw'))}
      ELSE {no_final_newline(masked('text'))} END AS redacted FROM docs""",
)
EVERY_TURN = f"turns AS (SELECT conv_id * 1000 + turn AS seq, {views.TURN_CONTENT} AS content FROM conversations)"
oracle("redact_turns", with_(EVERY_TURN), f"SELECT seq, {no_final_newline(masked('content'))} AS redacted FROM turns")
oracle(
    "secret_counts",
    """SELECT source, 0 AS authorization, 0 AS cookie,
      CAST(SUM(len(regexp_extract_all(text, '(?i)(?:x-api-key|api[_-]?key|access[_-]?token|token|password|secret)"?\\s*[:=]\\s*"[^"\\n]*"'))) AS BIGINT) AS double_quoted,
      0 AS single_quoted, 0 AS named, CAST(SUM(len(regexp_extract_all(text, '(?i)https?://[^/\\s@]+@'))) AS BIGINT) AS uri_userinfo,
      0 AS private_key FROM documents GROUP BY source""",
)
RESULTS = """
results AS (SELECT doc_id, source AS origin, text, raw, CAST(doc_id % 40 AS VARCHAR) AS session_id,
  CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE 'tool_result' END AS source,
  CASE doc_id % 10 WHEN 0 THEN 'json' WHEN 1 THEN 'log' WHEN 4 THEN 'tabular' WHEN 2 THEN 'json' ELSE 'file_read' END AS kind,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1000000 - doc_id % 400 + CASE WHEN doc_id % 19 = 0 THEN 1000 ELSE 0 END END AS captured,
  doc_id % 11 = 0 AS protected, doc_id % 3 = 0 AS in_recent_window FROM docs)"""
CHOSEN = """
chosen AS (SELECT *, CASE WHEN source <> 'tool_result' OR protected OR captured IS NULL OR captured > 1000000
    OR 1000000 - captured > 300 THEN NULL
  WHEN kind IN ('json', 'tabular') AND class = kind THEN 'toon'
  WHEN kind = 'log' AND class = 'log' THEN 'repeated_log'
  WHEN kind = 'file_read' AND NOT in_recent_window THEN 'file_reference' END AS transform FROM classed)"""
oracle(
    "eligible_results",
    with_(DOCS, RESULTS, classes("results", "classed"), CHOSEN),
    "SELECT doc_id, transform FROM chosen",
)


def compacted(x: str) -> str:
    """Only the generated JSON documents need their keys sorted."""
    body = (
        f"CASE WHEN doc_id % 10 = 0 THEN {sorted_json('raw')}"
        f" ELSE array_to_string(list_transform({lines(x)}, lambda l: {strip('l')}), {NL}) END"
    )
    return f"'[convlytics:toon:' || sha256({x}) || ']' || {NL} || {body} || {NL}"


oracle(
    "compact_structured",
    with_(DOCS),
    f"SELECT doc_id, {compacted('text')} AS compacted FROM docs",
)
COLLAPSED = f"""
pieces AS (SELECT doc_id, p || CASE WHEN n < total OR ends_with(text, {NL}) THEN {NL} ELSE '' END AS piece, n FROM (
  SELECT doc_id, text, UNNEST({lines('text')}) AS p, UNNEST(range(1, len({lines('text')}) + 1)) AS n, len({lines('text')}) AS total FROM docs)),
islands AS (SELECT *, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM (
  SELECT *, CASE WHEN piece = LAG(piece) OVER (PARTITION BY doc_id ORDER BY n) THEN 0 ELSE 1 END AS fresh FROM pieces)),
folded AS (SELECT doc_id, island, ANY_VALUE(piece) || CASE WHEN COUNT(*) > 1 THEN '[convlytics:repeat:' || COUNT(*) || ']' || {NL} ELSE '' END AS part
  FROM islands GROUP BY doc_id, island),
collapsed AS (SELECT d.doc_id, '[convlytics:log:' || sha256(d.text) || ']' || {NL} || COALESCE(f.body, '') AS collapsed FROM docs d
  LEFT JOIN (SELECT doc_id, string_agg(part, '' ORDER BY island) AS body FROM folded GROUP BY doc_id) f USING (doc_id))"""
oracle("collapse_repeats", with_(DOCS, COLLAPSED), "SELECT doc_id, collapsed FROM collapsed")

# ------------------------------------------------------------------------------- store

SERVED = """
served AS (SELECT sha256(text) AS digest, CASE WHEN doc_id % 8 = 0 THEN 999900 WHEN doc_id % 12 = 0 THEN NULL
  ELSE 10 + doc_id END AS served_at_secs FROM documents WHERE doc_id % 4 = 0),
recent AS (SELECT DISTINCT digest FROM served WHERE served_at_secs <= 1000000 AND 1000000 - served_at_secs <= 300)"""
oracle(
    "dedup_reads",
    with_(
        SERVED,
        """reads AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS session_id, a.again * 1000000000 + doc_id AS seq,
              1 + (a.again * 7 + doc_id) % 3 AS session_turn, text,
              sha256(text) AS digest FROM documents, (SELECT UNNEST([0, 1]) AS again) a)""",
        """ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, digest ORDER BY seq) > 1
              AND session_turn > 1 AND digest NOT IN (SELECT digest FROM recent) AS referenced FROM reads)""",
    ),
    """SELECT session_id, seq, digest, referenced,
      CASE WHEN referenced THEN strlen('[convlytics:file-ref:]') + 64 + 1 ELSE strlen(text) END AS rendered_bytes FROM ranked""",
)
oracle(
    "blob_store",
    """SELECT DISTINCT sha256(text) AS digest, strlen(text) AS bytes FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""",
)
oracle(
    "blob_lookup",
    """SELECT status, COUNT(*) AS refs FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'invalid_digest'
      WHEN sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) THEN 'unknown'
      WHEN starts_with(sha256(text), '0') THEN 'corrupt' ELSE 'found' END AS status FROM documents) GROUP BY status""",
)
oracle(
    "collectable_blobs",
    with_(SERVED),
    """SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (
      SELECT sha256(text) FROM documents WHERE (doc_id % 40) * 200 <= 3600 UNION SELECT digest FROM recent)""",
)
oracle(
    "retain_served",
    with_(SERVED),
    """SELECT served_at_secs IS NULL AS unreadable, COUNT(*) AS entries FROM served
    WHERE served_at_secs IS NULL OR (served_at_secs <= 1000000 + 2592000 - 500000
      AND 1000000 + 2592000 - 500000 - served_at_secs <= 2592000) GROUP BY ALL""",
)
oracle(
    "transform_savings",
    with_(DOCS, RESULTS, classes("results", "classed"), CHOSEN, COLLAPSED),
    f"""SELECT transform, COUNT(*) AS receipts, CAST(SUM(strlen(text)) AS BIGINT) AS original_bytes,
      CAST(SUM(CASE transform WHEN 'toon' THEN strlen({compacted('text')}) WHEN 'repeated_log' THEN strlen(collapsed)
        ELSE strlen('[convlytics:file-ref]') END) AS BIGINT) AS rendered_bytes
    FROM chosen JOIN collapsed USING (doc_id) WHERE transform IS NOT NULL GROUP BY transform""",
)
oracle(
    "attestations",
    """WITH once AS (SELECT sha256(text) AS digest, ANY_VALUE(CASE WHEN doc_id % 5 = 0 THEN doc_id % 6 + 1 ELSE doc_id % 6 END) AS place,
      ANY_VALUE(doc_id % 2 = 0) AS protected FROM documents GROUP BY sha256(text) HAVING COUNT(*) = 1)
    SELECT doc_id, digest, doc_id % 6 AS message_index, protected FROM documents
    JOIN once ON digest = sha256(text) AND place = doc_id % 6""",
)

# -------------------------------------------------------------------------------- lint

oracle(
    "lint_findings",
    with_(TURNS, SPOKEN, findings("spoken", "seq", "content")),
    "SELECT seq, rule, message, heuristic, line FROM findings",
)
oracle(
    "lint_raw_documents",
    with_(findings("documents", "doc_id", "text")),
    """SELECT rule, COUNT(*) AS findings, COUNT(DISTINCT doc_id) AS docs, CAST(SUM(COALESCE(line, 0)) AS BIGINT) AS line_sum
    FROM findings GROUP BY rule""",
)
oracle(
    "lint_planted",
    with_(f"planted AS (SELECT doc_id, {views.LINT_TEXT} AS text FROM documents)", findings("planted", "doc_id", "text")),
    "SELECT rule, message, COUNT(*) AS findings, CAST(SUM(doc_id) AS BIGINT) AS doc_sum FROM findings GROUP BY rule, message",
)
oracle(
    "lint_overlap",
    with_(
        TURNS, LONG,
        f"""worded AS (SELECT session_id, seq, list_distinct({words('content')}) AS w FROM long_turns WHERE role = 'assistant')""",
        "paired AS (SELECT *, LAG(w) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM worded)",
    ),
    """SELECT session_id, seq, len(list_intersect(w, before)) AS shared_words FROM paired
    WHERE before IS NOT NULL AND len(list_intersect(w, before)) >= 3""",
)
oracle(
    "lint_trend",
    with_(TURNS, SPOKEN, findings("spoken", "seq", "content")),
    """SELECT skill_version, rule, COUNT(*) AS findings, COUNT(*) FILTER (WHERE heuristic) AS heuristic_findings
    FROM findings JOIN spoken USING (seq) GROUP BY skill_version, rule""",
)

# ----------------------------------------------------------------------------- signals


def any_of(x: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


def begins(x: str, *needles: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{n}')" for n in needles) + ")"


def slot_columns(x: str) -> str:
    def present(test: str) -> str:
        return f"CASE WHEN {test} THEN 'present' ELSE 'missing' END"

    task = any_of(x, "?", "please ", "can you ", "could you ", "i need ", "i want ") + " OR " + begins(
        x, "fix ", "add ", "implement ", "update ", "remove ", "refactor ", "explain "
    )
    target = any_of(
        x, "file", "repo", "repository", "component", "module", "function", "endpoint", "api", "codebase", "test",
        "/", ".rs", ".ts", ".py",
    )
    success = any_of(x, "acceptance", "done", "expected", "should ", "must ", "pass", "verify", "working")
    limits = any_of(
        x, "do not", "don't", "must not", "only ", "without", "avoid", "preserve", "compatible", "compatibility",
        "keep ",
    )
    debug = any_of(x, "bug", "error", "fail", "crash", "regression", "reproduce", "stack trace")
    evidence = any_of(
        x, "error:", "stack trace", "reproduce", "version", " macos", " linux", " windows"
    ) + f" OR regexp_matches({x}, '[0-9]')"
    unknown = any_of(x, "not sure", "unknown", "unclear", "don't know", "unsure")
    return f"""{present(task)} AS task, {present(target)} AS target_artifact, {present(success)} AS success_criterion,
  {present(limits)} AS constraints,
  CASE WHEN NOT {debug} THEN 'not_applicable' WHEN {evidence} THEN 'present' ELSE 'missing' END AS environment_reproduction,
  CASE WHEN {unknown} THEN 'unresolved' ELSE 'not_applicable' END AS unresolved_unknowns"""


def blocks(source: str, key: str, text: str) -> str:
    """CTEs: the last prose block of each text."""
    return f"""
blocks AS (SELECT {key}, UNNEST(string_split({text}, {NL} || {NL})) AS text,
  UNNEST(range(1, len(string_split({text}, {NL} || {NL})) + 1)) AS b FROM {source}),
{classes('blocks', 'block_classes')},
prose_blocks AS (SELECT {key}, MAX_BY(s, b) AS block FROM block_classes WHERE s <> '' AND class = 'text' GROUP BY {key})"""


SCORE = """CAST(FLOOR(((task = 'present')::INT + (target_artifact = 'present')::INT + (success_criterion = 'present')::INT
  + (constraints = 'present')::INT + (environment_reproduction = 'present')::INT) * 100.0
  / (4 + (environment_reproduction <> 'not_applicable')::INT)) AS INT)"""
READINESS = with_(
    TURNS,
    "asked AS (SELECT * FROM turns WHERE role = 'user')",
    blocks("asked", "seq", "content"),
    f"""texts AS (
          SELECT a.*, 'raw_composite' AS variant, lower(content) AS low, FALSE AS fallback FROM asked a
          UNION ALL SELECT a.*, 'trailing_prose', lower(COALESCE(p.block, content)), p.block IS NULL
          FROM asked a LEFT JOIN prose_blocks p USING (seq))""",
    f"slotted AS (SELECT *, {slot_columns('low')} FROM texts)",
    f"scored AS (SELECT *, {SCORE} AS score FROM slotted)",
)
oracle(
    "readiness",
    READINESS,
    """SELECT seq, variant, score, task, target_artifact, success_criterion, constraints, environment_reproduction, unresolved_unknowns,
      concat_ws(',', CASE WHEN task = 'missing' THEN 'no_task' END,
        CASE WHEN target_artifact = 'missing' THEN 'no_target_artifact' END,
        CASE WHEN success_criterion = 'missing' THEN 'no_success_criterion' END,
        CASE WHEN constraints = 'missing' THEN 'no_constraints' END,
        CASE WHEN environment_reproduction = 'missing' THEN 'no_environment_reproduction' END,
        CASE WHEN unresolved_unknowns = 'unresolved' THEN 'unresolved_unknowns' END,
        CASE WHEN fallback THEN 'trailing_prose_fallback' END) AS reasons FROM scored""",
)
oracle(
    "trailing_prose",
    with_(blocks("documents", "doc_id", "text")),
    """SELECT doc_id, strlen(COALESCE(block, text)) AS prose_bytes, sha256(COALESCE(block, text)) AS prose_hash, block IS NULL AS fallback
    FROM documents LEFT JOIN prose_blocks USING (doc_id)""",
)
INJECTS = "ascii(substr(sha256(session_id), 1, 1)) % 2 = 0"
oracle(
    "experiment_arms",
    with_(TURNS),
    f"""SELECT session_id, MIN(seq) AS seq, CASE WHEN {INJECTS} THEN 'inject' ELSE 'record_only' END AS arm,
      'raw_composite' AS variant, 1 AS template_version, {INJECTS} AS injected
    FROM turns WHERE role = 'user' AND session_turn = 1 GROUP BY session_id""",
)
STARTS = "(role = 'user' AND session_turn = 1 AND seq % 3 <> 2)"
REPORT = READINESS + f""",
{COSTS}, {LABELS}, {BILLED}, {TURN_COSTS},
firsts AS (SELECT session_id, MIN(seq) AS seq FROM turns WHERE {STARTS} GROUP BY session_id),
sizes AS (SELECT session_id, COUNT(*) AS turns FROM turns GROUP BY session_id),
observed AS (SELECT s.session_id, z.turns, s.variant, s.score, COALESCE(b.usd, 0.0) AS usd, COALESCE(b.n, 0) AS cost_n,
  {outcome('o')} FROM firsts f JOIN scored s USING (seq) JOIN sizes z ON z.session_id = s.session_id
  LEFT JOIN billed b ON b.session_id = s.session_id LEFT JOIN outcomes o ON o.session_id = s.session_id)"""
oracle(
    "readiness_observations",
    REPORT,
    """SELECT session_id, turns, variant, score, ROUND(usd, 6) AS observed_billing_usd, completed, correct, labelled FROM observed""",
)
oracle(
    "readiness_buckets",
    REPORT,
    """SELECT variant, score, COUNT(*) AS sessions, ROUND(SUM(usd), 6) AS observed_billing_usd,
      COUNT(*) FILTER (WHERE labelled) AS labelled_sessions, COUNT(*) FILTER (WHERE completed) AS completed_sessions,
      COUNT(*) FILTER (WHERE correct) AS correct_sessions FROM observed GROUP BY variant, score""",
)
oracle("unlabelled_sessions", REPORT, "SELECT COUNT(DISTINCT session_id) AS unlabelled_sessions FROM observed WHERE NOT labelled")

HELD = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(session_id, ''), lambda c: ascii(c)::HUGEINT)),
  lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 5 = 0"""


def correlation(x: str, y: str, test: str) -> str:
    base = f"covar_pop({y}, {x}) FILTER (WHERE {test}) / NULLIF(stddev_pop({x}) FILTER (WHERE {test}) * stddev_pop({y}) FILTER (WHERE {test}), 0)"
    return base


HELD_STATS = f""",
held AS (SELECT *, completed IS NOT NULL AND correct IS NOT NULL AS full_label, score::DOUBLE AS s FROM observed WHERE {HELD}),
variant_stats AS (SELECT variant, COUNT(*) AS held_out_sessions, COUNT(*) FILTER (WHERE full_label) AS labelled_sessions,
  COUNT(*) FILTER (WHERE full_label AND completed) AS completed_sessions,
  COUNT(*) FILTER (WHERE full_label AND correct) AS correct_sessions, SUM(usd) AS usd,
  {correlation('s', 'correct::INT::DOUBLE', 'full_label')} AS rc, {correlation('s', 'usd', 'full_label AND completed')} AS rd,
  AVG(turns) AS mean_turns FROM held GROUP BY variant)"""
oracle(
    "held_out_variants",
    REPORT, HELD_STATS,
    """SELECT variant, held_out_sessions, labelled_sessions, completed_sessions, correct_sessions,
      ROUND(usd, 6) AS observed_billing_usd, ROUND(usd / NULLIF(completed_sessions, 0), 6) AS billed_dollars_per_completed_task,
      ROUND(rc, 9) AS score_correctness_correlation, ROUND(rd, 9) AS score_cost_correlation,
      ROUND(mean_turns, 9) AS diagnostic_mean_turns FROM variant_stats""",
)
oracle(
    "held_out_analysis",
    REPORT, HELD_STATS,
    f"""SELECT (SELECT COUNT(DISTINCT session_id) FROM observed WHERE NOT ({HELD})) AS training_sessions,
      COUNT(DISTINCT session_id) AS held_out_sessions, COUNT(DISTINCT session_id) FILTER (WHERE full_label) AS labelled_held_out_sessions,
      CASE WHEN COUNT(DISTINCT session_id) FILTER (WHERE full_label) < 8 THEN 'stop_insufficient_evidence'
        ELSE COALESCE('select_' || (SELECT variant FROM variant_stats WHERE rc >= 0.30 AND rd <= -0.30
          ORDER BY rc - rd DESC, variant DESC LIMIT 1), 'stop_no_predictive_variant') END AS decision FROM held""",
)
ARMS = f""",
arms AS (SELECT f.session_id, CASE WHEN ascii(substr(sha256(f.session_id), 1, 1)) % 2 = 0 THEN 'inject' ELSE 'record_only' END AS arm,
  z.turns, b.usd, o.session_id IS NOT NULL AND b.n > 0 AS eligible, o.completed, o.correct
  FROM firsts f JOIN sizes z USING (session_id) LEFT JOIN billed b USING (session_id) LEFT JOIN outcomes o ON o.session_id = f.session_id)"""
oracle(
    "experiment_report",
    REPORT, ARMS,
    """SELECT arm, COUNT(*) AS assigned_sessions, COUNT(*) FILTER (WHERE eligible) AS eligible_sessions,
      COUNT(*) FILTER (WHERE eligible AND completed) AS completed_sessions, COUNT(*) FILTER (WHERE eligible AND correct) AS correct_sessions,
      ROUND(COALESCE(SUM(usd) FILTER (WHERE eligible), 0), 6) AS observed_billing_usd,
      ROUND(SUM(usd) FILTER (WHERE eligible) / NULLIF(COUNT(*) FILTER (WHERE eligible AND completed), 0), 6) AS billed_dollars_per_completed_task,
      ROUND(COALESCE(AVG(turns) FILTER (WHERE eligible), 0), 6) AS diagnostic_mean_turns FROM arms GROUP BY arm""",
)
oracle(
    "experiment_decision",
    REPORT, ARMS,
    """SELECT COUNT(*) FILTER (WHERE NOT COALESCE(eligible, FALSE)) AS excluded_sessions,
      CASE WHEN LEAST(COUNT(*) FILTER (WHERE eligible AND arm = 'inject'), COUNT(*) FILTER (WHERE eligible AND arm = 'record_only')) >= 8
        THEN 'review_required' ELSE 'stop_insufficient_evidence' END AS decision FROM arms""",
)
CLARIFY = f""",
questions AS (SELECT DISTINCT session_id, session_turn FROM turns WHERE role = 'assistant' AND {state('content')} = 'decision'),
user_turns AS (SELECT DISTINCT session_id, session_turn FROM turns WHERE role = 'user'),
spots AS (SELECT q.session_id, q.session_turn AS question_turn,
  MAX(u.session_turn) FILTER (WHERE u.session_turn <= q.session_turn) AS before_turn,
  MIN(u.session_turn) FILTER (WHERE u.session_turn > q.session_turn) AS reply_turn
  FROM questions q LEFT JOIN user_turns u USING (session_id) GROUP BY q.session_id, q.session_turn),
firsts_scored AS (SELECT session_id, session_turn, variant, ARG_MIN(score, seq) AS score, ARG_MIN(task, seq) AS task,
  ARG_MIN(target_artifact, seq) AS target_artifact, ARG_MIN(success_criterion, seq) AS success_criterion,
  ARG_MIN(constraints, seq) AS constraints, ARG_MIN(environment_reproduction, seq) AS environment_reproduction,
  ARG_MIN(unresolved_unknowns, seq) AS unresolved_unknowns FROM scored GROUP BY session_id, session_turn, variant),
replies AS (SELECT s.session_id, s.question_turn, s.reply_turn, a.variant, b.score AS before_score, a.score AS after_score,
  a.score - b.score AS score_delta,
  concat_ws(',', CASE WHEN b.task = 'missing' AND a.task = 'present' THEN 'task' END,
    CASE WHEN b.target_artifact = 'missing' AND a.target_artifact = 'present' THEN 'target_artifact' END,
    CASE WHEN b.success_criterion = 'missing' AND a.success_criterion = 'present' THEN 'success_criterion' END,
    CASE WHEN b.constraints = 'missing' AND a.constraints = 'present' THEN 'constraints' END,
    CASE WHEN b.environment_reproduction = 'missing' AND a.environment_reproduction = 'present' THEN 'environment_reproduction' END) AS filled_slots,
  b.unresolved_unknowns = 'unresolved' AND a.unresolved_unknowns = 'not_applicable' AS resolved_unresolved_unknowns,
  CASE WHEN c.priced_cost_records > 0 THEN c.observed_billing_usd END AS reply_usd,
  COALESCE(c.cost_records, 0) AS reply_turn_cost_records, COALESCE(c.priced_cost_records, 0) AS reply_turn_priced_cost_records,
  o.completed, o.correct
  FROM spots s JOIN firsts_scored b ON b.session_id = s.session_id AND b.session_turn = s.before_turn
  JOIN firsts_scored a ON a.session_id = s.session_id AND a.session_turn = s.reply_turn AND a.variant = b.variant
  LEFT JOIN turn_costs c ON c.session_id = s.session_id AND c.session_turn = s.reply_turn
  LEFT JOIN outcomes o ON o.session_id = s.session_id)"""
oracle(
    "clarifications",
    REPORT, CLARIFY,
    "SELECT * EXCLUDE (reply_usd), ROUND(reply_usd, 6) AS reply_turn_observed_billing_usd FROM replies",
)
oracle(
    "clarification_summary",
    REPORT, CLARIFY,
    f"""SELECT (SELECT COUNT(*) FROM spots WHERE reply_turn IS NULL) AS unpaired_decision_turns,
      (SELECT COUNT(*) FROM spots WHERE before_turn IS NULL AND reply_turn IS NOT NULL) AS incomplete_readiness_pairs,
      0 AS legacy_records_excluded, COUNT(*) AS observations,
      ROUND({correlation('score_delta', 'reply_usd', 'reply_usd IS NOT NULL')}, 9) AS score_delta_reply_turn_cost_correlation,
      ROUND({correlation('score_delta', 'correct::INT::DOUBLE', 'correct IS NOT NULL')}, 9) AS score_delta_correctness_correlation FROM replies""",
)

# ------------------------------------------------------------------------------ repeats

oracle("drop_replays", with_(TOOLS), "SELECT session_id, seq, event_key, kind FROM tools")
LINKED = """
linked AS (SELECT * REPLACE (CASE WHEN kind = 'call' THEN call_key ELSE
  LAST_VALUE(call_key IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS call_key) FROM tools)"""
oracle("linked_results", with_(TOOLS, LINKED), "SELECT session_id, seq, call_key FROM linked WHERE kind = 'result'")
EXACT = """
exact AS (SELECT session_id, session_turn, COUNT(*) AS exact_repeated_tool_results,
  COUNT(*) FILTER (WHERE NOT wire_cheap) AS expensive_exact_repeated_tool_results,
  COUNT(*) FILTER (WHERE wire_cheap) AS wire_cheap_exact_repeated_tool_results
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, result_text ORDER BY seq) AS rn FROM tools WHERE kind = 'result')
  WHERE rn > 1 GROUP BY session_id, session_turn)"""
NEAR = """
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seq) AS p FROM tools WHERE kind = 'call'),
near_calls AS (SELECT DISTINCT c.session_id, c.seq, c.session_turn, c.tool FROM numbered c JOIN numbered b
  ON b.session_id = c.session_id AND b.p BETWEEN c.p - 128 AND c.p - 1 AND b.tool = c.tool
  WHERE list_sort(b.tokens) <> list_sort(c.tokens)
    AND len(list_intersect(b.tokens, c.tokens)) / len(list_distinct(list_concat(b.tokens, c.tokens))) >= 0.6)"""
CYCLES = """
edit_calls AS (SELECT session_id, seq, session_turn, call_key, LAG(seq) OVER (PARTITION BY session_id ORDER BY seq) AS prior
  FROM linked WHERE kind = 'call' AND is_edit),
edit_failures AS (SELECT r.session_id, r.seq FROM linked r JOIN edit_calls e ON e.session_id = r.session_id
  AND e.call_key = r.call_key AND e.seq < r.seq WHERE r.kind = 'result' AND r.failed),
cycles AS (SELECT DISTINCT e.session_id, e.seq, e.session_turn FROM edit_calls e JOIN edit_failures f
  ON f.session_id = e.session_id AND f.seq < e.seq AND f.seq > e.prior)"""
oracle("tool_repeats", with_(TOOLS, EXACT), "SELECT * FROM exact")
oracle("near_repeats", with_(TOOLS, NEAR), "SELECT * FROM near_calls")
oracle("edit_cycles", with_(TOOLS, LINKED, CYCLES), "SELECT * FROM cycles")
THRASH = with_(
    TOOLS, LINKED, EXACT, NEAR, CYCLES,
    """thrash AS (SELECT session_id, session_turn, COALESCE(exact_repeated_tool_results, 0) AS exact_repeated_tool_results,
          COALESCE(expensive_exact_repeated_tool_results, 0) AS expensive_exact_repeated_tool_results,
          COALESCE(wire_cheap_exact_repeated_tool_results, 0) AS wire_cheap_exact_repeated_tool_results,
          COALESCE(n, 0) AS near_repeated_tool_calls, COALESCE(k, 0) AS edit_fail_edit_cycles,
          COALESCE(exact_repeated_tool_results, 0) + COALESCE(n, 0) + COALESCE(k, 0) AS score
          FROM exact FULL JOIN (SELECT session_id, session_turn, COUNT(*) AS n FROM near_calls GROUP BY ALL) USING (session_id, session_turn)
          FULL JOIN (SELECT session_id, session_turn, COUNT(*) AS k FROM cycles GROUP BY ALL) USING (session_id, session_turn))""",
)
oracle("thrash_receipts", THRASH, "SELECT * FROM thrash")
oracle(
    "build_transcript",
    THRASH, f""", {TURNS}, {SPOKEN}, {findings("spoken", "seq", "content")},
    firsts AS (SELECT session_id, MIN(seq) AS seq FROM turns WHERE {STARTS} GROUP BY session_id),
    lint_counts AS (SELECT seq, COUNT(*) AS n FROM findings GROUP BY seq)
    SELECT t.session_id, t.session_turn, t.seq, role, strlen({no_final_newline(masked('content'))}) AS content_bytes,
      COALESCE(l.n, 0) AS findings,
      CASE WHEN role = 'assistant' AND h.session_id IS NOT NULL THEN 'thrash,terminal' WHEN role = 'assistant' THEN 'terminal'
        WHEN f.seq IS NOT NULL THEN 'readiness,readiness,advisory' ELSE 'readiness,readiness' END AS signals
    FROM turns t LEFT JOIN lint_counts l USING (seq) LEFT JOIN firsts f ON f.seq = t.seq
    LEFT JOIN thrash h ON h.session_id = t.session_id AND h.session_turn = t.session_turn""",
)
THRASH_FIELDS = (
    "score", "exact_repeated_tool_results", "expensive_exact_repeated_tool_results",
    "wire_cheap_exact_repeated_tool_results", "near_repeated_tool_calls", "edit_fail_edit_cycles",
)
oracle(
    "thrash_report",
    THRASH, f""", {COSTS}, {BILLED},
    everyone AS (SELECT session_id FROM thrash UNION SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT session_id, {', '.join(f'CAST(COALESCE(SUM({f}), 0) AS BIGINT) AS {f}' for f in THRASH_FIELDS)},
      ROUND(COALESCE(ANY_VALUE(usd), 0.0), 6) AS observed_billing_usd
    FROM everyone LEFT JOIN thrash USING (session_id) LEFT JOIN billed USING (session_id) GROUP BY session_id""",
)

# ----------------------------------------------------------------------------- sessions

RECENT = """
requests AS (SELECT conv_id * 2 + shorter AS request_id, conv_id, turn AS pos, role, text
  FROM conversations JOIN (SELECT conv_id, MAX(turn) AS last_turn FROM conversations GROUP BY conv_id) USING (conv_id),
    (VALUES (0), (1)) s(shorter)
  WHERE turn <= last_turn - shorter)"""
oracle(
    "stitched_sessions",
    """SELECT turn * 1000000 + conv_id AS request_id, conv_id AS expected_session,
      sha256(CAST(MIN(turn * 1000000 + conv_id) OVER (PARTITION BY conv_id) AS VARCHAR)) AS session_id,
      turn = MIN(turn) OVER (PARTITION BY conv_id) AS opened
    FROM conversations WHERE role = 'user'""",
)
oracle(
    "session_gaps",
    """WITH e AS (SELECT event_id, user_id % 20 AS k, CAST(FLOOR(epoch(ts)) AS BIGINT) AS secs FROM events),
    g AS (SELECT *, CASE WHEN secs - LAG(secs) OVER (PARTITION BY k ORDER BY event_id) <= 7200 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, SUM(fresh) OVER (PARTITION BY k ORDER BY event_id) AS run FROM g)
    SELECT event_id AS request_id, sha256(CAST(MIN(event_id) OVER (PARTITION BY k, run) AS VARCHAR)) AS session_id,
      fresh = 1 AS opened FROM s""",
)
oracle(
    "match_sessions",
    """WITH h AS (SELECT conv_id, list(role || ':' || CASE WHEN turn < conv_id % 3 THEN CAST(conv_id % 7 AS VARCHAR) ELSE text END ORDER BY turn) AS history FROM conversations GROUP BY conv_id),
    pairs AS (SELECT a.conv_id AS request_id, b.conv_id AS other,
      (SELECT MAX(k) FROM range(1, LEAST(len(a.history), len(b.history)) + 1) t(k) WHERE a.history[1:k] = b.history[1:k]) AS common
      FROM h a JOIN h b ON b.conv_id % 2 = 0),
    best AS (SELECT request_id, MAX(common) AS longest FROM pairs GROUP BY request_id),
    won AS (SELECT request_id, COUNT(*) AS n, MIN(other) AS other FROM pairs JOIN best USING (request_id) WHERE common = longest GROUP BY request_id)
    SELECT conv_id AS request_id, CASE WHEN n = 1 THEN CAST(other AS VARCHAR) END AS session_id, COALESCE(n > 1, FALSE) AS collision
    FROM h LEFT JOIN won ON request_id = conv_id""",
)
oracle(
    "live_sessions",
    with_(COSTS),
    """SELECT session_id, MAX(recorded_at_secs) AS last_access_secs FROM costs GROUP BY session_id
    HAVING (SELECT MAX(recorded_at_secs) FROM costs) - MAX(recorded_at_secs) <= 86400
    ORDER BY last_access_secs DESC, session_id DESC LIMIT 1024""",
)
oracle(
    "number_turns",
    with_(COSTS),
    "SELECT session_id, seq, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seq) AS session_turn FROM costs",
)
oracle(
    "conversation_start",
    with_(RECENT),
    """SELECT request_id, COUNT(*) FILTER (WHERE role = 'user') = 1
      AND COUNT(*) FILTER (WHERE role = 'assistant') = 0 AS conversation_start FROM requests GROUP BY request_id""",
)
oracle(
    "last_user_text",
    with_(RECENT),
    f"""SELECT request_id, text FROM (SELECT request_id, conv_id, ARG_MAX(role, pos) AS role, ARG_MAX(text, pos) AS text
      FROM requests GROUP BY request_id, conv_id)
    WHERE role = 'user' AND (CASE WHEN conv_id % 2 = 0 THEN conv_id % 3 <> 1 ELSE {strip('text')} <> '' END)""",
)

# ----------------------------------------------------------------------------- payloads

TURN_KEYS = """
keys AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider,
  conv_id, turn, CAST(turn AS VARCHAR) AS t, role AS said, text FROM conversations)"""
oracle(
    "request_messages",
    with_(TURN_KEYS),
    """SELECT request_id, provider, pos, role, text, is_plain_text FROM (
      SELECT request_id, provider, 0 AS pos, 'system' AS role,
        CASE WHEN turn % 3 = 0 THEN '[local]' || chr(10) || 'be exact' ELSE 'be exact' END AS text, TRUE AS is_plain_text FROM keys WHERE provider = 'openai'
      UNION ALL SELECT request_id, provider, 1, 'user', text, TRUE FROM keys WHERE provider = 'openai'
      UNION ALL SELECT request_id, provider, 2, 'assistant', NULL, FALSE FROM keys WHERE provider = 'openai'
      UNION ALL SELECT request_id, provider, 3, 'tool', CASE WHEN turn % 2 = 0 THEN '{"ok":false}' ELSE 'fine' END, TRUE FROM keys WHERE provider = 'openai'
      UNION ALL SELECT request_id, provider, 0, 'user', text || chr(10) || 'and more', FALSE FROM keys WHERE provider = 'anthropic'
      UNION ALL SELECT request_id, provider, 1, 'assistant', '', FALSE FROM keys WHERE provider = 'anthropic'
      UNION ALL SELECT request_id, provider, 2, 'user', '', FALSE FROM keys WHERE provider = 'anthropic')""",
)
oracle(
    "request_blocks",
    with_(TURN_KEYS),
    """SELECT request_id, pos, block, role, type, text FROM (
      SELECT request_id, 0 AS pos, 0 AS block, 'user' AS role, 'text' AS type, text FROM keys WHERE provider = 'anthropic'
      UNION ALL SELECT request_id, 0, 1, 'user', 'text', 'and more' FROM keys WHERE provider = 'anthropic'
      UNION ALL SELECT request_id, 1, 0, 'assistant', 'tool_use', NULL FROM keys WHERE provider = 'anthropic'
      UNION ALL SELECT request_id, 2, 0, 'user', 'tool_result', NULL FROM keys WHERE provider = 'anthropic')""",
)


def opaque(*parts: str) -> str:
    return "sha256(" + " || ".join(f"{p} || chr(0)" for p in parts) + ")"


def hashed(tokens: str) -> str:
    key = opaque("'tool-token'", "k")
    return f"array_to_string(list_transform(list_sort(list_distinct({tokens})), lambda k: {key}), ',')"


OPENAI_NAME = "CASE WHEN turn % 2 = 0 THEN 'edit_file' ELSE 'search' END"
BLOCK_NAME = "CASE WHEN turn % 2 = 0 THEN 'apply_patch' ELSE 'grep' END"
oracle(
    "tool_events",
    with_(TURN_KEYS),
    f"""SELECT request_id, provider, 2 AS pos, 0 AS block, 'call' AS kind, {opaque("'openai'", "'call'", "'2'", "'0'")} AS event_key,
      {opaque("'openai'", "'call-link'", "'c' || t")} AS call_key, {opaque("'openai-tool'", OPENAI_NAME)} AS tool,
      {hashed(f"['name:' || {OPENAI_NAME}, 'key:path', 'value:src', 'value:k' || t, 'value:rs', 'key:n', 'number:' || t, 'key:deep', 'key:on', 'bool:true']")} AS tokens,
      turn % 2 = 0 AS is_edit, NULL AS digest, FALSE AS failed FROM keys WHERE provider = 'openai'
    UNION ALL SELECT request_id, provider, 3, 0, 'result', {opaque("'openai'", "'result'", "'3'", "''")},
      {opaque("'openai'", "'call-link'", "'c' || t")}, NULL, NULL, FALSE,
      sha256(CASE WHEN turn % 2 = 0 THEN '{{"ok":false}}' ELSE 'fine' END), turn % 2 = 0 FROM keys WHERE provider = 'openai'
    UNION ALL SELECT request_id, provider, 1, 0, 'call', {opaque("'anthropic'", "'call'", "'1'", "'0'")},
      {opaque("'anthropic'", "'call-link'", "'u' || t")}, {opaque("'anthropic-tool'", BLOCK_NAME)},
      {hashed(f"['name:' || {BLOCK_NAME}, 'key:query', 'value:' || said, 'value:k' || t]")},
      turn % 2 = 0, NULL, FALSE FROM keys WHERE provider = 'anthropic'
    UNION ALL SELECT request_id, provider, 2, 0, 'result', {opaque("'anthropic'", "'result'", "'2'", "'0'")},
      {opaque("'anthropic'", "'call-link'", "'u' || t")}, NULL, NULL, FALSE, sha256('out ' || CAST(turn % 3 AS VARCHAR)), turn % 2 = 0
      FROM keys WHERE provider = 'anthropic'""",
)
HISTORY = """
fresh AS (SELECT sha256(CAST(conv_id * 2 AS VARCHAR)) AS session_id, CASE WHEN turn <= last_turn // 2 THEN 1 ELSE 2 END AS session_turn, turn
  FROM conversations JOIN (SELECT conv_id, MAX(turn) AS last_turn FROM conversations GROUP BY conv_id) USING (conv_id))"""
oracle(
    "session_events",
    with_(HISTORY),
    """SELECT session_id, session_turn, kind, COUNT(*) AS events, COUNT(*) AS places,
      COUNT(*) FILTER (WHERE kind = 'result' AND turn % 3 = 0) AS cheap,
      MAX(CASE WHEN kind = 'result' THEN sha256('out ' || CAST(turn % 3 AS VARCHAR)) END) AS last_digest
    FROM fresh, (SELECT UNNEST(['call', 'result']) AS kind) GROUP BY session_id, session_turn, kind""",
)
oracle(
    "request_thrash",
    with_(
        HISTORY,
        "seen AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, turn % 3 ORDER BY turn) > 1 AS again FROM fresh)",
    ),
    """SELECT session_id, session_turn, COUNT(*) FILTER (WHERE again) AS exact_repeated_tool_results,
      COUNT(*) FILTER (WHERE again AND turn % 3 = 0) AS wire_cheap_exact_repeated_tool_results, 0 AS near_repeated_tool_calls,
      0 AS edit_fail_edit_cycles, COUNT(*) FILTER (WHERE again) AS score FROM seen GROUP BY session_id, session_turn HAVING bool_or(again)""",
)
oracle(
    "cache_slots",
    with_(TURN_KEYS),
    """SELECT 'm' || CAST(conv_id % 4 AS VARCHAR) AS model, COUNT(*) AS requests,
      CAST(SUM(used) AS BIGINT) AS breakpoints,
      COUNT(*) FILTER (WHERE provider = 'anthropic' AND used < 4 AND turn % 4 <> 1) AS can_place
    FROM (SELECT *, CASE WHEN provider = 'anthropic' THEN 1 + turn % 4 + (turn % 4 = 1)::INT ELSE 0 END AS used FROM keys) GROUP BY 1""",
)
oracle(
    "constraint_coverage",
    with_(TURN_KEYS),
    """SELECT provider, COUNT(*) AS requests, COUNT(*) FILTER (WHERE turn % 3 = 0) AS covered,
      ROUND(AVG((turn % 3 = 0)::INT::DOUBLE), 9) AS coverage FROM keys GROUP BY provider""",
)

# --------------------------------------------------------------------------- evaluation

RUNS = """
runs AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'skill_off' ELSE 'skill_on' END AS arm,
  CASE WHEN seq % 31 = 0 THEN NULL ELSE input_tokens + output_tokens END AS tokens, observed_billing_usd AS estimated_cost FROM costs)"""
oracle(
    "paired_summary",
    with_(COSTS, RUNS),
    """SELECT arm, COUNT(*) AS runs, ROUND(SUM(estimated_cost), 6) AS total_estimated_cost,
      ROUND(quantile_cont(tokens, 0.5), 6) AS median_tokens FROM runs GROUP BY arm""",
)
oracle(
    "bootstrap_ci",
    with_(COSTS, RUNS),
    """SELECT arm, COUNT(*) AS runs, COUNT(tokens) AS n, ROUND(quantile_cont(tokens, 0.5), 6) AS median_tokens,
      TRUE AS low_in_band, TRUE AS high_in_band FROM runs GROUP BY arm""",
)
oracle(
    "token_percentiles",
    with_(COSTS, RUNS),
    """SELECT arm, ROUND(quantile_cont(tokens, 0.025), 6) AS p025, ROUND(quantile_cont(tokens, 0.975), 6) AS p975
    FROM runs GROUP BY arm""",
)
COVERED = """
answers AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'blockers' ELSE 'scope' END AS case_id,
  CASE WHEN seq % 2 = 0 THEN 'baseline' ELSE 'skill' END AS arm,
  CASE seq % 3 WHEN 0 THEN ['name', 'count'] WHEN 1 THEN ['dependency'] ELSE ['scope', 'options'] END AS terms FROM spoken),
covered AS (SELECT *, len(terms) AS required_terms, len(list_filter(terms, lambda v: contains(lower(content), v))) AS required_found,
  len(regexp_extract_all(content, '(?m)^[ \\t]*(?:[§!>~]|-#?[ \\t]|[0-9]+[.)][ \\t])')) AS structure_lines FROM answers)"""
oracle(
    "term_coverage",
    with_(TURNS, SPOKEN, COVERED),
    """SELECT seq, case_id, required_terms, required_found, structure_lines, required_terms = required_found AS quality_floor_passed FROM covered""",
)
oracle(
    "coverage_summary",
    with_(TURNS, SPOKEN, COVERED),
    """SELECT case_id, arm, COUNT(*) AS runs, CAST(SUM(100 + seq % 50) AS BIGINT) AS prompt_tokens,
      CAST(SUM(10 + seq % 20) AS BIGINT) AS output_tokens, ROUND(SUM((seq % 7)::DOUBLE / 1000.0), 6) AS estimated_billing_usd,
      COUNT(*) FILTER (WHERE required_terms = required_found) AS passed, CAST(SUM(structure_lines) AS BIGINT) AS structure_lines
    FROM covered GROUP BY case_id, arm""",
)
oracle(
    "budget_cutoff",
    with_(
        COSTS,
        """spent AS (SELECT seq, model AS run, SUM(COALESCE(observed_billing_usd, 0.0)) OVER (PARTITION BY model ORDER BY seq) AS usd FROM costs)""",
    ),
    """SELECT run, MIN(seq) FILTER (WHERE usd > 1.0) AS cutoff_seq, COUNT(*) FILTER (WHERE usd <= 1.0) AS runs_within_cap,
      ROUND(MAX(usd) FILTER (WHERE usd <= 1.0), 6) AS spent_within_cap FROM spent GROUP BY run""",
)
oracle(
    "cost_ledger",
    with_(COSTS),
    """SELECT provider, model, COUNT(*) AS records, ROUND(SUM(observed_billing_usd), 6) AS usd,
      CAST(SUM(input_tokens) AS BIGINT) AS input_tokens FROM costs WHERE seq % 10 <> 0 GROUP BY provider, model""",
)

oracle(
    "ledger_order",
    with_(COSTS),
    """SELECT session_id, model, COUNT(*) AS records, arg_min(recorded_at_secs, seq) AS first_secs, arg_min(input_tokens, seq) AS first_input,
      arg_max(recorded_at_secs, seq) AS last_secs, arg_max(input_tokens, seq) AS last_input FROM costs GROUP BY session_id, model""",
)
oracle(
    "transcript_ledger",
    with_(TURNS),
    """SELECT session_id, COUNT(*) AS turns, CAST(SUM(strlen(content)) AS BIGINT) AS bytes, CAST(MIN(seq) AS VARCHAR) AS first,
      CAST(MAX(seq) AS VARCHAR) AS last, 0 AS notes FROM turns GROUP BY session_id""",
)
oracle(
    "health_ledger",
    with_(COSTS),
    """SELECT provider, model, COUNT(*) AS records, CAST(SUM(seq % 5) AS BIGINT) AS text_responses,
      CAST(SUM(CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 2 END) AS BIGINT) AS table_runs, 0 AS zero_sigil_responses,
      arg_max(session_id, seq) AS last_session FROM costs WHERE seq % 10 <> 0 GROUP BY provider, model""",
)
oracle(
    "label_ledger",
    """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, (conv_id % 3 = 0) <> (conv_id % 2 = 0) AS completed,
      (conv_id % 4 = 0) <> (conv_id % 2 = 0) AS correct FROM conversations""",
)
oracle(
    "served_ledger",
    with_(SERVED),
    """SELECT digest, COUNT(*) AS entries, MAX(served_at_secs) AS last_served FROM served
    WHERE served_at_secs IS NULL OR served_at_secs <> 999900 GROUP BY digest""",
)

oracle(
    "receipt_ledger",
    """SELECT lang AS transform, COUNT(*) AS receipts, CAST(SUM(strlen(COALESCE(text, ''))) AS BIGINT) AS original_bytes,
      arg_min(sha256(COALESCE(text, '')), doc_id) AS first_digest, MAX(doc_id) AS last_secs FROM documents WHERE doc_id % 10 <> 0 GROUP BY lang""",
)
oracle(
    "eval_case_files",
    """WITH terms AS (SELECT doc_id, text, lang, [upper(lang), 'the', source] AS terms FROM documents),
      held AS (SELECT *, len(list_filter(terms, lambda t: contains(lower(COALESCE(text, '')), lower(t)))) AS found FROM terms)
    SELECT 'case-' || doc_id AS case_id, len(terms) AS required_terms, found AS required_found, found = len(terms) AS quality_floor_passed,
      substring(text, 1, 40) AS prompt, 'in ' || lang AS expected_structure FROM held""",
)
oracle(
    "eval_corpus_files",
    """WITH sized AS (SELECT *, 'v' || (COUNT(*) OVER (PARTITION BY doc_id // 200)) % 7 AS corpus_version FROM documents)
    SELECT corpus_version, lang AS expected_outcome, COUNT(*) AS tasks, COUNT(source) FILTER (WHERE doc_id % 3 > 0) AS classified,
      CAST(SUM(strlen(text)) AS BIGINT) AS prompt_bytes, MIN('task-' || doc_id) AS first_id FROM sized GROUP BY corpus_version, lang""",
)
oracle(
    "priced_ledger",
    with_(COSTS),
    """SELECT provider, model, COUNT(*) AS records, COUNT(usd) AS priced, ROUND(SUM(usd), 6)::DOUBLE AS usd FROM (SELECT provider, model, CASE provider
      WHEN 'openai' THEN input_tokens * 2.5 + output_tokens * 10.0 + (COALESCE(cache_read_tokens, 0) + COALESCE(cache_creation_tokens, 0)) * 2.5
      WHEN 'anthropic' THEN input_tokens * 3.0 + output_tokens * 15.0 + COALESCE(cache_read_tokens, 0) * 3.0 + COALESCE(cache_creation_tokens, 0) * 3.75
      END / 1000000.0 AS usd FROM costs) GROUP BY provider, model""",
)

# ---------------------------------------------------------------------------- streaming

oracle(
    "cost_burn_stream",
    with_(COSTS),
    """SELECT window_start, session_id, COUNT(*) AS priced_turns, ROUND(SUM(GREATEST(observed_billing_usd, 0)), 6) AS observed_billing_usd
    FROM (SELECT *, UNNEST(list_transform(range(0, 12), lambda i: recorded_at_secs // 300 * 300 - i * 300)) AS window_start
      FROM costs WHERE observed_billing_usd IS NOT NULL)
    GROUP BY window_start, session_id""",
)
oracle(
    "health_stream",
    with_(TURNS, SPOKEN, counters("spoken", "seq", "content")),
    f"""SELECT seq // 1000 * 60 // 3600 * 3600 AS window_start, provider, model, {sums(*COUNTERS.split(', '))}
    FROM counted GROUP BY ALL""",
)
oracle(
    "session_stream",
    """SELECT MIN(turn * 600 + conv_id * 100000) AS started, COUNT(*) AS requests,
      MIN(turn * 1000000 + conv_id) AS first_seq
    FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
oracle(
    "assembled_stream",
    with_(TURNS, SPOKEN, RENDERED),
    "SELECT seq AS stream_id, content, rendered FROM rendered WHERE content <> ''",
)
oracle("thrash_stream", ORACLES["thrash_receipts"])
oracle("stitch_stream", ORACLES["stitched_sessions"])
oracle(
    "cost_burn_medians_stream",
    with_(
        COSTS,
        """active AS (SELECT session_id, GREATEST(observed_billing_usd, 0) AS price,
              UNNEST(list_transform(range(0, 12), lambda i: recorded_at_secs // 300 * 300 - i * 300)) AS window_start
            FROM costs WHERE observed_billing_usd IS NOT NULL)""",
        "per AS (SELECT window_start, session_id, SUM(price) AS total, quantile_disc(price, 0.5) AS median FROM active GROUP BY ALL)",
        "mid AS (SELECT window_start, quantile_disc(total, 0.5) AS m FROM per GROUP BY ALL)",
    ),
    """SELECT window_start, COUNT(*) AS active_cost_sessions, ROUND(MAX(m), 6) AS session_median_observed_billing_usd,
      COUNT(*) FILTER (WHERE m > 0 AND ROUND(total, 9) > ROUND(m * 3.0, 9)) AS sessions_above_three_x_median,
      ROUND(SUM(median), 6) AS next_turn_estimated_billing_usd, ROUND(SUM(total) + SUM(median), 6) AS projected_billing_after_next_turn_usd
    FROM per JOIN mid USING (window_start) GROUP BY window_start""",
)
oracle(
    "late_rows_stream",
    """WITH base AS (SELECT event_id, CAST(FLOOR(epoch(ts)) AS BIGINT) AS secs FROM events), sent AS (
      SELECT event_id, CASE WHEN event_id % 50 = 0 THEN secs - 40 * 86400 WHEN event_id % 70 = 0 THEN secs + 4000 * 86400 ELSE secs END AS secs,
        (SELECT MAX(secs) FROM base) AS now,
        LEAST(FLOOR((event_id - (SELECT MIN(event_id) FROM base)) / ((SELECT MAX(event_id) - MIN(event_id) FROM base) + 1e-9) * 3), 2) AS part
      FROM base),
    marks AS (SELECT p.part, MAX(s.secs) AS mark FROM (SELECT DISTINCT part FROM sent) p LEFT JOIN sent s ON s.part < p.part AND s.secs <= s.now GROUP BY p.part)
    SELECT event_id, secs, CASE WHEN secs > now THEN 'future' WHEN secs < mark - 30 * 86400 THEN 'late' ELSE 'kept' END AS fate
    FROM sent JOIN marks USING (part)""",
)
oracle(
    "replay_stream",
    """SELECT CAST(user_id AS VARCHAR) AS session_id, COUNT(*) AS events, CAST(SUM(event_id) AS BIGINT) AS event_sum
    FROM events GROUP BY user_id""",
)
oracle("retain_stream", ORACLES["retain_served"])
oracle("ledger_stream", ORACLES["cost_ledger"])

"""SQL of the manifest, the mix and the clusters: levels and rounds are written out one by one."""

from __future__ import annotations

from convlytics.llm import centroids, merkle, mixing

#: CRC-32 of the decimal id: bits shifted out through the reversed polynomial.
_CRC = """
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split_regex(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
        list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in columns) + ")"


def _tree(name: str, leaves: str, key: str, levels: int) -> list[str]:
    """CTEs of the levels of one tree per ``key``: place, node, the run it came from, whether it is one level up."""
    out = [f"{name}0 AS (SELECT {key} AS k, pos, node, '' AS run, false AS up FROM {leaves})"]
    for i in range(levels):
        out.append(f"""{name}{i + 1} AS (
            SELECT k, pos // {merkle.FANOUT} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node,
                string_agg(node, '' ORDER BY pos) AS run, any_value(n) > 1 AS up
            FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {name}{i}) GROUP BY k, pos // {merkle.FANOUT})""")
    return out


def _climb(name: str, start: str, key: str, levels: int) -> list[str]:
    """CTEs that take every row of ``start`` up a tree: node as claimed, siblings so far."""
    out, last = [], start
    for i in range(levels):
        at = f"64 * (p.pos // {merkle.FANOUT**i} % {merkle.FANOUT})"
        before, after = f"substr(t.run, 1, {at})", f"substr(t.run, {at} + 65)"
        out.append(f"""{name}_up{i + 1} AS (
            SELECT p.* EXCLUDE (folded, proof), CASE WHEN t.up THEN sha256({before} || folded || {after}) ELSE folded END AS folded,
                CASE WHEN t.up THEN proof || {before} || {after} ELSE proof END AS proof
            FROM {last} p JOIN {name}{i + 1} t ON t.k IS NOT DISTINCT FROM {key} AND t.pos = p.pos // {merkle.FANOUT ** (i + 1)})""")
        last = f"{name}_up{i + 1}"
    return out


def manifest_sql(levels: int = 5, top: int = 3) -> str:
    """Trees of up to ``16 ** levels`` leaves a source and ``16 ** top`` sources."""
    parts = [
        f"rows AS (SELECT doc_id, source, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf, {_leaf('doc_id', 'source', 'lang', 'n_chars', _LOWER)} AS lowered, {_CRC} AS crc FROM documents)",
        """leaves AS (SELECT *, leaf AS node, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS folded, '' AS proof,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows)""",
        *_tree("t", "leaves", "source", levels),
        f"subs AS (SELECT k AS source, node, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos FROM t{levels})",
        *_tree("u", "subs", "0", top),
        *_climb("t", "leaves", "p.source", levels),
        f"""met AS (SELECT p.doc_id, p.leaf, p.folded, p.proof, s.node AS subroot, s.pos FROM t_up{levels} p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source)""",
        *_climb("u", "met", "0", top),
    ]
    return f"""
        WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.node AS verified
        FROM u_up{top} CROSS JOIN u{top} u"""


def mix_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('{mixing.SEED}:' || doc_id) AS key FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM sized GROUP BY source
        ), lines AS (
            SELECT *, {mixing.SHARE}::DOUBLE * sum(source_size) OVER ()
                - {mixing.MOST} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS by_weight
            FROM sources
        ), filled AS (SELECT *, rest * weight / by_weight > {mixing.MOST} * source_size AS full_ FROM lines),
        shared AS (
            SELECT {mixing.SHARE}::DOUBLE * sum(source_size) - {mixing.MOST} * coalesce(sum(source_size) FILTER (full_), 0) AS rest, sum(weight) FILTER (NOT full_) AS by_weight FROM filled
        ), targets AS (
            SELECT source, source_size, CASE WHEN full_ THEN ({mixing.MOST} * source_size)::DOUBLE ELSE s.rest * weight / s.by_weight END AS target FROM filled CROSS JOIN shared s
        ), placed AS (
            SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota,
                sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
            FROM sized d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
        )
        SELECT doc_id, size, source_size, target,
            CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + least(size, greatest(0, quota % source_size - before)) END::BIGINT AS taken
        FROM placed"""


def clusters_sql() -> str:
    k, dim = centroids.CLUSTERS, centroids.DIM
    far = "list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, {0})])".format(dim + 1)
    floored = "(s - (s % n + n) % n) // n"
    parts = [
        f"""vectors AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}' || vec_id)) - 1 AS cluster, v AS c FROM vectors ORDER BY 1 LIMIT {k})",
    ]
    for r in range(centroids.ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, any_value(v.v) AS v, arg_min(c.cluster, ({far}) * {k} + c.cluster) AS cluster, min({far}) AS distance FROM vectors v CROSS JOIN c{r} c GROUP BY vec_id)""")
        if r < centroids.ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
                    SELECT cluster, list(CAST({floored} AS BIGINT) ORDER BY i) AS c FROM (
                        SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster
                ) m ON m.cluster = c.cluster)""")
    last = centroids.ROUNDS
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, a.cluster::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
            sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{last} a JOIN c{last} c ON c.cluster = a.cluster"""

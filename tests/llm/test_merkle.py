import hashlib
import random

import pytest
from pyspark.sql import functions as F

from convlytics.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """Root and the siblings of every node, by lists."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, a in enumerate(at):
            run, j = runs[a // fanout], a % fanout
            ways[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[i] = a // fanout
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], ways


def brute(rows, fanout):
    """Rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, way)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in sources:
        by_source[s].sort()
        subs.append(climb([x[2] for x in by_source[s]], fanout))
    root, tops = climb([x[0] for x in subs], fanout)
    out = []
    for s, (sub, ways), top in zip(sources, subs, tops, strict=True):
        out += [(i if known else None, digest, sub, root, way + top) for (known, i, digest), way in zip(by_source[s], ways, strict=True)]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(16, 2), (3, 1), (2, 2), (4, 1)])
def test_every_size_of_tree(spark, fanout, levels):
    dice = random.Random(fanout)
    sizes = {None: 1, "": 2, "a": 3, "é": 4, "zz": 9, "Z": 10, "日": 28, "b": 83, "hot": 300}
    rows = [(None if dice.random() < 0.02 else dice.randrange(10**6), s, None if dice.random() < 0.2 else "en", n, f"Text {dice.random()} é") for s, n in sizes.items() for _ in range(n)]
    dice.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    proofs = merkle.manifest(frame, fanout=fanout, levels=levels)
    want = brute(rows, fanout)
    assert found(proofs) == want
    checks = proofs.select(merkle.folded(F.col("leaf"), F.col("proof")).alias("up"), "root", merkle.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof")).alias("wrong")).collect()
    assert all(r.up == r.root and r.wrong != r.root for r in checks)
    digests = sorted(r.d for r in proofs.select(merkle.proof_digest(F.col("proof")).alias("d")).collect())
    assert digests == sorted(sha("".join(a + b for a, b in w[4])) for w in want)


def test_a_lone_row_is_the_root(spark):
    row = merkle.manifest(spark.createDataFrame([(7, "s", "en", 1, "x")], "doc_id bigint, source string, lang string, n_chars bigint, text string")).first()
    assert row.leaf == row.subroot == row.root == leaf(7, "s", "en", 1, "x") and row.proof == []


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    proofs = merkle.manifest(awkward, also={"claimed": F.upper("text")})
    assert found(proofs) == brute(rows, 16)
    assert {r.claimed for r in proofs.collect()} == {r[4].upper() if r[4] is not None else None for r in rows}


def test_nothing(nothing):
    assert merkle.manifest(nothing).collect() == []

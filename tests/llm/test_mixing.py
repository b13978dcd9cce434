import itertools
import random

import pytest
from pyspark.sql import functions as F

from convlytics.llm import mixing


def filled(sizes, weights, share=1.5, most=2):
    """Targets by sharing again, round by round."""
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        by = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / by for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not more:
            return target
        full |= more


def weighed(sources):
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def by_source(docs):
    sizes = {}
    for _, members, text in docs:
        for m in dict.fromkeys(members or ()):
            sizes[m] = sizes.get(m, 0) + len((text or "").split(" ") if text else [])
    return sizes


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, members array<string>, text string").repartition(4)


def test_single_sources(spark):
    dice = random.Random(3)
    docs = [(i, [dice.choice(["a", "b", "c", None, "Z", "hot", "hot", "hot"])], " ".join("w" * dice.randrange(1, 40))) for i in range(600)]
    mixed, quotas = mixing.mix(frame(spark, docs), F.col("members"))
    sizes = by_source(docs)
    want = filled(sizes, weighed(sizes))
    assert {r.source: (r.source_size, r.target) for r in quotas.collect()} == {s: (sizes[s], pytest.approx(want[s])) for s in sizes}
    taken, rows = {}, mixed.collect()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and [u.source for u in r.uses] == list(r.sources) * (r.taken > 0)
        taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken
    assert taken == {s: int(want[s]) for s in sizes}
    part = [r for r in rows if r.size and r.taken % r.size]
    assert len({r.sources[0] for r in part}) == len(part)  # one boundary document a source
    again, _ = mixing.mix(frame(spark, docs[::-1]).repartition(7), F.col("members"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def least_cost(words, members, quota, most):
    """Best (flow, cost) by trying all integer flows."""
    ranges = [range(min(most * w, sum(quota[s] for s in m)) + 1) for w, m in zip(words, members, strict=True)]

    def fits(amounts):
        for some in itertools.chain.from_iterable(itertools.combinations(range(len(words)), n) for n in range(1, len(words) + 1)):
            if sum(amounts[p] for p in some) > sum(quota[s] for s in {s for p in some for s in members[p]}):
                return False
        return True

    best = None
    for amounts in itertools.product(*ranges):
        if fits(amounts):
            cost = sum(sum(max(0, min(w, a - r * w)) * r for r in range(most)) for a, w in zip(amounts, words, strict=True) if w)
            best = max(best or (0, 0), (sum(amounts), -cost))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_the_cheapest_maximum(seed):
    dice = random.Random(seed)
    sources = list(range(dice.randrange(1, 4)))
    members = [sorted(dice.sample(sources, dice.randrange(1, len(sources) + 1))) for _ in range(dice.randrange(1, 5))]
    words = [dice.randrange(0, 5) for _ in members]
    quota = {s: dice.randrange(0, 9) for s in sources}
    flows = mixing.Flow(words, members, quota).solve(2)
    for s in sources:
        assert sum(f.get(s, 0) for f in flows) <= quota[s]
    amounts = [sum(f.values()) for f in flows]
    assert all(v >= 0 for f in flows for v in f.values()) and all(a <= 2 * w for a, w in zip(amounts, words, strict=True))
    cost = sum(max(0, a - w) for a, w in zip(amounts, words, strict=True))
    assert (sum(amounts), -cost) == least_cost(words, members, quota, 2)


def test_overlapping_sources(spark):
    dice = random.Random(5)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["d"], ["d", "e"], ["e", None]]
    docs = [(i, dice.choice(kinds), " ".join("w" * dice.randrange(1, 30))) for i in range(500)]
    mixed, quotas = mixing.mix(frame(spark, docs), F.col("members"))
    target = {r.source: r.target for r in quotas.collect()}
    got = dict.fromkeys(target, 0)
    for r in mixed.collect():
        assert r.taken == sum(u.words for u in r.uses) <= 2 * r.size and {u.source for u in r.uses} <= set(r.sources)
        for u in r.uses:
            got[u.source] += u.words
    total = sum(len(t.split(" ")) for _, _, t in docs)
    assert all(got[s] <= target[s] for s in target)
    assert sum(got.values()) >= min(1.5 * total, sum(target.values())) - len(target)


def test_ties_share_the_boundary(spark):
    docs = [(1, ["a"], "w w w w")] * 4 + [(None, ["a"], "x y")] * 3 + [(2, ["b"], "z " * 40 + "z")]
    mixed, quotas = mixing.mix(frame(spark, docs), F.col("members"))
    target = {r.source: r.target for r in quotas.collect()}
    rows = mixed.collect()
    taken = sum(r.taken for r in rows if r.sources == ["a"])
    assert target["a"] - 8 <= taken <= target["a"]
    assert len({r.taken for r in rows if r.doc_id == 1}) == 1


def test_awkward_rows(spark, awkward):
    mixed, quotas = mixing.mix(awkward, F.array("source"))
    rows = mixed.collect()
    assert len(rows) == awkward.count() and quotas.count() == 1
    size = sum(r.size for r in rows)
    assert quotas.first().target == 1.5 * size
    assert 1.5 * size - 10 <= sum(r.taken for r in rows) <= 1.5 * size
    none, _ = mixing.mix(awkward, F.lit(None).cast("array<string>"))
    assert {r.taken for r in none.collect()} == {0}


def test_no_words(spark, nothing):
    mixed, quotas = mixing.mix(nothing, F.array("source"))
    assert mixed.collect() == [] and quotas.collect() == []
    mixed, quotas = mixing.mix(frame(spark, [(1, ["a"], ""), (2, ["b"], None)]), F.col("members"))
    assert [r.taken for r in mixed.collect()] == [0, 0] and [r.target for r in quotas.collect()] == [0, 0]

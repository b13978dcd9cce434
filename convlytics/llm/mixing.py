"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources.  Documents are aggregated by the set of their sources
(the pattern), so the flow network has one node per pattern and one per source, not per document:

* quotas: every source gets its share of the budget by weight, at most ``most`` times its own
  size; what a full source leaves is shared again by weight,
* flow: a pattern's tokens go to the quotas of its sources.  Using them for the r-th time costs
  more than for the (r - 1)-th, and the flow of the least cost is found by shortest augmenting
  paths, one blocking flow per level of cost.  Sources that share no document are networks of
  their own and are solved in different tasks,
* selection: documents of a pattern are in the order of a seeded hash; whole rounds take every
  document, the last one those up to a boundary.  The boundary is found by refining hash prefixes,
  each step an aggregate of at most 4,096 rows per boundary, so no task ever sorts a pattern.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.llm.common import cut
from convlytics.llm.components import components
from convlytics.llm.ranks import met, numbered

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 3  # of the hash, per refinement


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(patterns: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, place, source_size, target``; weights go round in code point order, NULL last.

    Each round shares what full sources leave among the others; it is one sum over the sources.
    """
    total = patterns.agg(F.sum("words")).first()[0] or 0
    sizes = patterns.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    placed = numbered(sizes, [], [F.col("source").isNull(), "source"], "place", "__n").drop("__n")
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")].cast("long")
    rows = cut(placed.withColumns({"weight": weight, "room": (F.col("source_size") * most).cast("double")}), "quotas")
    left, by, full = share * total, None, F.lit(False)
    while True:
        now = rows.agg(F.sum(F.when(full, F.col("room"))).alias("room"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if now.n == by:
            return rows.select("source", "place", "source_size", F.when(full, F.col("room")).otherwise(target).alias("target"))
        by, left = now.n, share * total - (now.room or 0.0)
        target = F.lit(left) * F.col("weight") / F.lit(float(now.weight or 1))
        full = full | (target > F.col("room"))


class Flow:
    """Maximum flow of least cost from patterns to quotas, all tokens of a level costing the same.

    Costs grow with each use (they are convex), so the cheapest augmenting paths come level by
    level; within one level shortest paths are filled until none is left.
    """

    def __init__(self, words: list[int], members: list[list[int]], quota: dict[int, int]):
        self.words, self.members = words, members
        self.open = dict(quota)
        self.flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
        self.users: dict[int, list[int]] = {s: [] for s in quota}
        for p, sources in enumerate(members):
            for s in sources:
                self.users[s].append(p)

    def solve(self, most: int) -> list[dict[int, int]]:
        for _ in range(most):  # the uses of a token, by rising cost
            self._fill(list(self.words))
        return self.flow

    def _fill(self, room: list[int]) -> None:
        while True:
            level = self._levels(room)
            if level is None:
                return
            dead: set[tuple[str, int]] = set()
            for p in range(len(room)):
                while room[p] and ("p", p) in level and ("p", p) not in dead:
                    if not (moved := self._push(p, room[p], level, dead)):
                        break
                    room[p] -= moved

    def _levels(self, room: list[int]) -> dict[tuple[str, int], int] | None:
        """Distances from the patterns with room, up to the first open quota."""
        level = {("p", p): 0 for p, n in enumerate(room) if n}
        queue, found = deque(level), None
        while queue:
            kind, x = at = queue.popleft()
            if found is not None and level[at] >= found:
                break
            if kind == "p":
                nexts = [("s", s) for s in self.members[x]]
            elif self.open[x]:
                found = level[at]
                continue
            else:  # tokens that another pattern sends here may go elsewhere
                nexts = [("p", p) for p in self.users[x] if self.flow[p][x]]
            for y in nexts:
                if y not in level:
                    level[y] = level[at] + 1
                    queue.append(y)
        return level if found is not None else None

    def _push(self, p: int, most: int, level: dict, dead: set) -> int:
        """Send up to ``most`` tokens of ``p`` along one shortest path."""
        path: list[tuple[int, int]] = []  # (pattern, source) in turn
        at, nexts = p, [iter(self.members[p])]
        while nexts:
            step = next(nexts[-1], None)
            if step is None:
                dead.add(("p", at))
                nexts.pop()
                if path:
                    at, s = path.pop()
                    nexts[-1] = iter([x for x in self.members[at] if ("s", x) not in dead])
                continue
            s = step
            if ("s", s) in dead or level.get(("s", s)) != level[("p", at)] + 1:
                continue
            if self.open[s]:
                path.append((at, s))
                return self._apply(path, most)
            later = next((q for q in self.users[s] if self.flow[q][s] and ("p", q) not in dead and level.get(("p", q)) == level[("s", s)] + 1), None)
            if later is None:
                dead.add(("s", s))
                continue
            path.append((at, s))
            at = later
            nexts.append(iter(self.members[at]))
        return 0

    def _apply(self, path: list[tuple[int, int]], most: int) -> int:
        amount = min([most, self.open[path[-1][1]], *(self.flow[q][s] for (_, s), (q, _) in zip(path, path[1:], strict=False))])
        for i, (p, s) in enumerate(path):
            self.flow[p][s] += amount
            if i + 1 < len(path):
                self.flow[path[i + 1][0]][s] -= amount
        self.open[path[-1][1]] -= amount
        return amount


def _routed(most: int):
    def run(arcs: pd.DataFrame) -> pd.DataFrame:
        """Arcs (pattern, words, place, quota) of one network to flows (pattern, place, routed)."""
        arcs = arcs.sort_values(["pattern", "place"])
        names, words, members = [], [], []
        for name, some in arcs.groupby("pattern", sort=True):
            names.append(name)
            words.append(int(some["words"].iloc[0]))
            members.append([int(x) for x in some["place"]])
        flows = Flow(words, members, {int(s): int(q) for s, q in zip(arcs["place"], arcs["quota"], strict=True)}).solve(most)
        rows = [(name, s, n) for name, flow in zip(names, flows, strict=True) for s, n in sorted(flow.items())]
        return pd.DataFrame(rows, columns=["pattern", "place", "routed"])

    return run


def routes(patterns: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``pattern, place, routed``: the words that go from a pattern to the quota of a source."""
    members = patterns.select("pattern", "words", F.explode("members").alias("source"))
    arcs = cut(met(members, targets, ["source"]).select("pattern", "words", "place", F.floor("target").cast("long").alias("quota")), "arcs")
    after = F.lead("place").over(Window.partitionBy("pattern").orderBy("place"))
    shared = arcs.select("place", after.alias("other")).filter("other is not null")
    if shared.isEmpty():
        networks = arcs.withColumn("network", F.col("place"))
    else:
        groups = components(shared, "place", "other").withColumnRenamed("node", "place")
        networks = arcs.join(groups, "place", "left").withColumn("network", F.coalesce("component", "place")).drop("component")
    return networks.groupBy("network").applyInPandas(_routed(most), "pattern string, place long, routed long")


def _boundaries(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``pattern, place, edge, rest, tied``: documents of smaller keys are taken, ``rest`` words of those at ``edge``.

    ``rows`` has ``pattern, key, size``, ``targets`` ``pattern, place, rest`` with ``rest`` below the
    pattern's words.
    """
    open_ = cut(targets.withColumn("prefix", F.lit("")), "open")
    done = None
    digits = 0
    while not open_.isEmpty():
        digits += _DIGITS
        wanted = open_.select(F.col("pattern").alias("__p"), F.col("prefix").alias("__q")).distinct()
        inside = rows.join(wanted, (F.col("pattern") == F.col("__p")) & (F.substring("key", 1, digits - _DIGITS) == F.col("__q")))
        counted = inside.groupBy("pattern", F.col("__q").alias("prefix"), F.substring("key", 1, digits).alias("next")).agg(
            F.sum("size").alias("words"), F.min("key").alias("least"), F.max("key").alias("largest")
        )
        running = F.sum("words").over(Window.partitionBy("pattern", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        hit = open_.join(counted.withColumn("before", running - F.col("words")), ["pattern", "prefix"]).filter("before <= rest and rest < before + words")
        found = cut(hit.select("pattern", "place", "next", F.col("rest") - F.col("before"), "words", "least", F.col("least") == F.col("largest")).toDF("pattern", "place", "prefix", "rest", "tied", "edge", "ends"), "open")
        ended = found.filter("ends").select("pattern", "place", "edge", "rest", "tied")
        done = ended if done is None else done.union(ended)
        open_ = found.filter("not ends").select("pattern", "place", "rest", "prefix")
    if done is None:
        return rows.limit(0).select("pattern", F.lit(0).cast("long").alias("place"), F.col("key").alias("edge"), F.col("size").alias("rest"), F.col("size").alias("tied"))
    return done


def mix(
    docs: DataFrame, members: Column, *, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, most: int = MOST, seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The documents of the mix and the quotas of the sources.

    ``members`` is the array of a document's sources (NULL elements are a source of their own; repeated
    elements count once; a NULL or empty array is in no source and nothing of it is taken).

    Documents: ``doc_id, size, sources, taken, uses``, one row per input row; ``taken`` words in all
    (at most ``most`` times the size, other rounds whole, the boundary document only its first
    words) and ``uses`` the words by source.  Quotas: ``source, source_size, target``.

    NULL and empty texts have size 0 and nothing is taken of them; long texts count whole.  Rows
    with equal ids (without an id: equal texts) share one place in the seeded order; if the boundary
    falls there, they share its words in proportion, rounded down.  Empty tables give empty results.
    Other columns are not read.  The same rows and seed give the same mix, however they are dealt.
    """
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))).cast("binary"))
    known = F.array_sort(F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>"))))
    rows = docs.select(doc.alias("doc_id"), words_of(text).alias("size"), known.alias("sources"), key.alias("key"))
    rows = cut(rows.withColumn("pattern", F.to_json("sources")), "sized")
    patterns = cut(rows.filter(F.size("sources") > 0).groupBy("pattern").agg(F.sum("size").alias("words"), F.first("sources").alias("members")), "patterns")
    targets = cut(quotas(patterns, weights, share, most), "targets")
    flows = cut(routes(patterns, targets, most).join(patterns.select("pattern", "words"), "pattern").filter("words > 0"), "flows")

    upto = F.sum("routed").over(Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    lines = cut(flows.select("pattern", "place", upto.alias("upto"), "words").select("pattern", "place", F.expr("upto div words").alias("rounds"), (F.col("upto") % F.col("words")).alias("rest")), "lines")
    edges = _boundaries(rows.select("pattern", "key", "size"), lines.filter("rest > 0").select("pattern", "place", "rest"))
    named = lines.drop("rest").join(edges, ["pattern", "place"], "left").join(targets.select("place", "source"), "place")
    # Written, so that its size is known and documents of few patterns stay where they are.
    cuts = cut(named.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("place", "source", "rounds", "edge", "rest", "tied"))).alias("cuts")), "cuts")

    lined = rows.join(cuts, "pattern", "left")
    size, at = F.col("size"), F.col("key")

    def upto_cut(c: Column) -> Column:
        """Words of the document before a cut of its pattern's line."""
        shared = F.when(size == c["tied"], c["rest"]).otherwise(F.floor(c["rest"].cast("double") * size / c["tied"]).cast("long"))
        return c["rounds"] * size + F.when(at < c["edge"], size).when(at == c["edge"], shared).otherwise(F.lit(0).cast("long"))

    ends = F.transform("cuts", upto_cut)
    uses = F.transform("cuts", lambda c, i: F.struct(c["source"].alias("source"), (F.col("ends")[i] - F.when(i > 0, F.col("ends")[i - 1]).otherwise(F.lit(0).cast("long"))).alias("words")))
    out = lined.withColumn("ends", ends).select(
        "doc_id", "size", "sources", F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("taken"), F.filter(uses, lambda u: u["words"] > 0).alias("uses")
    )
    return out, targets.select("source", "source_size", "target")

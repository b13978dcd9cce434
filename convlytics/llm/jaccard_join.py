"""N-gram Jaccard join with token-combination prefixes.

A text is its set of word shingles (64-bit hashes).  Equal sets become one class first, so a
text copied a million times is compared once.  All sets order their tokens alike, rarest
first, and only need to meet in a short prefix of that order:

* tokens below a fixed hash come first (``level 0``, somewhat more tokens than prefixes have);
  only they are counted over all classes, unless a set has too few of them for its prefix,
* a set with enough tokens that no other set has cannot be similar to any other: its prefix
  holds nothing to share, and it drops out,
* of the rest, rare tokens of the prefix are indexed alone.  Frequent ones fall in classes by
  hash; each class is indexed by its two-token combinations only, and the prefix is extended
  by one token for each class that it uses, which keeps every similar pair: with at most
  ``n - need`` tokens of the prefix missing from a partner, either a rare token or two of one
  frequent class survive.  The number of classes grows with the prefix, so a set emits a
  number of combinations in proportion to its prefix.  Sets of neighbouring size classes
  share one numbering of classes.

Sets that share an index entry form families (components, no pairs are made).  Families are
verified in blocks whose sizes are checked: a task holds two blocks and counts their shared
tokens at once, by a product of bit rows for frequent tokens and by posting lists for rare
ones, and emits links that span the block's components only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import cut, in_pieces, map_arrow, marked_ids, maybe_marked, runs
from convlytics.llm.components import components
from convlytics.llm.shingles import mix, shingle_sets

_PIECE_BYTES = 1 << 20
#: A token in more sets than this is frequent.
FREQUENT = 64
#: Frequent tokens of a prefix for each class of combinations.
PER_CLASS = 8
#: Sets and tokens in one block of a family.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 20


def _level_0(percent: int) -> int:
    """Hashes below this are level 0: 1.6 times the share of tokens that a prefix takes."""
    return ((100 - percent) * 16 << 60) // 1000 * 16


def need(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any similar set, at least."""
    return -(-n * percent // 100)


def _size_class(n: int, percent: int) -> int:
    return int(math.log(n) / -math.log(percent / 100) + 1e-9)


def _class_count(size_class: int, percent: int) -> int:
    """Classes of frequent tokens for sets of this size class: by the prefix of its smallest set."""
    smallest = (100 / percent) ** size_class
    return max(1, int(smallest * (100 - percent) / 100 / PER_CLASS))


def _longest_prefix(n: int, percent: int) -> int:
    k = _size_class(n, percent)
    return n - need(n, percent) + 1 + _class_count(k + 1, percent)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64), pa.int64()))


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``doc_id, n, d1, d2, early, late``: size, digest and the tokens of either level that are counted."""
    level_0 = np.uint64(_level_0(percent))
    names = ["doc_id", "n", "d1", "d2", "early", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", _PIECE_BYTES):
            sizes, one, two, firsts, late = [], [], [], [], []
            for s in shingle_sets(piece.column("text"), words):
                n = len(s)
                sizes.append(n)
                salted = mix(s + np.uint64(n))
                one.append(int(salted.sum(dtype=np.uint64)) - (1 << 63) if n else 0)
                two.append(int(mix(salted ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63) if n else 0)
                first = int(np.searchsorted(s, level_0))
                firsts.append(s[:first])
                late.append(s[first:] if n and first < _longest_prefix(n, percent) else s[:0])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, one, two)), _lists(firsts), _lists(late)], names=names
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, d1 long, d2 long, early array<long>, late array<long>")


def _signatures(n: int, own: int, shared: list[tuple[int, int, int]], percent: int, frequent: int = FREQUENT) -> list[int]:
    """Index entries of a set: ``own`` tokens of level 0 are in no other set; ``shared`` is sorted
    (level, df, token), where df 1 stands for tokens of level 1 that no other set has."""
    found: list[int] = []
    least = n - need(n, percent) + 1
    k = _size_class(n, percent)
    rare: list[int] = []
    for scheme in (k, k + 1):
        classes = _class_count(scheme, percent)
        cover, groups, rare = own, defaultdict(list), []
        for _, df, token in shared:
            if cover >= least:
                break
            if df <= frequent:
                cover += 1
                if df > 1:
                    rare.append(token)
            else:
                group = groups[token % classes]
                group.append(token)
                cover += len(group) > 1
        for name, group in groups.items():
            mixed = mix(np.array(group, np.uint64))
            i, j = np.triu_indices(len(mixed), 1)
            pairs = mix((mixed[i] + mixed[j]) ^ (np.minimum(mixed[i], mixed[j]) << np.uint64(1)) ^ np.uint64(scheme * 65537 + name + 1))
            found.extend(pairs.view(np.int64).tolist())
        found.extend(np.array(rare, np.uint64).view(np.int64).tolist())
    return list(set(found))


def _candidates(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """``sig, doc_id`` of the classes that may have a similar partner."""
    tokens = sets.select("doc_id", F.explode(F.concat("early", "late")).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    met = tokens.join(common.hint("shuffle_hash"), "token")
    bound = _level_0(percent)
    early = f"token >= 0 and token < {bound}" if bound < 1 << 63 else f"token >= 0 or token < {bound - (1 << 64)}"
    shared = met.groupBy("doc_id").agg(F.collect_set(F.struct(F.when(F.expr(early), 0).otherwise(1).alias("level"), "df", "token")).alias("shared"))
    per_set = (
        sets.select("doc_id", "n", F.size("early").alias("own"), "late")
        .join(shared, "doc_id")
        .withColumn("own", F.col("own") - F.size(F.filter("shared", lambda s: s["level"] == 0)))
        .filter(F.col("own") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        .select("doc_id", "n", "own", "shared", F.array_except("late", F.transform("shared", lambda s: s["token"])).alias("alone"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, alone = batch.column("shared"), batch.column("alone")
            flat = shared.flatten()
            level, df, token = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("level", "df", "token"))
            late = alone.flatten().to_numpy(zero_copy_only=False)
            ends, late_ends = shared.offsets.to_numpy() - shared.offsets[0].as_py(), alone.offsets.to_numpy() - alone.offsets[0].as_py()
            sigs, docs = [], []
            for i, (doc, n, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "own")), strict=True)):
                a, b, c, d = ends[i], ends[i + 1], late_ends[i], late_ends[i + 1]
                met = zip(level[a:b].tolist(), df[a:b].tolist(), token[a:b].view(np.uint64).tolist(), strict=True)
                found = _signatures(n, own, sorted([*met, *((1, 1, t) for t in late[c:d].view(np.uint64).tolist())]), percent, frequent)
                sigs.extend(found)
                docs.extend([doc] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(docs, pa.int64())], names=["sig", "doc_id"])

    return map_arrow(per_set, run, "sig long, doc_id long")


def _families(entries: DataFrame) -> DataFrame:
    """Sets that share index entries, over any number of steps: ``node, component``."""
    first = entries.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("sets")).filter("sets > 1")
    edges = entries.join(first, "sig").filter("doc_id <> first").select("first", "doc_id").distinct()
    return components(edges, "first", "doc_id")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared tokens of each set of ``left`` with each of ``right`` (positions in ``sets``)."""
    counts = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
    lengths = np.diff(np.append(heads, len(tokens)))
    flat = counts.reshape(-1)
    for length in range(2, 9):  # short posting lists: one pair of places at a time
        at = heads[lengths == length]
        for i in range(length):
            for j in range(length):
                a, b = place_l[owners[at + i]], place_r[owners[at + j]]
                ok = (a >= 0) & (b >= 0)
                if ok.any():
                    flat += np.bincount(a[ok] * len(right) + b[ok], minlength=len(flat)).astype(np.float32) if ok.sum() > len(flat) // 8 else 0
                    if ok.sum() <= len(flat) // 8:
                        np.add.at(flat, a[ok] * len(right) + b[ok], 1)
    long = np.flatnonzero(lengths > 8)
    for start in range(0, len(long), 2048):
        some = long[start : start + 2048]
        rows = np.repeat(np.arange(len(some)), lengths[some])
        who = owners[np.concatenate([np.arange(heads[t], heads[t] + lengths[t]) for t in some])]
        bits_l, bits_r = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        for bits, place in ((bits_l, place_l), (bits_r, place_r)):
            inside = place[who] >= 0
            bits[place[who[inside]], rows[inside]] = 1
        counts += bits_l @ bits_r.T
    return counts


def _verify(percent: int):
    """Blocks (two sides of a family) to links that span what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in runs(batches, ["family", "block"]):
            docs, side = rows["doc_id"].to_pylist(), np.array(rows["side"].to_pylist())
            sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            left = np.flatnonzero(side <= 0)
            right = left if (side < 0).any() else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            counts = _shared_counts(sets, left, right).astype(np.int64)
            union = sizes[left][:, None] + sizes[right][None, :] - counts
            similar = 100 * counts >= percent * union
            known = _Union(len(sets))
            for i, j in zip(*np.nonzero(similar), strict=True):
                if known.link(int(left[i]), int(right[j])):
                    a.append(docs[left[i]])
                    b.append(docs[right[j]])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, families: DataFrame) -> DataFrame:
    """Whole shingle sets of the sets in families, made again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", _PIECE_BYTES):
            tokens = [s.tobytes() for s in shingle_sets(piece.column("text"), words)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "family", "n")), pa.array(tokens, pa.binary())], names=["doc_id", "family", "n", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Few documents are in families: the others' texts need not move to find that out.
    rows = maybe_marked(rows, "doc_id", marked_ids(families, "doc_id")).join(families, "doc_id")
    return map_arrow(rows.select("doc_id", "family", "n", "text"), run, "doc_id long, family long, n long, tokens binary")


def _blocks(full: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Each set once for every block that it takes part in.

    A small family is one block.  A large one is cut by size class and salt; the block
    ``(x, y)`` holds the salts x and y of one size class or of neighbouring ones, as sets of
    other classes cannot be similar.  The numbers of salts come from counted sets and tokens.
    """
    per = sizes.groupBy("family", "k").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    salts = per.select("family", "k", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("salts"), "sets", "tokens")
    shape = salts.groupBy("family").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "salts"))).alias("salts"), F.sum("sets").alias("sets"), F.sum("tokens").alias("total")
    )
    rows = full.join(cut(shape, "shape"), "family").withColumn("k", _k(F.col("n"), percent))
    small = (F.col("sets") <= BLOCK_SETS) & (F.col("total") <= BLOCK_TOKENS)
    at = lambda k: F.coalesce(F.try_element_at("salts", k), F.lit(0))
    salt = F.pmod(F.xxhash64("doc_id"), at(F.col("k"))).cast("int")
    part = lambda k, i: F.concat_ws(".", k, i)
    rows = rows.withColumn("salt", F.when(small, F.lit(0)).otherwise(salt))
    entry = lambda block, side: F.struct(block.alias("block"), side.cast("int").alias("side"))

    def ahead(k, i):  # this set stands on the left
        return F.transform(F.sequence(F.lit(0), at(k + 1) - 1), lambda j: entry(F.concat_ws("/", part(k, i), part(k + 1, j)), F.lit(0)))

    def behind(k, i):
        return F.transform(F.sequence(F.lit(0), at(k - 1) - 1), lambda j: entry(F.concat_ws("/", part(k - 1, j), part(k, i)), F.lit(1)))

    def within(k, i):
        return F.transform(
            F.sequence(F.lit(0), at(k) - 1),
            lambda j: entry(F.concat_ws("/", part(k, F.least(i, j)), part(k, F.greatest(i, j))), F.when(i == j, -1).when(i < j, 0).otherwise(1)),
        )

    none = F.array().cast("array<struct<block:string,side:int>>")
    many = F.concat(
        within(F.col("k"), F.col("salt")),
        F.when(at(F.col("k") + 1) > 0, ahead(F.col("k"), F.col("salt"))).otherwise(none),
        F.when(at(F.col("k") - 1) > 0, behind(F.col("k"), F.col("salt"))).otherwise(none),
    )
    places = F.when(small, F.array(entry(F.lit("all"), F.lit(-1)))).otherwise(many)
    return rows.select("family", "doc_id", "tokens", F.explode(places).alias("place")).select("family", "doc_id", "tokens", "place.block", "place.side")


def _k(n, percent: int):
    return F.floor(F.log(n) / -math.log(percent / 100) + 1e-9).cast("int")


def similar_texts(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id``.

    Two documents are linked when 100 * shared >= percent * united shingles of ``words``
    words; the component is the smallest id that links lead to.  A text with fewer words is
    one shingle; texts without words, empty and NULL are linked with nothing.  ``class_id`` is
    the smallest id with the same set.  Rows with a NULL id get a result with NULL component
    and link nothing; repeated rows (an id and text twice) are one document with several rows.  Other columns are
    not read.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the prefixes are proven for 75 to 100 percent")
    sets = cut(_sets(docs, id_col, text_col, words, percent), "sets")
    keys = ["n", "d1", "d2"]
    classes = sets.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("class_id"))
    firsts = sets.filter("n > 0 and doc_id is not null").join(classes.select(F.col("class_id").alias("doc_id"), *keys), ["doc_id", *keys], "left_semi")
    entries = cut(_candidates(firsts, percent, frequent), "entries")
    family = _families(entries).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sizes = cut(family.join(sets.select("doc_id", "n"), "doc_id").distinct(), "families")
    full = _full_sets(docs, id_col, text_col, words, sizes)
    blocks = _blocks(full, sizes.withColumn("k", _k(F.col("n"), percent)), percent)
    links = map_arrow(blocks.repartition("family", "block").sortWithinPartitions("family", "block"), _verify(percent), "a long, b long")
    joined = components(links, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("joined"))
    found = classes.join(joined, "class_id", "left").select(*keys, "class_id", F.coalesce("joined", "class_id").alias("component_id"))
    member = sets.select("doc_id", *keys).join(found, keys, "left")
    own = (F.col("n") == 0) | F.col("doc_id").isNull()
    return member.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; all columns as they came."""
    found = similar_texts(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id"))
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")

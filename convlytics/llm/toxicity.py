"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Fitting reads a bounded sample of labelled rows (``most_rows``).  From it come

* a lexicon: words and word beginnings that toxic texts hold far more often than others,
  found by counting in how many sampled texts of each label a term occurs,
* dense features of every sampled text, its lexicon taken from the other folds,
* gradient-boosted trees on some folds and an isotonic map from their output to the share of
  toxic texts on another.

Scoring is one pass over all texts: the features in an Arrow step, trees and calibration as
columns.  Nothing is shuffled and nothing but the lexicon and the model leaves the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.llm.common import cut, in_pieces, map_arrow, release_free
from convlytics.plans.packaging import ship_package

#: Rows of the labelled sample and terms of the lexicon.
MOST_ROWS, MOST_TERMS = 20_000, 2_000
FOLDS, CALIBRATION_FOLD = (1, 2, 3, 4), 1
#: Texts that a term must occur in, and how far (in standard errors) the labels must differ.
LEAST_TEXTS, LEAST_Z, LEAST_LOG_ODDS = 3, 4.5, 2.0
NEAR = 5
_BEGINNINGS = (4, 5, 6)
#: Chunks that a task remembers (some 250 bytes each) before it starts afresh.
_MOST_CHUNKS = 65_536
_PIECE_BYTES = 1 << 20

# Common English insults and second-person words of four languages.
INSULTS = frozenset("asshole bastard bitch clown creep cretin dumb dumbass fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash ugly worthless".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted tus ti vosotros".split())
_PLAIN_LETTERS = str.maketrans("013457@$!|", "oieastasil")
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|+-=_~`^/\\"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCTUATION = b".,;:'\"()-"
_LOUD = b"!?"
_SYMBOLS = b"#$%&*@^~|"
_REPEATED = re.compile(r"(\w)\1\1")
FEATURES = [
    "lexicon_density", "lexicon_hits", "lexicon_kinds", "lexicon_weight", "insult_density", "near_second_person",
    "second_person", "capitals", "loud", "punctuation", "symbols", "digits", "obfuscated", "obfuscated_hits", "stretched", "log_words",
]


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a dash)."""
    return [word, *(word[:n] + "-" for n in _BEGINNINGS if len(word) > n)]


def clean_word(chunk: str) -> str:
    return chunk.strip(_MARKS)


class _Chunks(dict):
    """Chunk to None if it says nothing, else (weight, insult, second person, obfuscated, stretched, word)."""

    def __init__(self, lexicon: dict[str, float], most: int = _MOST_CHUNKS):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, chunk: str):
        if len(self) >= self.most:
            self.clear()
        word = clean_word(chunk)
        weight = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0) if word else 0.0
        inside = chunk.strip(".,;:!?\"'()")
        plain = clean_word(inside.translate(_PLAIN_LETTERS))
        odd = word != "" and not word.isalpha() and any(c.isalpha() for c in inside) and any(not c.isalpha() and c not in "-'." for c in inside)
        hidden = odd and plain != word and (plain in INSULTS or any(t in self.lexicon for t in terms_of(plain)))
        stretched = bool(_REPEATED.search(word))
        flags = (weight, word in INSULTS, word in SECOND_PERSON, odd, hidden, stretched, word)
        found = flags if weight or any(flags[1:6]) else None
        if len(chunk) <= 64:
            self[chunk] = found
        return found


def features_of(text: str | None, chunks: _Chunks) -> list[float]:
    text = text or ""
    raw = text.encode()
    size = max(1, len(raw))
    words = text.lower().split()
    n = max(1, len(words))
    said = [(i, f) for i, f in enumerate(map(chunks.__getitem__, words)) if f]
    hits = [(i, f) for i, f in said if f[0] or f[1] or f[4]]
    second = [i for i, f in said if f[2]]
    near = 0
    if second:
        places = set(second)
        near = sum(1 for i, _ in hits if any(j in places for j in range(i - NEAR, i + NEAR + 1)))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [
        sum(1 for _, f in hits if f[0]) / n,
        math.log1p(len(hits)),
        math.log1p(len({f[6] for _, f in hits})),
        max((f[0] for _, f in hits), default=0.0),
        sum(1 for _, f in hits if f[1]) / n,
        near / n,
        len(second) / n,
        share(_UPPER),
        share(_LOUD),
        share(_PUNCTUATION),
        share(_SYMBOLS),
        share(_DIGITS),
        sum(1 for _, f in said if f[3]) / n,
        sum(1 for _, f in said if f[4]) / n,
        sum(1 for _, f in said if f[5]) / n,
        math.log1p(len(words)),
    ]


def fold_of(doc_id: Column) -> Column:
    """0 is held out; labels are learnt from the other folds only."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_rows: int) -> DataFrame:
    """``fold, toxic, text`` of at most about ``most_rows`` labelled rows, chosen by a hash of the id."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("toxic").cast("double").alias("toxic"))
        .withColumn("fold", fold_of(F.col("__id")))
        .filter("fold <> 0")
    )
    share = min(1.0, most_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # The sample has a bound, so it may be broadcast: the texts stay where they are.
    return cut(rows.join(F.broadcast(known), "__id").select("fold", "toxic", "text"), "labelled")


def _lexicons(sample: DataFrame, most_terms: int) -> dict[int, dict[str, float]]:
    """By fold the lexicon of all other folds; under 0 that of all folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", _PIECE_BYTES // 4):
            # Terms are counted by Spark; a piece of text only merges what repeats in it.
            found: Counter[tuple[str, int, int]] = Counter()
            for fold, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "toxic", "text")), strict=True):
                words = {clean_word(c) for c in set((text or "").lower().split())}
                found.update((t, fold, int(toxic)) for t in {t for w in words if w and len(w) <= 40 for t in terms_of(w)})
            if found:
                terms, folds, toxics = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array(folds, pa.int64()), pa.array(toxics, pa.int64()), pa.array(found.values(), pa.int64())],
                    names=["term", "fold", "toxic", "texts"],
                )

    sizes = {(r.fold, int(r.toxic)): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = map_arrow(sample, run, "term string, fold long, toxic long, texts long")
    of = lambda f, y: F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("texts"))), F.lit(0)).alias(f"n{f}{y}")
    table = cut(counts.groupBy("term").agg(*(of(f, y) for f in FOLDS for y in (0, 1))), "terms")
    lexicons = {}
    for left_out in (0, *FOLDS):
        folds = [f for f in FOLDS if f != left_out]
        toxic, clean = (sum(F.col(f"n{f}{y}") for f in folds) for y in (1, 0))
        n_toxic, n_clean = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
        if not n_toxic or not n_clean:
            lexicons[left_out] = {}
            continue
        share = (toxic + clean) / float(n_toxic + n_clean)
        z = (toxic / n_toxic - clean / n_clean) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean) + 1e-12)
        odds = F.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - F.log((clean + 0.5) / (n_clean - clean + 0.5))
        best = table.filter(toxic >= LEAST_TEXTS).select("term", z.alias("z"), odds.alias("odds")).filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_LOG_ODDS))
        lexicons[left_out] = {r.term: float(r.odds) for r in best.orderBy(F.desc("z"), "term").limit(most_terms).collect()}
    return lexicons


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with ``score_col`` (0 to 1); the other columns stay as they are.

        A model without both labels in its sample scores every text 0.  NULL and empty texts
        are scored like any other, by features that are all zero.
        """
        if self.trees is None:
            return docs.withColumn(score_col, F.lit(0.0))
        ship_package(docs.sparkSession)
        lexicon = self.lexicon

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            chunks = _Chunks(lexicon)
            for some in texts:
                # A batch may hold tens of megabytes of text: only a slice of it becomes Python strings.
                pieces = in_pieces(iter([pa.RecordBatch.from_arrays([some], names=["text"])]), "text", _PIECE_BYTES)
                found = [features_of(t, chunks) for piece in pieces for t in piece.column("text").to_pylist()]
                yield pa.array(found, pa.list_(pa.float64()))
            chunks.clear()
            release_free()

        kept = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
        rows = docs.select(*kept, array_to_vector(features(F.col(f"`{text_col}`"))).alias("__features"))
        return self._calibrated(rows).select(*kept, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)).alias(score_col))

    def _calibrated(self, rows: DataFrame) -> DataFrame:
        return self.calibration.transform(self._raw(rows))

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("__p", vector_to_array("__probability")[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS) -> ToxicityModel:
    """Learn from ``labels`` (``doc_id, toxic``) outside the held-out fold.

    Labels other than 0 and 1, NULL ids and ids without a document are ignored; of repeated
    labels the larger counts.
    """
    ship_package(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, most_rows)
    lexicons = _lexicons(sample, most_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = {f: _Chunks(lexicons[f], _MOST_CHUNKS // len(FOLDS)) for f in FOLDS}
        for batch in in_pieces(batches, "text", _PIECE_BYTES):
            rows = [features_of(t, chunks[f]) for f, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["fold", "toxic", "features"])

    rows = cut(map_arrow(sample, run, "fold long, toxic double, features array<double>"), "features").select("fold", "toxic", array_to_vector("features").alias("__features"))
    fitted = {(r.toxic, r.calibrates) for r in rows.select("toxic", (F.col("fold") == CALIBRATION_FOLD).alias("calibrates")).distinct().collect()}
    if not {(0.0, False), (1.0, False)} <= fitted:
        return ToxicityModel({}, None, None)
    learner = GBTClassifier(featuresCol="__features", labelCol="toxic", maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7)
    trees = learner.fit(rows.filter(F.col("fold") != CALIBRATION_FOLD))
    trees = trees.setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw")
    model = ToxicityModel(lexicons[0], trees, None)
    scored = model._raw(rows.filter(F.col("fold") == CALIBRATION_FOLD) if any(c for _, c in fitted) else rows)
    model.calibration = IsotonicRegression(featuresCol="__p", labelCol="toxic", predictionCol="__score").fit(scored.select("__p", "toxic"))
    return model


def toxic_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Only the text enters a score, whole, however long; NULL and empty texts get the score of a text
    without any feature.  Repeated rows get equal scores; a NULL id is not held out;
    an empty table gives an empty result; columns of other names are not read.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return model.score(rows).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5; all columns as they came."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return model.score(docs, text_col=text_col, score_col="__toxicity").filter(F.col("__toxicity") < 0.5).drop("__toxicity")

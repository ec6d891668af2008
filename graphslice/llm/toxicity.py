"""Toxicity by compression distance to two zstandard dictionaries.

The dictionary of ordinary text has its most usual words; that of toxic text
has the same and, besides, the words that are usual in toxic text only. A
window of a text that gets shorter with the second than with the first holds
such words or close relatives of them. A logistic curve, fitted on labelled
documents that neither dictionary has seen, turns the differences of all
windows of a text into a score.

Words and beginnings of words are counted. One counts as toxic if it follows
many different words, so that copies of one text are no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphslice.plans.shipping import ship_package
from graphslice.plans.workspace import Workspace

WINDOW_WORDS, WINDOW_BYTES = 24, 2048
ORDINARY_WORDS, TOXIC_WORDS = 8000, 2000  # in the dictionaries, at most
LEAST_CONTEXTS, LEAST_RATIO = 6, 12.0  # of a toxic word: different words before it; rate against ordinary text
BEGINNINGS = (4, 6)  # letters; so much of a word is counted on its own
LABELLED_ROWS = 4_096  # labelled documents of each class that the words are counted in, at most
CALIBRATION_ROWS = 4_096  # labelled documents that the curve is fitted on, at most
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4  # of crc32 of the id as text
#: Strategy lazy, and no match of fewer than six bytes: letters that meet by chance save nothing.
_SEARCH = dict(strategy=4, min_match=6, hash_log=17, chain_log=18, search_log=4, window_log=18, target_length=64)
_SECOND = bytes((i + 128) % 256 for i in range(256))  # the second alphabet


def fold() -> Column:
    """The document's fold; rows without id are in the held-out one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the curve on standardised features; ``weights`` empty: ``prior`` for every text."""

    ordinary: bytes
    toxic: bytes
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        x = (features - np.array(self.means)) / np.array(self.scales)
        return 1 / (1 + np.exp(-(x @ np.array(self.weights[:-1]) + self.weights[-1])))


def spelled(tokens: list[str]) -> bytes:
    """Each word twice, in two alphabets: a whole word that a dictionary has saves twice as much, but still one match."""
    once = [(" " + token).encode() for token in tokens]
    return b"".join(word + word.translate(_SECOND) for word in once)


def windows(text: str) -> Iterator[bytes]:
    """The lower-cased text in windows of 24 words, spelled; one of more than two kilobytes is cut."""
    tokens = text.lower().split()
    for i in range(0, len(tokens), WINDOW_WORDS):
        window = spelled(tokens[i : i + WINDOW_WORDS])
        for start in range(0, len(window), WINDOW_BYTES):
            yield window[start : start + WINDOW_BYTES]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(**_SEARCH, **plain),
    )


class Distance:
    """Features of a text from the bytes by which the toxic dictionary shortens its windows."""

    names = ("most", "three", "mean", "from2", "from3", "from4", "most4", "any3", "any5", "size", "any2", "n2", "n3")

    def __init__(self, model: Model):
        self._shorter, self._longer = _compressor(model.toxic).compress, _compressor(model.ordinary).compress

    def features(self, text: str | None) -> np.ndarray:
        gains = [len(self._longer(w)) - len(self._shorter(w)) for w in windows(text or "")]
        d = np.array(gains or [0])
        return np.array(
            [
                d.max(), np.sort(d)[-3:].sum(), np.maximum(d - 1, 0).mean(), (d >= 2).mean(), (d >= 3).mean(),
                (d >= 4).mean(), min(d.max(), 4), d.max() >= 3, d.max() >= 5, np.log(len(d)),
                d.max() >= 2, min((d >= 2).sum(), 5), min((d >= 3).sum(), 5),
            ],
            float,
        )


def _contexts(docs: DataFrame) -> DataFrame:
    """``word, toxic, n, contexts`` of the words of documents of each label, and of their beginnings.

    ``contexts`` counts different words before it by 64 bits, which combine
    before the shuffle; a count of some tens is enough to know.
    """
    trimmed = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    tokens = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, trimmed, ""))
    listed = docs.select("toxic", tokens.alias("tokens"))
    pairs = listed.select("toxic", F.explode(F.array_distinct(_pairs(F.col("tokens")))).alias("pair"))
    units = F.array(F.col("pair.word"), *(F.substring("pair.word", 1, n) for n in BEGINNINGS))
    each = pairs.select("toxic", "pair.before", F.explode(F.array_distinct(units)).alias("word"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("before"), F.lit(64)).cast("int"))
    counts = each.where(F.length("word") >= min(BEGINNINGS)).groupBy("word", "toxic")
    return counts.agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or(bit)).alias("contexts"))


def _pairs(tokens: Column) -> Column:
    """Each word with the one before it; the first with none."""
    before = F.concat(F.array(F.lit("")), tokens)
    return F.zip_with(
        tokens, F.slice(before, 1, F.size(tokens)), lambda w, b: F.struct(w.alias("word"), b.alias("before"))
    )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``), without the held-out fold.

    Words are counted in three folds and the curve is fitted on the fourth,
    on documents with the least hash of their id, up to the bounds above; one
    that is labelled both ways counts as toxic. Without toxic or without
    ordinary documents the score of every text is the share of toxic ones.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
    known = known.withColumn("hash", F.xxhash64("doc_id")).orderBy("hash", "doc_id")
    learnt = [known.where((F.col("fold") != CALIBRATION) & (F.col("toxic") == t)).limit(LABELLED_ROWS) for t in (0, 1)]
    fitted = known.where(F.col("fold") == CALIBRATION).limit(CALIBRATION_ROWS)
    folder = Workspace(docs.sparkSession, "toxicity")
    # Bounded by the three limits, so it may be sent to every task.
    chosen = folder.save(learnt[0].union(learnt[1]).union(fitted).select("doc_id", "toxic", "fold"), "chosen")
    rows = folder.save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").drop("doc_id"), "rows")

    counts = folder.save(_contexts(rows.where(F.col("fold") != CALIBRATION)), "contexts")
    totals = {r["toxic"]: r["n"] for r in counts.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    toxic_share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    if len(totals) < 2:
        return Model(b"", b"", prior=float(toxic_share))
    of = lambda label, name: F.sum(F.when(F.col("toxic") == label, F.col(name)).otherwise(0))
    word = counts.groupBy("word").agg(of(1, "n").alias("bad"), of(0, "n").alias("good"), of(1, "contexts").alias("after"))
    rate = (F.col("bad") + 0.5) / totals[1] >= LEAST_RATIO * (F.col("good") + 0.5) / totals[0]
    special = (F.col("after") >= LEAST_CONTEXTS) & rate
    first = lambda found, by, n: [r["word"] for r in found.orderBy(F.desc(by), "word").limit(n).collect()]
    bad = first(word.where(special), "bad", TOXIC_WORDS)
    usual = first(word.where(~special), "good", ORDINARY_WORDS)
    # The usual words end both dictionaries, so a window of such words is matched alike with either.
    content = lambda found: spelled(found[::-1])
    return _calibrated(Model(content(usual), content(usual + bad)), rows.where(F.col("fold") == CALIBRATION))


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """The curve by Newton's method with a small ridge, on the features of bounded many rows."""
    width = len(Distance.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(model)
        for batch in batches:
            found = [distance.features(text).tolist() for text in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"].astype("float64"), "features": found})

    ship_package(rows.sparkSession)
    got = rows.select("text", "toxic").mapInPandas(run, "toxic double, features array<double>").collect()
    y = np.array([r["toxic"] for r in got])
    if len(set(y)) < 2:
        return Model(model.ordinary, model.toxic, prior=float(y.mean()) if len(y) else 0.0)
    order = sorted(range(len(got)), key=lambda i: (got[i]["features"], y[i]))
    x, y = np.array([got[i]["features"] for i in order]).reshape(-1, width), y[order]
    means, scales = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - means) / scales, np.ones(len(x))]
    weights = np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        curvature = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(width + 1)
        weights -= np.linalg.solve(curvature, z.T @ (p - y) + 0.1 * weights)
    return Model(model.ordinary, model.toxic, tuple(means), tuple(scales), tuple(weights))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) as ``doc_id, held_out, score, predicted``.

    The score is between 0 and 1, that of null and empty texts like that of a
    text without any toxic window; ``predicted`` is 1 from 0.5. Equal rows are
    separate, an empty table gives no rows, and further columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(model) if model.weights else None
        for batch in batches:
            rows = [distance.features(text) if distance else np.zeros(1) for text in batch["text"]]
            yield batch[["doc_id", "held_out"]].assign(score=model.probability(np.array(rows)))

    ship_package(docs.sparkSession)
    given = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = given.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

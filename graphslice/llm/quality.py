"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs fall into hash buckets. Two multinomials over the
buckets, one of the trusted documents and one of the whole corpus, give each
bucket a log ratio. The score of a document is the mean ratio of its n-grams,
and every document with at least the threshold stays: there is no sampling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphslice.llm.text import let, unused, words
from graphslice.plans.workspace import Workspace

BUCKETS = 1 << 16
#: Nats per n-gram. A document of symbols, shouting or tables scores below -1,
#: prose of any language within some hundredths of 0.
THRESHOLD = -0.25
WINDOW = 8  # words
FEWEST_WORDS, MOST_REPEATED = 20, 30  # words; per cent
BROADCAST_ROWS = 1 << 20  # ids of trusted documents; more are joined by shuffle

_SYMBOLS = r"[!-/:-@\[-`{-~]+"


def hashes_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def pairs_of(hashes: Column, apart: int = 1) -> Column:
    """Hashes of each element with the one ``apart`` places later."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def symbols_of(text: Column) -> Column:
    """Hashes of the runs of ASCII marks, which count as words of their own besides the words that hold them."""
    return hashes_of(F.regexp_extract_all(text, F.lit(_SYMBOLS), F.lit(0)))


@dataclass(frozen=True)
class LogRatio:
    """Log ratio of each bucket: a table of one row with one array, which a query reads when it runs."""

    table: DataFrame
    buckets: int

    def ratios(self) -> Column:
        """The array; as a column of its own, since a subquery cannot stand inside a lambda function."""
        return self.table.scalar()

    def score(self, ratios: Column, hashes: Column, pairs: Column, symbols: Column) -> Column:
        """Mean log ratio of words, pairs of words and runs of marks, given their hashes; 0 without any."""
        of = lambda h: F.element_at(ratios, (F.pmod(h, F.lit(self.buckets)) + 1).cast("int"))
        total = lambda found: F.aggregate(found, F.lit(0.0), lambda t, h: t + of(h))
        n = F.size(hashes) + F.size(pairs) + F.size(symbols)
        return F.when(n == 0, 0.0).otherwise((total(hashes) + total(pairs) + total(symbols)) / n)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> LogRatio:
    """Counts over every document of ``docs`` (``doc_id, text``); ``trusted`` has the ``doc_id`` of the target's.

    The target is smoothed towards the corpus, with the weight of one n-gram
    per bucket, so that few trusted documents tell little: no ratio is below
    ``-log(1 + trusted n-grams / buckets)``. Without any, all ratios are 0.
    Buckets without an n-gram have 0. The model is a table of one row.
    """
    ids = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("target", F.lit(1))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    grams = let(hashes_of(words(text)), lambda h: F.concat(h, pairs_of(h), symbols_of(text)))
    each = marked.select(F.explode(grams).alias("gram"), "target")
    counts = each.groupBy(F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("raw"), F.count("target").alias("target")
    )
    folder = Workspace(docs.sparkSession, "log-ratio")
    seen = folder.write(counts, "counts", F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    all_raw, all_target = float(seen["all_raw"]), float(seen["all_target"])
    share = F.col("raw") / F.lit(all_raw or 1.0)
    smoothed = (F.col("target") + F.lit(float(buckets)) * share) / F.lit(all_target + buckets)
    ratio = F.log(smoothed) - F.log(share) if all_target else F.lit(0.0)
    found = folder.read("counts", schema=counts.schema).select("bucket", ratio.alias("ratio"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left")
    # One row of as many numbers as there are buckets, however large the corpus.
    listed = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))))
    return LogRatio(folder.save(every.agg(listed["ratio"].alias("ratios")), "ratios"), buckets)


def repeated_words(pairs: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text, the first included.

    ``pairs`` has the hashes of neighbouring words; pairs of pairs are windows of four, and those of four of eight.
    """

    def covered(windows: Column) -> Column:
        places = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda found, i: F.get(found, i).getField("h")
        twice = lambda found: F.filter(
            found,
            lambda x, i: F.coalesce(at(found, i - 1) == x.getField("h"), F.lit(False))
            | F.coalesce(at(found, i + 1) == x.getField("h"), F.lit(False)),
        )
        starts = let(places, lambda found: F.sort_array(F.transform(twice(found), lambda x: x.getField("i"))))
        gap = lambda s, i, x: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
        return let(
            starts,
            lambda s: F.aggregate(F.transform(s, lambda x, i: gap(s, i, x)), F.lit(0), lambda total, n: total + n),
        )

    windows = let(pairs_of(pairs, 2), lambda fours: pairs_of(fours, 4))
    distinct = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    return let(windows, lambda w: F.when(distinct(w), F.lit(0)).otherwise(covered(w))).cast("long")


def judge(docs: DataFrame, model: LogRatio, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (``doc_id, text``) with their counts, ``base_failed``, ``score`` and ``kept``, without the text.

    Null and empty texts have no words, so they fail the base rules; their
    score is 0. Equal rows are separate, an empty table gives no rows, and
    further columns stay.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    repeated = let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s)))

    def counts(tokens: Column, ratios: Column) -> Column:
        def hashed(h: Column, p: Column) -> Column:
            return F.struct(
                F.size(h).cast("long").alias("n_words"),
                F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
                repeated_words(p).alias("n_repeat_words"),
                let(symbols_of(text), lambda s: model.score(ratios, h, p, s)).alias("score"),
            )

        return let(hashes_of(tokens), lambda h: let(pairs_of(h), lambda p: hashed(h, p)))

    others = [name for name in docs.columns if name != "text"]
    name = unused("_ratios", docs)
    # The column is named once below, so Spark puts the array in its place and no row carries it.
    counted = docs.withColumn(name, model.ratios()).select(
        *others,
        let(F.col(name), lambda ratios: let(words(text), lambda tokens: counts(tokens, ratios))).alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        repeated.cast("long").alias("n_dup_lines"),
    )
    # Filters on a generated column stay above it, so the counts are made once for all that is asked of them.
    once = counted.select(*others, F.explode(F.array("_words")).alias("_words"), "n_symbols", "n_dup_lines")
    plain = once.select(*others, "_words.*", "n_symbols", "n_dup_lines")
    short = F.col("n_words") < FEWEST_WORDS
    repetitive = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    failed = plain.withColumn("base_failed", short | repetitive)
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def good_documents(docs: DataFrame, model: LogRatio, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judge(rows, model, threshold).where("kept").select("row.*")

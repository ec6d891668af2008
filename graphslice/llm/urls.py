"""URL filter: a blocked Bloom filter passes possible hits to an exact join.

The listed URLs, made canonical, set eight bits each in one 512-bit block of
the filter, which is a table with one row per block. A page reads the block
of its own canonical URL; only pages whose eight bits are all set are joined
with the list itself, which removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
BLOCK_BITS, WORDS = 512, 8
BROADCAST_BYTES = 8 << 20  # a larger filter is joined by shuffle
_TRACKING = r"(?i)(utm_[^=&]*|ref|fbclid|gclid)(=.*)?"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains under a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return own & F.startswith(path, F.lit(self.path))


def _lower(text: Column) -> Column:
    """A-Z only, whatever the session's locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; empty for null or no ``://``."""
    return _lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, sorted query without tracking; no fragment.

    Null for a null URL or one without ``://``.
    """
    host = F.regexp_replace(host_of(url), r"^www\.|\.?(:80|:443)?$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{_TRACKING}$"))
    tail = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def _masks(url: Column) -> list[Column]:
    """One bit in each of a block's eight words, from six bits of a second hash each."""
    hashed = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(WORDS)
    ]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``listed`` (``url``, canonical) as rows ``block, w0 .. w7``; built by a combining aggregation."""
    words = [mask.alias(f"w{i}") for i, mask in enumerate(_masks(F.col("url")))]
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), *words)
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(
    pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = (), otherwise: tuple[str, str] = ("block", "allow")
) -> DataFrame:
    """Every row of ``pages`` (``page_id, url``) with ``host, path, rule, verdict``.

    The longest rule that fits decides. Without one the verdict is
    ``otherwise[0]`` for a URL whose canonical form is that of a ``listed``
    one (``url``), else ``otherwise[1]``; null URLs and URLs without ``://``
    are never listed, and null or repeated rows of the list count once. Equal
    pages stay separate rows, empty tables are fine and further columns are
    ignored.
    """
    exact = listed.select(canonical(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    n = exact.count()
    blocks = max(1, -(-n * BITS_PER_URL // BLOCK_BITS))
    bloom = bloom_filter(exact, blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canon"))
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda pick: F.coalesce(
        F.lit(None).cast("string"), *(F.when(r.fits(F.col("host"), F.col("path")), F.lit(pick(r))) for r in longest)
    )
    named = named.withColumn("rule", fits(lambda r: r.name)).withColumn("ruled", fits(lambda r: r.verdict))
    spread = F.coalesce(_block(F.col("canon"), blocks), F.pmod(F.xxhash64("page_id"), F.lit(blocks)))
    tested = named.withColumn("block", spread).join(bloom, "block", "left")
    inside = [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canon")))]
    possible = F.col("canon").isNotNull()
    for bit in inside:
        possible &= F.coalesce(bit, F.lit(False))
    tested = tested.withColumn("possible", possible & F.col("rule").isNull())
    columns = ["page_id", "host", "path", "rule"]
    rest = tested.where(~F.col("possible")).select(*columns, F.coalesce("ruled", F.lit(otherwise[1])).alias("verdict"))
    hits = tested.where("possible").join(exact.withColumnRenamed("url", "canon").withColumn("found", F.lit(True)), "canon", "left")
    verdict = F.when(F.col("found"), otherwise[0]).otherwise(otherwise[1])
    return rest.unionByName(hits.select(*columns, verdict.alias("verdict")))

"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of ``exponent``, normalised. The exponent is bisected between 0 (all
sources alike) and 1 (as they come): either the weights' entropy meets a share of the largest possible one, or it is the
least exponent with which no source is repeated more often than ``max_repeats`` times. The total budget defaults to the
least one that takes every source whole at least once, so that nothing is left out.

Budgets are realised as block permutations. A source's stream is its documents in a new pseudo-random order for each
epoch, as many epochs as its budget takes; the last epoch ends with the document that reaches the budget. Streams are cut
into ``blocks`` pieces of equal shares, and block b of the mixture holds piece b of every source, so each stretch of the
mixture has the target weights.

Orders are hashes, so a document finds its place alone: sums over hash buckets (at most some ``MOST_BUCKETS`` rows, or
16 a source and block, whatever the input) give the prefix before a bucket, and only the bucket in which a budget ends is
sorted, by key, after rows with one key are summed up. The hot source is spread over its buckets. Everything is built-in
expressions. Up to ``MOST_SOURCES`` sources are planned on the driver; of more, Spark sums up the shares. Plans are
written tables of a row a source, so their size is known: small ones are broadcast, larger ones joined by a shuffle.
``places`` tells where each copy stands; ``realised`` returns the documents in the order of the mixture, by block and by
place within it.

Tokens are words and one for the end. Edge cases: null text has the end alone; null sources are one source; rows that
repeat an id share its places, and stay or go together; a null id stands for the text's md5, so that rows without ids are
spread like others; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

MAX_REPEATS, BLOCKS = 2.0, 64
BUCKET_TOKENS, MOST_BUCKETS, MOST_SOURCES = 1 << 16, 1 << 20, 100_000
_UNIT = float(1 << 52)


def _hash(*parts: Column) -> Column:
    """52 bits of md5 of the parts as text; any SQL engine can compute it too."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def tempered(shares: list[float], exponent: float) -> list[float]:
    powers = [s**exponent for s in shares]
    return [p / sum(powers) for p in powers]


def repeats(shares: list[float], weights: list[float]) -> float:
    """Most repeats of a source if the budget takes every source once."""
    rates = [w / s for s, w in zip(shares, weights)]
    return max(rates) / min(rates)


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisected(shares: list[float], max_repeats: float | None = None, entropy_share: float | None = None) -> float:
    """The exponent; repeats and entropy both fall as it grows."""
    if len(shares) < 2:
        return 0.0
    if entropy_share is not None:
        goal = entropy_share * math.log(len(shares))
        return _bisected(lambda e: entropy(tempered(shares, e)) <= goal)
    return _bisected(lambda e: repeats(shares, tempered(shares, e)) <= max_repeats)


def _bisected(enough: Callable[[float], bool]) -> float:
    low, high = 0.0, 1.0
    if enough(low):
        return low
    if not enough(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return min(1.0, math.ceil(high * 1e9) / 1e9)


class Mixture:
    """The plan for ``docs``; ``realised`` and ``places`` apply it."""

    def __init__(
        self, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", max_repeats: float = MAX_REPEATS,
        entropy_share: float | None = None, budget: float | None = None, blocks: int = BLOCKS, seed: int = 0,
    ):
        self.docs, self.seed, self.blocks = docs, seed, blocks
        self.name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
        self.source = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))
        self.tokens = (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
        # Ids, sources and counts alone; the texts are read once for it.
        self.sized = written(docs.select(F.col(doc_id).alias("__id"), self.name.alias("__name"), self.source.alias("__source"), self.tokens.alias("__n")))
        totals = self.sized.groupBy("__source").agg(F.sum("__n").alias("__all"))
        rows = totals.limit(MOST_SOURCES + 1).collect()
        if len(rows) <= MOST_SOURCES:
            every = sum(r["__all"] for r in rows)
            shares = [r["__all"] / every for r in rows]
            self.exponent = bisected(shares, max_repeats, entropy_share) if rows else 1.0
            self.weights = dict(zip((r["__source"] for r in rows), tempered(shares, self.exponent))) if rows else {}
            norm = sum(s**self.exponent for s in shares) or 1.0
            self.budget = budget or max((r["__all"] / w for r, w in zip(rows, self.weights.values())), default=0.0)
        else:
            totals = written(totals)
            every, norm = self._planned(totals, max_repeats, entropy_share, budget)
        self.bucket_tokens = max(BUCKET_TOKENS, every * max(1.0, self.budget / max(1, every)) / MOST_BUCKETS)
        weight = F.pow(F.col("__all") / F.lit(float(max(1, every))), F.lit(self.exponent)) / F.lit(norm)
        goal = F.greatest(F.lit(1), F.round(weight * F.lit(float(self.budget)))).cast("long")
        self.plan = (
            totals.withColumn("__goal", goal)
            .withColumn("__epochs", F.ceil(F.col("__goal") / F.col("__all")).cast("int"))
            .withColumn("__buckets", F.greatest(F.lit(16 * blocks), F.ceil(F.col("__all") / F.lit(float(self.bucket_tokens)))).cast("long"))
        )
        self.plan = written(self.plan)
        copies = self._copies(self.sized)
        sums = copies.groupBy("__source", "__epoch", "__bucket").agg(F.sum("__n").alias("__n"), F.first("__goal").alias("__goal"))
        order = W.partitionBy("__source").orderBy("__epoch", "__bucket")
        self.prefix = written(sums.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).where("__before < __goal"))
        # The bucket in which the budget ends, and the last key that it takes there.
        ends = self.prefix.where(F.col("__before") + F.col("__n") >= F.col("__goal")).select("__source", "__epoch", "__bucket", "__before")
        within = (
            copies.join(ends, ["__source", "__epoch", "__bucket"]).groupBy("__source", "__epoch", "__bucket", "__key")
            .agg(F.sum("__n").alias("__n"), F.first("__before").alias("__before"), F.first("__goal").alias("__goal"))
        )
        upto = W.partitionBy("__source").orderBy("__key")
        within = within.withColumn("__start", F.col("__before") + F.sum("__n").over(upto) - F.col("__n"))
        last = within.where("__start < __goal").groupBy("__source").agg(
            F.max("__key").alias("__last_key"), F.first("__epoch").alias("__last_epoch"), F.first("__bucket").alias("__last_bucket")
        )
        # Where each block of a source begins: at most ``blocks`` entries.
        block = F.least(F.lit(blocks - 1), F.floor(F.col("__before") * F.lit(float(blocks)) / F.col("__goal"))).cast("int")
        begins = (
            self.prefix.groupBy("__source", block.alias("block")).agg(F.min(F.struct("__epoch", "__bucket")).alias("at"))
            .groupBy("__source").agg(F.collect_list(F.struct("at", "block")).alias("__begins"))
        )
        self.cut = written(last.join(begins, "__source"))

    def _planned(self, totals: DataFrame, max_repeats: float | None, entropy_share: float | None, budget: float | None) -> tuple[float, float]:
        """Exponent and budget by sums in Spark; returns all tokens and the norm. The weights stay in ``plan``."""
        self.weights = None
        n, every, least, most = totals.agg(F.count(F.lit(1)), F.sum("__all"), F.min("__all"), F.max("__all")).first()
        share = F.col("__all") / F.lit(float(every))

        def sums(e: float) -> tuple[float, float]:
            power = F.pow(share, F.lit(e))
            return tuple(totals.agg(F.sum(power), F.sum(power * F.log(share))).first())

        def low_entropy(e: float) -> bool:
            norm, logs = sums(e)
            return math.log(norm) - e * logs / norm <= entropy_share * math.log(n)

        # Only the least and the largest source decide how often one is repeated.
        if n < 2:
            self.exponent = 0.0
        elif entropy_share is not None:
            self.exponent = _bisected(low_entropy)
        else:
            self.exponent = _bisected(lambda e: (most / least) ** (1 - e) <= max_repeats)
        norm = sums(self.exponent)[0]
        self.budget = budget or every * norm * (most / every) ** (1 - self.exponent)
        return every, norm

    def _copies(self, rows: DataFrame) -> DataFrame:
        """A row for each epoch that may take it, with its key and bucket there. ``rows``: __name, __source."""
        rows = rows.join(self.plan, "__source").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
        key = _hash(F.lit(self.seed), F.col("__epoch"), F.col("__name"))
        return rows.withColumn("__key", key).withColumn("__bucket", F.floor(F.col("__key") / F.lit(_UNIT) * F.col("__buckets")).cast("long"))

    def _taken(self, rows: DataFrame) -> DataFrame:
        """The copies that the budgets take, with block and place."""
        taken = (
            (F.col("__epoch") < F.col("__last_epoch")) | (F.col("__bucket") < F.col("__last_bucket"))
            | (F.col("__bucket") == F.col("__last_bucket")) & (F.col("__key") <= F.col("__last_key"))
        )
        here = F.struct(F.col("__epoch").alias("__epoch"), F.col("__bucket").alias("__bucket"))
        block = F.array_max(F.transform(F.filter("__begins", lambda b: b["at"] <= here), lambda b: b["block"]))
        place = _hash(F.lit(self.seed + 1), F.col("__epoch"), F.col("__name"))
        return self._copies(rows).join(self.cut, "__source").where(taken).withColumn("__block", block).withColumn("__place", place)

    def places(self) -> DataFrame:
        """Per copy: doc_id, source, epoch, block, place (its order within the block), n_tokens."""
        source = F.when(F.col("__source") != "null", F.substring("__source", 2, 1 << 30))
        return self._taken(self.sized).select(
            F.col("__id").alias("doc_id"), source.alias("source"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"),
            F.col("__place").alias("place"), F.col("__n").alias("n_tokens"),
        )

    def realised(self) -> DataFrame:
        """The documents, all columns, each as often as the mixture takes it, in the mixture's order: partitions are
        ranges of (block, place), sorted."""
        columns = F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("__row")
        rows = self._taken(self.docs.select(columns, self.name.alias("__name"), self.source.alias("__source")))
        return rows.select("__row", "__block", "__place").repartitionByRange("__block", "__place").sortWithinPartitions("__block", "__place").select("__row.*")


#: The mixture to the default repetition limit; there the exponent has a closed form.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents),
t AS (SELECT source, sum(n)::DOUBLE AS total FROM d GROUP BY source),
s AS (SELECT source, total, total / sum(total) OVER () AS share FROM t),
e AS (SELECT CASE WHEN max(share) / min(share) <= 2 THEN 0 ELSE least(1, ceil((1 - ln(2) / ln(max(share) / min(share))) * 1e9) / 1e9) END AS e FROM s),
w AS (SELECT source, total, pow(share, e) / sum(pow(share, e)) OVER () AS weight FROM s, e),
g AS (SELECT source, total, greatest(1, round(weight * max(total / weight) OVER ())) AS goal, greatest(1024, ceil(total / 65536)) AS buckets FROM w),
c AS (
  SELECT doc_id, d.source, n, goal, epoch, ('0x' || substr(md5('0|' || epoch || '|' || doc_id), 1, 13))::BIGINT AS key, buckets
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, LATERAL (SELECT unnest(range(0, ceil(goal / total)::BIGINT)) AS epoch)),
b AS (SELECT *, floor(key / 4503599627370496.0::DOUBLE * buckets) AS bucket FROM c),
p AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY epoch, key) - sum(n) OVER (PARTITION BY source, epoch, key) AS before,
         sum(n) OVER (PARTITION BY source ORDER BY epoch, bucket) - sum(n) OVER (PARTITION BY source, epoch, bucket) AS bucket_before FROM b)
SELECT doc_id, source, epoch::INT AS epoch, least(63, floor(bucket_before * 64.0::DOUBLE / goal))::INT AS block,
       ('0x' || substr(md5('1|' || epoch || '|' || doc_id), 1, 13))::BIGINT AS place, n AS n_tokens
FROM p WHERE before < goal
"""

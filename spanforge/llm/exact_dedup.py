"""Exact dedup with a heavy-hitter split.

A frequent-items sketch of the Misra-Gries family (``approx_top_k``, merged map side, ``tracked`` counters) names the
few digests that may be frequent. Their winners are verified exactly by a partial aggregation and broadcast (at most
``heavy`` rows), so rows of heavy groups are decided where they are read. All other digests take one ordinary shuffle.

Texts are equal when they are so without white space. Of equal texts the row with the most code points stays, then the
one with the smallest id, then the one that is read first. Edge cases: null text counts as empty, all empty texts are one
group; a null id loses against any other id of the same length; rows that repeat an id are rows of their own, judged by
their texts, and exactly one row of each group is ``kept``, whatever its id. An empty table gives an empty result; other
columns are not looked at, and stay as they are where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, squeezed, without

#: Most digests whose winners are broadcast, and counters of the sketch: any digest with more than about
#: rows / tracked copies is among its answers.
HEAVY, TRACKED = 256, 4096


def digests(docs: DataFrame, row: Column, doc_id: Column, text: Column) -> DataFrame:
    """row, doc_id, text_sha256, n_points (code points of the original text)."""
    points = F.char_length(F.coalesce(text, F.lit(""))).cast("long")
    return docs.select(row.alias("row"), doc_id.alias("doc_id"), F.sha2(squeezed(text), 256).alias("text_sha256"), points.alias("n_points"))


def _winner() -> list[Column]:
    order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), F.bitwise_not(F.col("doc_id")), F.bitwise_not(F.col("row")))
    return [F.max_by(F.struct("doc_id", "row"), order).alias("keep"), F.count(F.lit(1)).alias("group_size")]


def _decided(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """``rows`` with keep (doc_id and row of the one that stays) and group_size."""
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    # Only what more than one row may share is heavy; the sketch never underestimates by more than its error.
    candidates = sketch.select(F.explode("top").alias("t")).where(F.col("t.count") > 1).select(F.col("t.item").alias("text_sha256"))
    verified = rows.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*_winner())
    split = rows.join(F.broadcast(verified), "text_sha256", "left")
    decided = split.where(F.col("group_size").isNotNull())
    rest = split.where(F.col("group_size").isNull()).drop("keep", "group_size")
    return decided.unionByName(rest.join(rest.groupBy("text_sha256").agg(*_winner()), "text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    # Texts are read once; the numbers of rows are fixed by the checkpoint.
    rows = checkpointed(digests(docs, F.monotonically_increasing_id(), F.col(doc_id), F.col(text)))
    return _decided(rows, heavy, tracked).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The documents that stay, one row of each group of equal texts, with all their columns."""
    source = numbered(docs)
    rows = checkpointed(digests(source, F.col("row"), F.col(f"__row.`{doc_id}`"), F.col(f"__row.`{text}`")))
    return without(source, _decided(rows, heavy, tracked).where("row <> keep.row"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         (array_agg(doc_id ORDER BY n_points DESC, doc_id ASC NULLS LAST))[1] AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

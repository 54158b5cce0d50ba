"""Substring dedup by relative Lempel-Ziv parsing against everything that comes earlier.

The reference is the corpus itself. Its blocks are cut where the content says so: of the 15 runs of 6 words in a window
of 20 words, the one with the least hash is the window's anchor, and the neighbouring windows with one anchor make one
block (20 to 34 words). The index of all blocks is the shuffle on the anchor's hash: it holds each anchor's first place
and whether all its blocks read the same. Equal windows have equal anchors at equal distances, so every window of every
document meets every earlier window it could equal in that index, while one row stands for seven windows or so.

A document is then factored greedily: a block that reads like an earlier one points to the first such place, and
neighbouring blocks that point to neighbouring places merge into one factor (start, length, ref_doc_id, ref_start) of 20
words or more. Where an anchor has blocks that read differently, that is, at the ends of factors, the windows of the
first block of each reading are looked up one by one, so that no factor is cut short at a boundary. Factors' words are
the duplicate spans. Blocks and windows count as alike only if 128 bits of BLAKE2b over their words, joined by one space,
are; quick hashes merely choose the anchors.

Every row is a document of its own. Rows are numbered in the order of their ids, rows with one id in the order of their
texts' xxhash64; a table that lies in order, each id once, is numbered as it lies, any other is sorted first. So rows that
repeat an id, or have none, are judged by their texts like others. Anchors, readings and windows with very many copies are
pre-aggregated before each shuffle (only their first place is kept); the joins back are plain equi-joins with one row a
key on the other side, which adaptive execution splits.

Edge cases: null text has no words; texts of fewer than 20 words have no window; a null id comes before all others; of
rows with one id, and of whole rows that repeat, the one numbered first is the earlier; an empty table gives an empty
result; other columns are not looked at. Of equal rows all but one lose every word that a window covers. Ids may be any 64-bit numbers; rows times the words of the longest text may be
2^59.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Windows, Words, chunks, numbered, signed, written

WINDOW, ANCHOR = 20, 6
SPAN = WINDOW - ANCHOR + 1


def _leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width`` values."""
    p, have = np.arange(len(v)), 1
    while have < width:
        by = min(have, width - have)
        less = v[by:] < v[:-by]
        v, p = np.where(less, v[by:], v[:-by]), np.where(less, p[by:], p[:-by])
        have += by
    return p


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, Words]:
    """The texts' words, one space between them, and where they are."""
    raw, at = data.tobytes(), offsets.tolist()
    texts = [b" ".join(raw[b:e].split()) for b, e in zip(at[:-1], at[1:])]
    joined = b"".join(texts)
    return joined, Words(np.frombuffer(joined, np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """128 bits of each span, as two columns."""
    own = b"".join([hashlib.blake2b(raw[b:e], digest_size=16).digest() for b, e in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(own, np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _anchored(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """Blocks: anchor's hash, digest of the reading, packed place (rank, first window, windows beyond the first)."""
    for batch in batches:
        rank = batch.column(0).to_numpy()
        for i, _, data, offsets in chunks(batch.column(1)):
            raw, words = _spaced(data, offsets)
            n = len(words)
            if n < WINDOW:
                continue
            runs = Windows(words.hashes()).of(np.arange(n - ANCHOR + 1), ANCHOR)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
            windows = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= words.first[1:][doc[: n - WINDOW + 1]])
            if not len(windows):
                continue
            at = _leftmost_minimum(runs, SPAN)[windows]
            begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            a, q = windows[begins], at[begins]
            more = windows[np.append(begins[1:] - 1, len(windows) - 1)] - a
            reading = _digests(raw, words.starts[a], words.ends[a + more + WINDOW - 1])
            place = (rank[i + doc[a]] << shift) | ((a - words.first[doc[a]]) << 4) | more
            yield pa.RecordBatch.from_arrays([signed(runs[q]), *reading, signed(place)], ["h", "c1", "c2", "pos"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the row of each, of a list column without nulls in the lists."""
    n = np.diff(column.offsets.to_numpy())
    if column.null_count:
        n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, n)
    return column.flatten(), np.repeat(np.arange(len(column)), n)


def _single_windows(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """Each window of the listed blocks: its digest and its packed place."""
    for batch in batches:
        rank = batch.column(0).to_numpy()
        places, row = _lists(batch.column(2))
        places = places.to_numpy()
        for i, j, data, offsets in chunks(batch.column(1)):
            own = places[(row >= i) & (row < j)]
            if not len(own):
                continue
            doc = row[(row >= i) & (row < j)] - i
            raw, words = _spaced(data, offsets)
            n = (own & 15) + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(doc, n)
            start = np.repeat((own & ((1 << shift) - 1)) >> 4, n) + step
            at = start + words.first[doc]
            reading = _digests(raw, words.starts[at], words.ends[at + WINDOW - 1])
            yield pa.RecordBatch.from_arrays([*reading, signed((rank[i + doc] << shift) | (start << 4))], ["c1", "c2", "pos"])


_PART = 33  # a row's number is its partition's, then 33 bits within it


def _in_order(source: DataFrame) -> tuple[list[tuple[int, int]], int] | None:
    """(partition, rows before it) of a numbered table whose rows lie in the order of ids, each of which stands once, and
    the longest text's bytes; None if they don't. Partitions, one a task that wrote them, may lie in any order among themselves."""
    part = F.shiftright("row", _PART).alias("part")
    before = F.lag("id").over(W.partitionBy("part").orderBy("row"))
    steps = source.select(part, "row", "id", "size").withColumn("broken", F.col("id").isNull() | F.coalesce(before >= F.col("id"), F.lit(False)))
    parts = steps.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("broken").alias("broken"), F.max("size").alias("size")).collect()
    if any(p["broken"] for p in parts):
        return None
    parts.sort(key=lambda p: (p["low"], p["high"]))
    if any(a["high"] >= b["low"] for a, b in zip(parts, parts[1:])):
        return None
    return _bases(parts)


def _bases(parts: list) -> tuple[list[tuple[int, int]], int]:
    total = np.cumsum([0] + [p["n"] for p in parts]).tolist()
    return [(p["part"], t) for p, t in zip(parts, total)], max((p["size"] for p in parts), default=0)


class _Parsed:
    """The documents, ranked, and the places that repeat earlier ones."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        text = F.coalesce(F.col(text), F.lit(""))
        columns = {"id": F.col(doc_id).cast("long"), "text": text, "size": F.octet_length(text)}
        source = numbered(docs, **columns)
        bases = _in_order(source)
        if bases is None:
            source = numbered(docs.select(*(c.alias(name) for name, c in columns.items())).orderBy(F.asc_nulls_first("id"), F.xxhash64("text")), **{name: F.col(name) for name in columns})
            parts = source.groupBy(F.shiftright("row", _PART).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
            bases = _bases(sorted(parts.collect(), key=lambda p: p["part"]))
        bases, longest = bases
        self.shift = (longest // 2 + 2).bit_length() + 4
        frame = source.sparkSession.createDataFrame(bases, "part long, base long")  # a row a partition
        ranked = source.join(F.broadcast(frame), F.shiftright("row", _PART) == F.col("part"))
        rank = (F.col("base") + F.col("row").bitwiseAND(F.lit((1 << _PART) - 1))).alias("rank")
        if source.count().bit_length() + self.shift > 63:
            raise ValueError("rows times the words of the longest text exceed 2^59")
        self.docs = ranked.select(rank, F.col("id").alias("doc_id"), "text")

    def repeats(self) -> DataFrame:
        """pos, ref: packed places of blocks (or single windows) that read like an earlier place."""
        shift, alike = self.shift, ["c1", "c2"]
        source = self.docs.select("rank", "text")
        blocks = source.mapInArrow(lambda it: _anchored(it, shift), "h long, c1 long, c2 long, pos long")
        differ = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
        index = written(  # an exchange of its own on either side of the join lets adaptive execution split hot anchors
            blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), differ.alias("differ"), F.min("pos").alias("ref")).where("n > 1").drop("n")
        )
        met = blocks.join(index, "h").where("differ or pos > ref")
        met = written(met.select(*(F.when(F.col("differ"), F.col(x)).alias(x) for x in alike), "pos", "ref", "differ"))
        same = met.where("not differ").select("pos", "ref")
        unlike = met.where("differ").select(*alike, "pos")
        first = written(unlike.groupBy(*alike).agg(F.min("pos").alias("ref")))
        again = unlike.join(first, alike).where("pos > ref").select("pos", "ref")
        # The first block of each reading: its windows may be in blocks that read otherwise.
        listed = written(first.groupBy(F.shiftright("ref", shift).alias("rank")).agg(F.collect_list("ref").alias("places")))
        windows = written(source.join(listed, "rank").mapInArrow(lambda it: _single_windows(it, shift), "c1 long, c2 long, pos long"))
        seen = written(windows.groupBy(*alike).agg(F.min("pos").alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        edges = windows.join(seen, alike).where("pos > ref").select("pos", "ref")
        return same.unionByName(again).unionByName(edges)

    def with_repeats(self) -> DataFrame:
        """The documents, each with its list of (pos, ref)."""
        per_doc = self.repeats().groupBy(F.shiftright("pos", self.shift).alias("rank")).agg(F.collect_list("pos").alias("pos"), F.collect_list("ref").alias("ref"))
        return self.docs.join(per_doc, "rank", "left")


def _factors(pos: np.ndarray, ref: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of one document: start, length, ref row, ref start. Blocks that go on at the same distance merge."""
    mask = (1 << shift) - 1
    order = np.argsort(pos & mask, kind="stable")
    pos, ref = pos[order], ref[order]
    start, more, ref_row, ref_start = (pos & mask) >> 4, pos & 15, ref >> shift, (ref & mask) >> 4
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (start[1:] > start[:-1] + more[:-1] + 1) | (ref_row[1:] != ref_row[:-1]) | (ref_start[1:] - start[1:] != ref_start[:-1] - start[:-1])
    begins = np.flatnonzero(new)
    ends = np.maximum.reduceat(start + more + WINDOW, begins)
    return start[begins], ends - start[begins], ref_row[begins], ref_start[begins]


REMOVAL_SCHEMA = "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string"


def factorise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The factors of all documents: doc_id, start and length in words, ref_doc_id and ref_start of the earlier place."""
    parsed = _Parsed(docs, doc_id, text)
    shift = parsed.shift

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, pos, ref in zip(*(batch.column(k).to_pylist() for k in range(3))):
                start, length, ref_rank, ref_start = _factors(np.array(pos), np.array(ref), shift)
                columns = [pa.array([ident] * len(start), pa.int64()), *map(pa.array, (start, length, ref_rank, ref_start))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ref_rank", "ref_start"])

    found = parsed.with_repeats().where("pos is not null").select("doc_id", "pos", "ref")
    found = found.mapInArrow(rows, "doc_id long, start long, length long, ref_rank long, ref_start long")
    ids = parsed.docs.select(F.col("rank").alias("ref_rank"), F.col("doc_id").alias("ref_doc_id"))
    return found.join(ids, "ref_rank").select("doc_id", "start", "length", "ref_doc_id", "ref_start")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, n_factors, kept_sha256 and, if wanted, kept_text."""
    parsed = _Parsed(docs, doc_id, text)
    shift = parsed.shift

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (pos, row), (ref, _) = _lists(batch.column(2)), _lists(batch.column(3))
            pos, ref = pos.to_numpy(), ref.to_numpy()
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            texts = batch.column(1).cast(pa.binary())
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                words = texts[k].as_py().split()
                kept, n_factors = words, 0
                if at[k] < at[k + 1]:
                    start, length, _, _ = _factors(pos[at[k] : at[k + 1]], ref[at[k] : at[k + 1]], shift)
                    n_factors = len(start)
                    depth = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
                    kept = list(compress(words, (np.cumsum(depth)[:-1] == 0).tolist()))
                joined = b" ".join(kept)
                for column, x in zip(out, (len(words), len(words) - len(kept), n_factors, hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None)):
                    column.append(x)
            names = ["doc_id", "n_words", "n_removed", "n_factors", "kept_sha256", "kept_text"]
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names[: 5 + with_text])

    ready = parsed.with_repeats().select("doc_id", "text", "pos", "ref")
    return ready.mapInArrow(rows, REMOVAL_SCHEMA + ", kept_text string" * with_text)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, (SELECT unnest(range(0, 20)) AS k)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

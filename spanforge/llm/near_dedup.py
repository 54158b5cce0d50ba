"""Near dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five consecutive words (all words of a shorter text). Its weight in a document is
``(1 + DAMPING * ln tf) * (1 + DAMPING * ln((N + 1) / (df + 1)) / ln(N + 1))``. Both factors are damped, so that 0.8 in
weights is close to 0.8 in shingles: a large group of copies, which makes its own shingles frequent, does not fall apart,
nor does a text and the same text with its paragraphs repeated. Document frequencies come from a count-min sketch of
fixed size over all documents, less the mean load of a cell; its error is a constant share of N, whatever N is.

Texts with equal words (by 128 bits of BLAKE2b over them) are one node. ``BANDS`` x ``ROWS`` consistent weighted samples
of each are banded (a pair of similarity 0.8 shares no band with a chance of 4e-5); two neighbouring bands together make
as many finer ones, in which nodes meet those most like them. In a bucket of at most ``HUBS`` nodes all meet; in a larger
one every node meets ``HUBS`` hubs: those two that meet the most others in all their buckets, which lie in the middle of
their group, and two by hashes that differ between bands. Buckets make stars, never all pairs, and a group is tied
together through up to a hundred hubs. The middle ones of the first bands come first; of all others only pairs not yet
in one class remain. A pair is a link if the exact weighted Jaccard similarity of both whole texts reaches the threshold.
Classes are connected components, found in Spark.

What hubs leave apart is found by an exact prefix filter over the nodes of those buckets that hold more than one class
then. All texts order their shingles alike, the rarest of the sketch first. Up to the first shingle that two texts share,
neither has any of the overlap, so a pair that reaches the threshold shares a shingle behind which both still have enough
weight for it: one of the first tenth or so of the lighter text and of the first fifth of the other. Pairs of different
classes that meet so are verified, all of them. So no two texts that share a bucket stay apart wrongly.

Verification reads a hub's text once for at most ``GROUP`` of its members, and deals these groups out, so that a hub of
very many is no hot key.

Edge cases: null text is empty; texts without words are alike to nothing. Rows are told apart by a number of their own:
rows that repeat an id are judged by their texts; a class has the least id in it as its name (null if it has none but
null ids) and keeps the row with that id, of several the one that is read first. An empty table gives an empty result;
other columns are not looked at, and stay as they are where documents are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, Words, chunks, mix, numbered, signed, without, written
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, FIRST_BANDS = 14, 3, 3
HUBS, GROUP = 4, 64
DAMPING = 0.05
CELLS = 1 << 16  # of each of the two rows of the sketch
SLACK = 1e-9  # for sums in another order
_SIZE = 1 << 16


class Weights:
    """Damped term and inverse document frequencies, the latter from the sketch."""

    def __init__(self, n_docs: int, cells: np.ndarray):
        self.n = max(1, n_docs)
        self.cells = np.maximum(0, cells - cells.mean(axis=1, keepdims=True))

    def df(self, shingles: np.ndarray) -> np.ndarray:
        df = np.minimum(self.cells[0][shingles >> np.uint64(48)], self.cells[1][(shingles >> np.uint64(32)) & np.uint64(CELLS - 1)])
        return np.clip(df, 1, self.n)

    def of(self, shingles: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = 1 + DAMPING * np.log((self.n + 1) / (self.df(shingles) + 1)) / np.log(self.n + 1)
        return (1 + DAMPING * np.log(tf)) * idf


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles, in order, and their counts, text after text, and the texts' offsets in them."""
    words = Words(data, offsets)
    n, first = len(words), words.first
    runs = Windows(words.hashes())
    every = runs.of(np.arange(n - SHINGLE + 1), SHINGLE) if n >= SHINGLE else np.zeros(0, np.uint64)
    found, tf = [], []
    for b, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - b >= SHINGLE:
            h, c = np.unique(every[b : e - SHINGLE + 1], return_counts=True)
        else:
            h = runs.of(np.array([b]), e - b) if e > b else np.zeros(0, np.uint64)
            c = np.ones(len(h), np.int64)
        found.append(h)
        tf.append(c)
    at = np.append(0, np.cumsum([len(h) for h in found]))
    return (np.concatenate(found), np.concatenate(tf), at) if found else (every, every.astype(np.int64), at)


class Sampler:
    """Consistent weighted samples: r, c ~ Gamma(2, 1), beta ~ U(0, 1) of each shingle, from tables by hash."""

    def __init__(self, samples: int):
        rng = np.random.default_rng(20100)
        self.r = rng.gamma(2, 1, _SIZE)
        self.log_c = np.log(rng.gamma(2, 1, _SIZE))
        self.beta = rng.random(_SIZE)
        self.factors = rng.integers(1, 1 << 63, samples, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, h: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row a text (each has a shingle at least), one column a sample: bits that name the sampled shingle and level."""
        log_w, low = np.log(weight), np.uint64(0xFFFF)
        out = np.empty((len(at) - 1, len(self.factors)), np.uint64)
        for k, factor in enumerate(self.factors):
            x = h * factor
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            r = self.r[x >> np.uint64(48)]
            beta = self.beta[(x >> np.uint64(16)) & low]
            level = np.floor(log_w / r + beta)
            value = self.log_c[(x >> np.uint64(32)) & low] - r * (level - beta + 1)
            out[:, k] = np.minimum.reduceat(value, at[:-1]).view(np.uint64)
        return out


def sketch(docs: DataFrame) -> Weights:
    """``docs``: text. Document frequencies of all shingles; each task sends its cells' sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(2 * CELLS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in chunks(batch.column(0)):
                h = shingles(data, offsets)[0]
                cells[:CELLS] += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=CELLS)
                cells[CELLS:] += np.bincount(((h >> np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.append(np.flatnonzero(cells), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(cells, n)[at])], ["cell", "n"])

    total, n_docs = np.zeros(2 * CELLS, float), 0
    for cell, n in docs.select("text").mapInArrow(rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 2 * CELLS + 1 rows at most
        if cell < 0:
            n_docs = n
        else:
            total[cell] = n
    return Weights(n_docs, total.reshape(2, CELLS))


def prefixes(h: np.ndarray, w: np.ndarray, at: np.ndarray, df: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's shingles, the rarest first, as long as those left have ``similarity`` of its weight: the prefixes'
    offsets, shingles, weights left (with the shingle's own), and each text's whole weight."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((df, text))  # equal ones by hash, as they come
    ends = np.append(0.0, np.cumsum(w[order]))
    left = ends[at[1:]][text] - ends[:-1]
    total = ends[at[1:]] - ends[at[:-1]]
    some = left >= similarity * total[text] * (1 - SLACK)
    return np.append(0, np.cumsum(np.bincount(text[some], minlength=len(at) - 1))), h[order][some], left[some], total


def _signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """Per document: row, id, digest of its words, its bands' keys (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weigh = Sampler(BANDS * ROWS), shared.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                h, tf, at = shingles(data, offsets)
                some = np.flatnonzero(np.diff(at))
                keys = np.zeros((j - i, BANDS), np.uint64)
                if len(some):
                    samples = sampler.sample(h, weigh.of(h, tf), np.append(at[some], at[-1]))
                    key = np.zeros((len(some), BANDS), np.uint64)
                    for k in range(ROWS):
                        key = mix(key * np.uint64(0x100000001B3) + samples[:, k::ROWS])
                    keys[some] = key
                raw, ends = data.tobytes(), offsets.tolist()
                digest = b"".join(hashlib.blake2b(b" ".join(raw[b:e].split()), digest_size=16).digest() for b, e in zip(ends[:-1], ends[1:]))
                digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), signed(keys.ravel()))
                bands = pa.ListArray.from_arrays(bands.offsets, bands.values, mask=pa.array(np.diff(at) == 0))
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "d1", "d2", "bands"])

    return docs.select("row", "id", "text").mapInArrow(rows, "row long, id long, d1 long, d2 long, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Those of the pairs hub, member whose weighted Jaccard similarity reaches ``similarity``, as a, b. ``docs``: row, text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, the hub's text first."""
        weigh, hub_h, hub_w = shared.value, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(3)):
                h, tf, at = shingles(data, offsets)
                w = weigh.of(h, tf)
                hub, member = batch.column(0).slice(i, j - i).to_numpy(), batch.column(2).slice(i, j - i)
                heads = np.flatnonzero(member.is_null().to_numpy(zero_copy_only=False))
                good = []
                for b, e in zip(np.append(-1, heads).tolist(), np.append(heads, j - i).tolist()):
                    if b >= 0:
                        hub_h, hub_w = h[at[b] : at[b + 1]], w[at[b] : at[b + 1]]
                    if e == b + 1 or not len(hub_h):
                        continue
                    own, own_w = h[at[b + 1] : at[e]], w[at[b + 1] : at[e]]
                    text = np.repeat(np.arange(e - b - 1), np.diff(at[b + 1 : e + 1]))
                    place = np.minimum(np.searchsorted(hub_h, own), len(hub_h) - 1)
                    both = np.where(hub_h[place] == own, np.minimum(own_w, hub_w[place]), 0.0)
                    overlap = np.bincount(text, both, e - b - 1)
                    total = np.bincount(text, own_w, e - b - 1) + hub_w.sum() - overlap
                    good.append(b + 1 + np.flatnonzero(overlap >= similarity * total * (1 - SLACK)))
                hub_h, hub_w = hub_h.copy(), hub_w.copy()
                if good and len(good := np.concatenate(good)):
                    yield pa.RecordBatch.from_arrays([pa.array(hub[good]), member.take(pa.array(good))], ["a", "b"])

    groups = written(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("groups")))
    dealt = pairs.join(groups, "hub").select("hub", F.pmod(F.xxhash64("member"), "groups").alias("part"), "member")
    dealt = written(dealt)
    wanted = dealt.select("hub", "part", "member", F.col("member").alias("row")).unionByName(
        dealt.groupBy("hub", "part").agg(F.first("hub").alias("row")).select("hub", "part", F.lit(None).cast("long").alias("member"), "row")
    )
    texts = wanted.join(docs.hint("merge"), "row").select("hub", "part", "member", "text")
    return texts.repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("member")).mapInArrow(rows, "a long, b long")


def _unmet(docs: DataFrame, classes: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Pairs hub, member in different classes that may reach ``similarity``, of the nodes in ``classes`` (node, class)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    least = 2 * similarity / (1 + similarity) * (1 - SLACK)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                h, tf, at = shingles(data, offsets)
                ends, rare, left, total = prefixes(h, weigh.of(h, tf), at, weigh.df(h), similarity)
                text = np.repeat(np.arange(j - i), np.diff(ends))
                own = [batch.column(k).slice(i, j - i).take(pa.array(text)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([signed(rare), *own, pa.array(left), pa.array(total[text])], ["key", "node", "class", "left", "total"])

    texts = classes.join(docs, F.col("node") == F.col("row")).select("node", "class", "text")
    rows = texts.mapInArrow(found, "key long, node long, class long, left double, total double").withColumn("early", F.col("left") >= least * F.col("total"))
    rows = written(rows)
    alive = written(rows.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("early").alias("early")).where("low <> high and early").select("key"))
    rows = written(rows.join(alive, "key"))
    # A key is of no use if all its nodes have one and the same key before it: they meet there, with more weight left.
    # So a passage that many texts hold makes its pairs once, not once a shingle.
    before = written(rows.groupBy("node").agg(F.max_by("key", "left").alias("before")))
    useful = rows.join(before, "node").groupBy("key").agg(F.min("before").alias("low"), F.max("before").alias("high")).where("low <> high or low = key")
    rows = written(rows.join(written(useful.select("key")), "key"))
    # A pair meets if neither weighs more than the other's reach. The lighter one has the key early. Classes meet first,
    # by the least weight and the farthest reach in them, then the one's nodes meet the other class, then nodes meet.
    rows = written(rows.withColumn("reach", 2 / least * F.col("left") - F.col("total")))
    held = lambda x, some: some.groupBy("key", F.col("class").alias(f"class_{x}")).agg(F.min("total").alias(f"low_{x}"), F.max("reach").alias(f"high_{x}"))
    light, heavy = written(held("a", rows.where("early"))), written(held("b", rows))
    meet = light.join(heavy, "key").where("class_a <> class_b and low_a <= high_b and low_b <= high_a").select("key", "class_a", "class_b", "low_b", "high_b")
    of = lambda x, some: some.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "node", "total", "reach")])
    return (
        meet.join(of("a", rows.where("early")), ["key", "class_a"]).where("low_b <= reach_a and total_a <= high_b").drop("low_b", "high_b")
        .join(of("b", rows), ["key", "class_b"]).where("total_b <= reach_a and total_a <= reach_b and struct(total_a, node_a) < struct(total_b, node_b)")
        .select(F.col("node_a").alias("hub"), F.col("node_b").alias("member")).distinct()
    )


def _classified(source: DataFrame, similarity: float) -> DataFrame:
    """``source``: row, id, text. Per document row, id, class_id, class_size, kept."""
    weights = sketch(source)
    marked = written(_signatures(source, weights))
    known = marked.where("bands is not null")
    nodes = written(known.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min_by("bands", "row").alias("bands"), F.count(F.lit(1)).alias("copies")))
    finer = F.transform("bands", lambda key, i: F.xxhash64(key, F.get("bands", F.pmod(i + 1, F.lit(BANDS)))))
    banded = nodes.select("node", F.posexplode(F.concat("bands", finer)).alias("band", "key"))
    crowded = written(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(banded.join(crowded, ["band", "key"]))
    # How many a node meets in all its buckets: the nearer to the middle of its group, the more.
    central = written(members.groupBy("node").agg(F.sum("n").alias("met")))
    texts = written(source.select("row", "text").join(central.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi"))  # of those that meet any
    ranked = members.where(F.col("n") > HUBS).join(central, "node").withColumn("hash", F.xxhash64("band", "node"))
    middle = F.shiftleft("met", 20) + F.pmod("hash", F.lit(1 << 20))
    half = F.pmod("hash", F.lit(2))
    chosen = [F.max_by("node", F.when(half == 0, middle)), F.max_by("node", F.when(half == 1, middle)), F.min_by("node", "hash"), F.max_by("node", "hash")]
    few = members.where(F.col("n") <= HUBS).groupBy("band", "key").agg(F.collect_list("node").alias("hubs"))  # HUBS at most
    hubs = written(ranked.groupBy("band", "key").agg(F.array(*chosen).alias("hubs")).unionByName(few))
    is_low = F.col("hub") < F.col("node")
    pairs = (
        members.join(hubs, ["band", "key"]).select("node", "band", "n", F.posexplode("hubs").alias("nth", "hub")).where("node <> hub")
        .groupBy(F.least("node", "hub").alias("low"), F.greatest("node", "hub").alias("high"))
        .agg(
            F.min((F.col("band") >= FIRST_BANDS) | (F.col("nth") > 1) & (F.col("n") > HUBS)).alias("later"),
            F.sum(F.when(is_low, F.col("n")).otherwise(-F.col("n"))).alias("lean"),
        )
        .select(F.when(F.col("lean") >= 0, F.col("low")).otherwise(F.col("high")).alias("hub"), F.when(F.col("lean") >= 0, F.col("high")).otherwise(F.col("low")).alias("member"), "later")
    )
    pairs = written(pairs)
    links = written(_verified(pairs.where("not later").select("hub", "member"), texts, weights, similarity))
    labels = components(links)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}"))
    apart = (
        pairs.where("later").join(of("hub"), "hub", "left").join(of("member"), "member", "left")
        .where(F.coalesce("of_hub", "hub") != F.coalesce("of_member", "member")).select("hub", "member")
    )
    links = links.unionByName(written(_verified(written(apart), texts, weights, similarity)))
    labels = components(links)
    class_of = F.coalesce("label", "node").alias("class")
    sorted_out = members.where(F.col("n") > HUBS).join(labels, "node", "left").select("band", "key", "node", class_of)
    mixed = written(sorted_out.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band", "key"))
    suspects = written(sorted_out.join(mixed, ["band", "key"]).groupBy("node").agg(F.first("class").alias("class")))
    if not suspects.isEmpty():
        rest = written(_verified(written(_unmet(texts, suspects, weights, similarity)), texts, weights, similarity))
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))
    copied = nodes.where("copies > 1").select("d1", "d2", "node")
    out = (
        marked.select("row", "id", F.when(F.col("bands").isNotNull(), F.col("d1")).alias("d1"), "d2").join(copied, ["d1", "d2"], "left")
        .select("row", "id", F.coalesce("node", "row").alias("node")).join(labels, "node", "left").select("row", "id", F.coalesce("label", "node").alias("class"))
    )
    out = written(out)
    first = F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first")
    classes = written(out.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"), first).where("n > 1"))
    return out.join(classes, "class", "left").select(
        "row", "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"),
    )


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, class_id (least id of its class), class_size, kept."""
    source = numbered(docs, id=F.col(doc_id).cast("long"), text=F.col(text))
    return _classified(source, similarity).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the least id, with all columns."""
    rows = numbered(docs)
    source = rows.select("row", F.col(f"__row.`{doc_id}`").cast("long").alias("id"), F.col(f"__row.`{text}`").alias("text"))
    return without(rows, _classified(source, similarity).where(~F.col("kept")))

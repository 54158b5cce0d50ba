import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import exact_dedup, graph, near_dedup, substring_dedup

from .conftest import SCHEMA, corpus

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


def remaining(rows):
    """(id, number of words, number removed, digest of what stays) of each row; ``rows``: id, text, in order."""
    seen, out = {}, []
    for at, (doc_id, text, *_) in enumerate(rows):
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if seen.setdefault(key, (at, i)) != (at, i):
                keep[i : i + 20] = [False] * 20
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((doc_id, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def without_repeats(rows):
    return {r[0]: r[1:] for r in remaining(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))}


def in_order(df):
    """id and text of each row in the order of substring dedup."""
    rows = df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()
    return sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


@pytest.mark.parametrize("seed", [0, 1])
def test_substrings_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == without_repeats(rows)


def test_factors_are_true_copies(spark, docs, rows):
    text = {r[0]: words(r[1]) for r in rows}
    factors = substring_dedup.factorise(docs).collect()
    assert factors
    for f in factors:
        assert f["length"] >= 20 and (f["ref_doc_id"], f["ref_start"]) < (f["doc_id"], f["start"])
        own, ref = text[f["doc_id"]][f["start"] : f["start"] + f["length"]], text[f["ref_doc_id"]][f["ref_start"] : f["ref_start"] + f["length"]]
        assert len(own) == f["length"] and own == ref
    covered = defaultdict(set)
    for f in factors:
        covered[f["doc_id"]].update(range(f["start"], f["start"] + f["length"]))
    expected = without_repeats(rows)
    assert all(len(covered[d]) == expected[d][1] for d in text)


def found_remaining(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect())


def test_substrings_odd_rows(spark, odd_docs, no_docs):
    found = substring_dedup.remove_repeats(odd_docs, with_text=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == Counter(remaining(in_order(odd_docs)))
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found)
    assert substring_dedup.remove_repeats(no_docs).count() == 0 and substring_dedup.factorise(no_docs).count() == 0


def test_substrings_of_repeated_null_and_wide_ids(spark):
    passage = lambda k: " ".join(f"{k}-{i}" for i in range(25))
    rows = [(1, passage("P")), (5, passage("P")), (5, passage("U"))]
    rows += [(None, passage("A") + " x " + passage("P")), (None, passage("A")), (None, passage("B")), (None, None)]
    rows += [(-(2**63), passage("low")), (2**63 - 1, passage("low")), (2**62, passage("B")), (-(2**62), passage("U") + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_remaining(df) == Counter(remaining(in_order(df)))
    untouched = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()}
    assert untouched == {(1, 0), (5, 25), (5, 0)}


def thue_morse(bits, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(1 << bits)]


def test_words_of_the_same_polynomial_are_told_apart(spark):
    """Two sequences that any polynomial modulo 2^64 maps to one number, as signs of a word and as words of a text."""
    one, other = "".join(thue_morse(11, "a", "b")), "".join(thue_morse(11, "b", "a"))
    around = [f"w{i}" for i in range(26)]
    df = spark.createDataFrame([(1, " ".join([*around[:13], one, *around[13:]])), (2, " ".join([*around[:13], other, *around[13:]]))], "doc_id long, text string")
    assert found_remaining(df) == Counter(remaining(in_order(df)))
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == {0}
    texts = spark.createDataFrame([(1, " ".join(thue_morse(12, "aa", "bb"))), (2, " ".join(thue_morse(12, "bb", "aa")))], "doc_id long, text string")
    assert found_remaining(texts) == Counter(remaining(in_order(texts)))


@pytest.mark.parametrize("order", [["doc_id"], ["text"]])
def test_substrings_whatever_the_order_of_rows(spark, docs, rows, order):
    found = substring_dedup.remove_repeats(docs.repartition(3).sortWithinPartitions(*order))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == without_repeats(rows)
    lying = docs.orderBy("doc_id")
    assert substring_dedup._in_order(substring_dedup.numbered(lying.select(F.col("doc_id").alias("id"), "text"), id=F.col("id"), text=F.col("text"), size=F.octet_length("text"))) is not None


def test_exact_equals_sql(spark, docs, rows):
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in rows])
    expected = duck.sql(exact_dedup.ORACLE_SQL)
    found = exact_dedup.exact_dedup(docs)
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(expected.fetchall())
    small = exact_dedup.exact_dedup(docs, heavy=2, tracked=8)  # nearly all digests shuffled
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found.collect()))


def test_exact_odd_rows(odd_docs, no_docs):
    found = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(found) == odd_docs.count() and sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})
    stay = exact_dedup.drop_exact_copies(odd_docs)
    assert stay.columns == odd_docs.columns
    left = [re.sub(WS, "", r["text"] or "") for r in stay.collect()]
    assert sorted(left) == sorted({re.sub(WS, "", r["text"] or "") for r in odd_docs.collect()})
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.drop_exact_copies(no_docs).columns == no_docs.columns


def test_exact_drops_rows_not_ids(spark):
    rows = [(1, "alpha beta"), (1, "gamma delta"), (7, "gamma  delta   "), (9, "same row"), (9, "same row"), (None, "no id"), (None, "no id"), (None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(1, "alpha beta"), (7, "gamma  delta   "), (9, "same row"), (None, "no id"), (None, "other")]
    for options in ({}, {"heavy": 1, "tracked": 4}):
        assert sorted(map(tuple, exact_dedup.drop_exact_copies(df, **options).collect()), key=repr) == sorted(expected, key=repr)
    kept = [r["text_sha256"] for r in exact_dedup.exact_dedup(df).collect() if r["kept"]]
    assert len(kept) == len(set(kept)) == 5


def shingle_sets(rows):
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        out[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_near_classes_equal_brute_force(docs, rows):
    sets = shingle_sets(rows)
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    found = {r["doc_id"]: r for r in near_dedup.near_classes(docs).collect()}
    assert {d: found[d]["class_id"] for d in ids} == {d: top(d) for d in ids}
    sizes = Counter(top(d) for d in ids)
    assert all(found[d]["class_size"] == sizes[top(d)] and found[d]["kept"] == (d == top(d)) for d in ids)


def test_near_pairs_in_a_template_family(spark):
    """Form letters below the threshold to each other and to all hubs; pairs of them share one more slot."""
    rng = np.random.default_rng(3)
    letter = [f"t{i}" for i in range(204)]

    def filled(slots):
        out = list(letter)
        for at, word in zip(range(20, 204, 40), slots):
            out[at] = word
        return " ".join(out)

    new = lambda: f"s{rng.integers(1 << 60)}"
    rows = [(i, filled([new() for _ in range(5)])) for i in range(600)]
    for i in range(0, 200, 2):
        shared = new()
        rows[i], rows[i + 1] = [(k, filled([shared] + [new() for _ in range(4)])) for k in (i, i + 1)]
    sets = shingle_sets(rows)
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) == pytest.approx(180 / 220)
    assert len(sets[1] & sets[2]) / len(sets[1] | sets[2]) == pytest.approx(175 / 225)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 if i < 200 else i for i in range(600)}


def test_near_copies_that_repeat(spark):
    """A text and the same text written many times have nearly equal sets and far weights."""
    rng = np.random.default_rng(4)
    once = [" ".join(f"w{k}" for k in rng.integers(1 << 40, size=204)) for _ in range(12)]
    rows = [(2 * i + k, t) for i, text in enumerate(once) for k, t in enumerate((text, " ".join([text] * (10 if i % 2 else 30))))]
    sets = shingle_sets(rows)
    assert all(len(sets[i] & sets[i + 1]) >= 0.95 * len(sets[i] | sets[i + 1]) for i in range(0, 24, 2))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(24)}


def test_near_drops_rows_not_ids(spark):
    rng = np.random.default_rng(6)
    text = lambda: [f"w{k}" for k in rng.integers(1 << 40, size=100)]
    near = lambda w: " ".join([*w[:-1], "other"])
    u, v, x = text(), text(), text()
    rows = [(None, " ".join(u)), (None, near(u)), (4, " ".join(v)), (4, " ".join(x)), (9, near(x)), (None, near(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"], r["kept"]) for r in near_dedup.near_classes(df).collect())
    assert found == sorted([(0, 0, 2, True), (0, 0, 2, False), (4, 4, 2, True), (4, 4, 2, True), (9, 4, 2, False), (0, 4, 2, False)])
    left = near_dedup.drop_near_copies(df).collect()
    assert len(left) == 3 and {(4, " ".join(v)), (4, " ".join(x))} <= set(map(tuple, left))


def test_near_verifies_in_groups(spark):
    """A hub of more members than a group holds, and texts that no batch holds together."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(60, 90)) for i in range(400))]
    assert {r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_near_odd_rows(odd_docs, no_docs):
    found = near_dedup.near_classes(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert sum(r["kept"] for r in found) == near_dedup.drop_near_copies(odd_docs).count()
    assert all(r["class_id"] is None and r["kept"] and r["class_size"] == 1 for r in found if r["doc_id"] is None)
    assert near_dedup.drop_near_copies(odd_docs).columns == odd_docs.columns
    assert near_dedup.near_classes(no_docs).count() == 0 and near_dedup.drop_near_copies(no_docs).count() == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 600, dtype=np.int64).astype(np.uint64)
    w = rng.uniform(0.5, 3, 600)
    v = np.where(rng.random(600) < 0.3, w * rng.uniform(0.5, 1.5, 600), w)
    v[:60] = 1e-9
    expected = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    sampler, at = near_dedup.Sampler(2000), np.array([0, 600])
    same = (sampler.sample(h, w, at) == sampler.sample(h, v, at)).mean()
    assert abs(same - expected) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201), (201, 202), (202, 200)]
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

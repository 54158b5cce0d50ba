import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import mixing, packing
from spanforge.llm.queries import oracle_sql, queries, word_tokenizer

from .test_dedup import shingle_sets, words

SF = "/root/testdata/sf0.001"


def checked_sequences(rows, most):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= most
    return len(held)


def expected_pieces(rows, most):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    out = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(-(-len(ids) // most)):
            part = ids[k * most : (k + 1) * most]
            out[doc_id, k, k * most, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("most,shard_bytes", [(4096, 1 << 24), (64, 20_000)])
def test_packing_equals_the_tokenizer(spark, docs, rows, most, shard_bytes):
    extra = [
        (10**6, "A.B,c;d:E!f?g#h$i%j&k*l|m 'S it's don't. I'LL 5.5 U.S.A. x.'s"), (10**6 + 1, "<|endoftext|> A.b <|STARTOFTEXT|> x<|startoftext|>y"),
        (10**6 + 2, "é. Éx ́ ño ẞ İ K. \xa0nbsp em\x85 \x1c\x1d"), (10**6 + 3, "日本語。テスト! 한국어 🙂🙂. a🙂"), (10**6 + 4, "x" * 20_000),
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = packing.best_fit(df, word_tokenizer(), most, shard_bytes=shard_bytes).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected_pieces([(r[0], r[1]) for r in rows] + extra, most)
    n = checked_sequences(found, most)
    shards = len({r["sequence_id"] >> 32 for r in found})
    assert n <= sum(r["length"] for r in found) / most * 1.12 + shards


def test_all_capacities_bind():
    lengths = np.random.default_rng(1).integers(1, 200, 500)
    for policy in ("norm", "dot"):
        for capacity in ((1000, 1000, 10**6), (1000, 5, 10**6), (1000, 1000, 60_000)):
            sequence, offset = packing.pack(lengths, capacity, policy)
            n = sequence.max() + 1
            tokens, documents = np.bincount(sequence, lengths), np.bincount(sequence)
            assert (tokens <= capacity[0]).all() and (documents <= capacity[1]).all() and (np.bincount(sequence, lengths**2) <= capacity[2]).all()
            least = max(lengths.sum() / capacity[0], 500 / capacity[1], (lengths**2).sum() / capacity[2])
            assert n <= 1.15 * least + 1
    with pytest.raises(ValueError):
        packing.pack(np.array([11]), (10, 10, 100))
    assert [len(x) for x in packing.pack(np.zeros(0, int), (10, 10, 100))] == [0, 0]


def plain_best_fit(lengths, capacity, policy):
    """The same in whole numbers, piece by piece over all sequences."""
    n, cap = len(lengths), [float(c) for c in capacity]
    need = [(x, 1, x * x) for x in lengths]
    mean = [sum(v[d] / cap[d] for v in need) / n for d in range(3)]
    weight = [m / sum(mean) for m in mean]
    used, out = [], [None] * n
    for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
        best = None
        for q, u in enumerate(used):
            if all(u[d] + need[i][d] <= cap[d] for d in range(3)):
                left = [(cap[d] - u[d]) / cap[d] for d in range(3)]
                v = [need[i][d] / cap[d] for d in range(3)]
                cost = sum(w * (x - y) ** 2 for w, x, y in zip(weight, left, v)) if policy == "norm" else -sum(w * x * y for w, x, y in zip(weight, left, v))
                if best is None or cost < best[0] - packing.TIE:
                    best = (cost, q)
        if best is None:
            used.append([0, 0, 0])
            best = (0.0, len(used) - 1)
        u = used[best[1]]
        out[i] = (best[1], u[0])
        for d in range(3):
            u[d] += need[i][d]
    return out


@pytest.mark.parametrize("policy", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(1000, 1000, 10**6), (1000, 12, 10**6), (1000, 30, 300_000), (4096, 4096, 4096**2)])
def test_placement_equals_plain_best_fit(policy, capacity):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        lengths = np.minimum(500, np.ceil(rng.lognormal(3.5, 1.3, 250)).astype(int))
        sequence, offset = packing.pack(lengths, capacity, policy)
        assert list(zip(sequence.tolist(), offset.tolist())) == plain_best_fit(lengths.tolist(), capacity, policy)


def test_default_limits_bind_and_cost_no_sequence():
    import pandas as pd

    rng = np.random.default_rng(3)
    lengths = np.append(rng.integers(500, 3000, 300), np.ones(2000, int))
    rows = pd.DataFrame({"doc_id": range(len(lengths)), "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0, "shard": 0})
    free, _ = packing.pack(np.sort(lengths)[::-1], (4096.0, 4096.0, 4096.0**2))
    found = packing.packer(4096, None, None, "norm")((0,), rows)
    most = found.groupby("sequence_id").size().max()
    assert found["sequence_id"].nunique() == free.max() + 1 and most < np.bincount(free).max()
    assert packing.packer(4096, 5, None, "norm")((0,), rows).groupby("sequence_id").size().max() == 5


def test_other_tokenizers_encode_whole_texts(spark, rows):
    """One that keeps case and white space is not taken word by word."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [(r[0], r[1]) for r in rows[:60]] + [(10**6, "Keeps CASE.  And   spaces ."), (10**6 + 1, None)]
    found = packing.best_fit(spark.createDataFrame(texts, "doc_id long, text string"), path).collect()
    got = {r["doc_id"]: r["ids_crc32"] for r in found if r["piece"] == 0 and r["length"] < 4096}
    for d, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        if len(ids) < 4096:
            assert got[d] == zlib.crc32(ids.tobytes())
    assert packing.WordEncoder.of(word_tokenizer()).wordwise and not packing.WordEncoder.of(path).wordwise


def test_packing_odd_rows(odd_docs, no_docs):
    found = packing.best_fit(odd_docs, word_tokenizer()).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in found}) == len(found) >= odd_docs.count()
    checked_sequences(found, 4096)
    assert packing.best_fit(no_docs, word_tokenizer()).count() == 0


def test_stages(spark):
    """Each stage against its own brute force, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept.append((before, [tuple(r) for r in docs.collect()]))
    (raw, good), (_, exact), (_, near), (_, mixed) = kept
    verdict = {r["doc_id"]: r["kept"] for r in queries()["op2_quality_rules"](spark, SF).collect()}
    assert sorted(good) == sorted(r for r in raw if verdict[r[0]])
    by_text = defaultdict(list)
    for r in good:
        by_text[hashlib.sha256("".join(words(r[1])).encode()).hexdigest()].append(r)
    assert sorted(exact) == sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in by_text.values())
    sets, group = shingle_sets(exact), {}
    for d in sorted(sets):
        near_ids = {group[o] for o in group if sets[d] & sets[o] and len(sets[d] & sets[o]) >= 0.8 * len(sets[d] | sets[o])}
        group[d] = min(near_ids | {d})
        group = {o: group[d] if g in near_ids else g for o, g in group.items()}
    assert sorted(near) == sorted(r for r in exact if group[r[0]] == r[0])
    assert set(mixed) == set(near) and max(Counter(mixed).values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == expected_pieces([(r[0], r[1]) for r in mixed], 4096)
    checked_sequences(pieces, 4096)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def tables(spark, path, rows, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_odd_rows(spark, rows, tmp_path):
    """Null and repeated ids, whole rows that repeat, nulls in every column, clashing names: every different text that
    passes the rules stays once, whatever its id."""
    unlike = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    odd = [(1, unlike("a"), "en", "s", 1), (1, unlike("b"), "en", "s", 1), (1, unlike("b"), "en", "s", 1), (None, unlike("c"), None, None, None)]
    odd += [(None, unlike("c"), None, None, None), (None, unlike("d") + " end", None, "t", None), (None, unlike("d") + " stop", "de", "t", 3), (None, None, None, None, None)]
    docs = tables(spark, str(tmp_path), rows[:60] + odd, ["kept", "row", "__row", "class", "score", "text_sha256", "node", "n"])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    left = Counter(r["text"].split()[0] for r in docs.select("text").distinct().collect())
    assert all(left[f"{k}word0"] == 1 for k in "abcd")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.count() >= docs.count()


def test_stages_on_an_empty_table(spark, rows, tmp_path):
    docs = tables(spark, str(tmp_path), rows[:2]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0


def test_mixture_comes_in_its_order(spark, docs):
    """Rows lie by block and place within it, partition after partition."""
    plan = mixing.Mixture(docs)
    order = defaultdict(list)
    for r in plan.places().collect():
        order[r["doc_id"]].append((r["block"], r["place"]))
    expected = sorted((p, d) for d, places in order.items() for p in places)
    assert [r["doc_id"] for r in plan.realised().collect()] == [d for _, d in expected]


def test_every_operator_is_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    for name, f in queries().items():
        assert f(spark, SF).count() > 0, name

"""Quality rules: countable base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over ``buckets`` hashed n-grams are counted over whole tables: the trusted target (documents labelled
quality 1) and the raw corpus (every document). N-grams are the whole words and pairs of neighbouring words; a word is
hashed by crc32, a pair by ``PAIR * crc32(first) + crc32(second)``, both modulo ``buckets``. Every bucket has ``PSEUDO``
n-grams of the raw corpus more than were counted, and the target's part of these, so that a bucket tells little until
it is well filled, and a small target does not turn against what it merely has not had yet. A document's verdict is the mean over its n-grams of
``ln p_target - ln p_raw``, held in whole millionths so that sums are exact in any order, against a fixed threshold.

Everything is built-in expressions: counts are partial sums over at most ``buckets`` keys, the weights come back to the
driver (``buckets`` numbers, whatever the input's size) and return as one array literal. What is joined with the target
ids is the words' buckets alone, two bytes each.

Edge cases: null text is a text without words; a document without words scores 0; without any trusted document all
scores are 0 and only the base rules decide; an empty table gives an empty result; repeated rows are judged alike, and
rows that repeat a trusted id are all of the target; a null id is never trusted; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import native_words

BUCKETS = 1 << 16
#: Multiplier of a pair's first word.
PAIR = 40503
#: A document stays if its mean log ratio is at least this. The raw corpus holds the target, so text of the target's
#: kind scores about 0, while n-grams of a kind that the target hardly has pull down by units each.
THRESHOLD = -0.08
#: Pseudo-count of each bucket in the raw corpus.
PSEUDO = 50
MILLION = 1_000_000
MIN_WORDS, REPEAT_PERCENT = 10, 20


def _hashes(words: Column, buckets: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))


def _features(hashes: str, buckets: int) -> Column:
    """The buckets of all words and pairs of a column of words' hashes."""
    pairs = f"""zip_with(slice({hashes}, 1, greatest(size({hashes}) - 1, 0)), slice({hashes}, 2, greatest(size({hashes}) - 1, 0)),
                         (a, b) -> cast(pmod(cast(a as bigint) * {PAIR} + b, {buckets}) as int))"""
    return F.expr(f"concat({hashes}, {pairs})")


def bucket_weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """ln p_target - ln p_raw of each bucket, in millionths. ``target``: the trusted documents' ids in a column ``doc_id``."""
    trusted = target.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().withColumn("trusted", F.lit(1))
    # Two bytes a word go through the shuffle, by the same plan at every size.
    short = "smallint" if buckets <= 1 << 16 else "int"
    hashed = docs.select(F.col(doc_id).alias("__id"), F.transform(_hashes(native_words(text), buckets), lambda h: (h - buckets // 2).cast(short)).alias("hashes"))
    hashed = hashed.join(trusted.hint("merge"), "__id", "left").withColumn("hashes", F.transform("hashes", lambda h: h.cast("int") + buckets // 2))
    counts = (
        hashed.select("trusted", F.explode_outer(_features("hashes", buckets)).alias("bucket"))  # explode would push a filter on it below the join
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"), F.count("trusted").alias("n_target"))
    )
    raw, aim = [0] * buckets, [0] * buckets
    for bucket, n_raw, n_target in counts.where("bucket is not null").collect():  # ``buckets`` rows at most
        raw[bucket], aim[bucket] = n_raw, n_target
    if not any(aim):
        return [0] * buckets
    share = sum(aim) / sum(raw)
    return [math.floor(MILLION * (math.log((a + PSEUDO * share) / (r + PSEUDO)) - math.log(share)) + 0.5) for a, r in zip(aim, raw)]


def base_rules(docs: DataFrame, text: str = "text", words: Column | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to all columns. ``words``: those of
    the text, where they are at hand."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("__words", native_words(text) if words is None else words).withColumn("__lines", lines)
    df = (
        df.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
        .withColumn(
            "__win",
            F.expr("""if(n_words >= 5, transform(sequence(0, cast(n_words - 5 as int)), i ->
                xxhash64(__hash[i], __hash[i + 1], __hash[i + 2], __hash[i + 3], __hash[i + 4])), array())"""),
        )
    )
    # Sorted windows show which of them stand more than once; each such window covers up to the next one, 5 at most.
    # sort_array compares by itself; array_sort would evaluate a lambda for each comparison.
    repeated = """
        transform(array(sort_array(transform(__win, (h, i) -> struct(h, i)))), s ->
            sort_array(transform(filter(sequence(0, size(s) - 1), j ->
                coalesce(get(s, j - 1).h = s[j].h, false) or coalesce(get(s, j + 1).h = s[j].h, false)), j -> s[j].i)))[0]"""
    covered = f"""
        transform(array({repeated}), p ->
            aggregate(sequence(0, size(p) - 1), 0L, (n, k) -> n + least(5, coalesce(get(p, k + 1) - p[k], 5))))[0]"""
    df = df.withColumn("n_repeat_words", F.expr(f"if(size(array_distinct(__win)) = size(__win), 0L, {covered})"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__words", "__lines", "__hash", "__win")


def _judged(docs: DataFrame, weights: list[int], buckets: int, threshold: float) -> DataFrame:
    """Adds the base rules' columns, score and kept. ``docs`` has its text in a column ``text``."""
    literal = "cast(split('" + ",".join(map(str, weights)) + "', ',') as array<bigint>)"
    df = docs.withColumn("__words", native_words("text")).withColumn("__hashes", _hashes(F.col("__words"), buckets)).withColumn("__features", _features("__hashes", buckets))
    df = df.withColumn("__sum", F.expr(f"aggregate(__features, 0L, (s, b) -> s + get({literal}, b))")).withColumn("__n", F.size("__features").cast("long"))
    df = df.drop("__hashes", "__features")
    score = F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n") / F.lit(float(MILLION))).otherwise(0.0)
    df = base_rules(df, words=F.col("__words")).withColumn("score", score)
    enough = F.col("__sum") >= F.lit(math.floor(threshold * MILLION + 0.5)) * F.col("__n")
    return df.withColumn("kept", ~F.col("base_failed") & enough).drop("__sum", "__n")


def quality_rules(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    weights = bucket_weights(docs, target, doc_id, text, buckets)
    judged = _judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), weights, buckets, threshold)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns, decided row by row without a join."""
    weights = bucket_weights(docs, target, doc_id, text, buckets)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("text"))
    # Filters are not pushed below observed rows. Pushed, this one would repeat all steps in itself.
    judged = _judged(packed, weights, buckets, threshold).select("__row", "kept").observe("quality", F.count(F.lit(1)).alias("n"))
    return judged.where("kept").select("__row.*")


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")


_BASE_CTES = r"""
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id)"""
_BASE_COLUMNS = """d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
       (len(w) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(w)) AS base_failed"""

#: The base rules alone.
BASE_SQL = f"""
WITH {_BASE_CTES}
SELECT {_BASE_COLUMNS}
FROM d LEFT JOIN cov USING (doc_id)
"""

#: The whole query; crc32 is computed from its definition (polynomial 0xEDB88320), once for each different word.
ORACLE_SQL = f"""
WITH {_BASE_CTES},
tab AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM word)),
bytes AS (SELECT word, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
crc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS c FROM bytes, tab),
one AS (SELECT doc_id, p, c, lead(c) OVER (PARTITION BY doc_id ORDER BY p) AS c2 FROM word JOIN crc USING (word)),
gram AS (
  SELECT doc_id, c % {BUCKETS} AS bucket FROM one UNION ALL SELECT doc_id, ({PAIR} * c + c2) % {BUCKETS} FROM one WHERE c2 IS NOT NULL),
good AS (SELECT DISTINCT doc_id, 1 AS trusted FROM labels WHERE quality = 1),
n AS (
  SELECT r.range AS bucket, coalesce(n_raw, 0) AS r, coalesce(n_target, 0) AS a FROM range({BUCKETS}) r
  LEFT JOIN (SELECT bucket, count(*) AS n_raw, count(trusted) AS n_target FROM gram LEFT JOIN good USING (doc_id) GROUP BY bucket) g ON g.bucket = r.range),
s AS (SELECT *, (sum(a) OVER ())::DOUBLE / (sum(r) OVER ())::DOUBLE AS share FROM n),
weight AS (
  SELECT bucket, CASE WHEN share > 0 THEN floor({MILLION} * (ln((a + {PSEUDO} * share) / (r + {PSEUDO})) - ln(share)) + 0.5)::BIGINT ELSE 0 END AS weight FROM s),
total AS (SELECT doc_id, sum(weight)::BIGINT AS total, count(*) AS grams FROM gram JOIN weight USING (bucket) GROUP BY doc_id),
base AS (SELECT {_BASE_COLUMNS} FROM d LEFT JOIN cov USING (doc_id))
SELECT base.*, coalesce(total::DOUBLE / grams / {MILLION}::DOUBLE, 0) AS score,
       NOT base_failed AND coalesce(total, 0) >= {math.floor(THRESHOLD * MILLION + 0.5)} * coalesce(grams, 0) AS kept
FROM base LEFT JOIN total USING (doc_id)
"""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def corpus(seed=0):
    """Documents with copies, near copies, shared passages, repeats, and every odd case."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(40, 400)) for _ in range(60)]
    passage, line = prose(rng, 60), prose(rng, 21)
    for k in range(12):
        texts.append(prose(rng, 30) + " " + passage + "\n" + prose(rng, 25 + k))
        texts.append(line + "\n" + prose(rng, 19) + "\t" + line)
    texts += [texts[3]] * 25 + [texts[4].replace(" ", " \n ")] * 2
    texts += [edited(rng, texts[5], 2 + k % 3) for k in range(15)] + [edited(rng, texts[6], 60)]
    texts += ["", None, "   \n\t ", "one", "one two three four", "one two three four", "a b c d e", "word " * 300, "x y " * 200, "\x0b\x0c", "é ü ß ñ " * 12]
    texts += [" ".join(["same"] * 19), " ".join(["same"] * 20), "Ünï cödé, wörds! " * 30, "TEXT## IN&& CAPS** " * 20, "." * 5000]
    texts.append(prose(rng, 30_000, 500))
    rng.shuffle(texts)
    rows = [(7 * k - 50, t, "en", f"src{k % 3}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """Null ids, repeated rows, and extra columns whose names clash with the operators' own."""
    more = rows[:40] + rows[:3] + [(None, "no id at all here but words enough to count as text", "en", None, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(more, SCHEMA)
    for name in ("kept", "score", "id", "h", "node", "class_id", "n_words", "text_sha256", "__row", "__id", "__gone", "__n", "features", "spans", "pos", "keep_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], k % 5 and 1, 0) for k, r in enumerate(rows)] + [(None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")

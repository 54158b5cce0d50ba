"""Parameter files of the Dakota toolkit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """position, value, name of the variables in one file.

    A line's first token is a number, its second a name; the first line has the number of variables, which follow.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("line", "text"))
    tokens = lines.select("line", F.split(F.trim("text"), r"\s+").alias("t"))
    count = F.max(F.when(F.col("line") == 0, F.col("t")[0].cast("double").cast("int")))
    held = tokens.agg(count.alias("n"), F.collect_list(F.struct("line", "t")).alias("rows"))
    return held.select("n", F.explode("rows").alias("r")).where((F.col("r.line") >= 1) & (F.col("r.line") <= F.col("n"))).select(
        (F.col("r.line") - 1).alias("position"), F.col("r.t")[0].cast("double").alias("value"), F.get(F.col("r.t"), F.lit(1)).alias("name")
    )


def template_cases(template: str, samples: DataFrame) -> DataFrame:
    """sample_idx, text: the template with every ``{name}`` replaced by the sample's value."""
    text = F.lit(template)
    for c in samples.columns:
        if c != "sample_idx":
            text = F.replace(text, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return samples.select("sample_idx", text.alias("text"))

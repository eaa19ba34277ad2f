"""String similarity as column expressions, and a vectorised Jaro-Winkler."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; equal texts are 1, and an empty one is 0 to any other."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro raised by a tenth of the rest for each of up to four equal first characters, at any Jaro."""
    j, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + 0.1 * prefix * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def grams(c: Column, low: int, high: int) -> Column:
    """All character n-grams of the lengths low to high, with repeats."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
        return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, range(low, high + 1)))


def gram_counts(df: DataFrame, key: str, text: str, low: int = 1, high: int = 3) -> DataFrame:
    """(key, gram, n)."""
    return df.select(key, F.explode(grams(F.col(text), low, high)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def cosine(left: DataFrame, right: DataFrame, a: str, b: str, weight: str = "n") -> DataFrame:
    """(a, b, cosine) of all pairs of sparse vectors that share a gram: norms and dot products are aggregates."""
    norm = lambda df, k, name: df.groupBy(k).agg(F.sqrt(F.sum(F.col(weight).cast("double") * F.col(weight))).alias(name))
    dot = left.select(a, "gram", F.col(weight).alias("_l")).join(right.select(b, "gram", F.col(weight).alias("_r")), "gram").groupBy(a, b).agg(F.sum(F.col("_l").cast("double") * F.col("_r")).alias("dot"))
    return dot.join(norm(left, a, "na"), a).join(norm(right, b, "nb"), b).select(a, b, (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def tf_idf(counts: DataFrame, key: str) -> DataFrame:
    """(key, gram, w): counts times ln((1 + documents) / (1 + documents with the gram)) + 1."""
    n = counts.agg(F.countDistinct(key).alias("docs"))
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    return counts.join(df, "gram").join(F.broadcast(n)).select(key, "gram", (F.col("n") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("w"))

"""Matching texts to a closed set of classes: aliases, keyword patterns and fuzzy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine, edit_similarity, gram_counts, jaro_winkler_udf


def best_alias(items: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """Per item the class of the longest alias that its text holds (class, alias, priority); ties to the longer class name,
    the lower priority and then the class. The library is a table of hundreds of rows; the planner broadcasts it only below its
    own size limit, and pairs the tables in blocks beyond."""
    hits = items.join(aliases, F.col(text).contains(F.col("alias")))
    rank = F.struct(F.length("alias").alias("a"), F.length("class").alias("c"), (-F.col("priority")).alias("p"))
    best = F.max_by(F.struct("class", "alias", "priority"), F.struct(rank, F.col("class")))
    return hits.groupBy(key).agg(best.alias("m")).select(key, "m.class", "m.alias", F.when(F.col("m.priority") < 2, 1.0).otherwise(0.96).alias("confidence"))


def pattern_confidence(text: Column, rule: dict) -> Column:
    """Null unless no excluded word, all of must_all, and one of each must_any group occur; else the rule's confidence, and
    0.02 for each of up to four should_any words, at most 0.92."""
    has = lambda w: text.contains(w)
    ok = F.lit(True)
    for w in rule.get("exclude_any", []):
        ok &= ~has(w)
    for w in rule.get("must_all", []):
        ok &= has(w)
    for group in rule.get("must_any", []):
        any_of = F.lit(False)
        for w in group:
            any_of |= has(w)
        ok &= any_of
    bonus = F.lit(0)
    for w in rule.get("should_any", []):
        bonus += has(w).cast("int")
    return F.when(ok, F.least(F.lit(0.92), rule["confidence"] + 0.02 * F.least(bonus, F.lit(4))))


def best_pattern(items: DataFrame, key: str, text: str, rules: list[dict]) -> DataFrame:
    """Per item the class of the pattern of highest confidence, ties to more required words and then the class."""
    found = F.array_compact(F.array(*[F.when(pattern_confidence(F.col(text), r).isNotNull(), F.struct(pattern_confidence(F.col(text), r).alias("confidence"), F.lit(len(r.get("must_all", []))).alias("must"), F.lit(r["class"]).alias("class"))) for r in rules]))
    return items.select(key, F.array_max(found).alias("m")).where(F.col("m").isNotNull()).select(key, "m.class", F.round("m.confidence", 4).alias("confidence"))


def fuzzy_class(items: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """Per item the class of highest 0.35 edit + 0.25 Jaro-Winkler + 0.4 character n-gram cosine; ties to the smaller class. A text
    that is a class's own name is that class with 1. Every distinct text is scored against every class of the closed set, a few
    dozen names; n-grams only add the cosine where there are common ones."""
    distinct = items.select(F.col(text).alias("t")).where("t is not null").distinct()
    close = cosine(gram_counts(distinct.select("t", F.lower("t").alias("x")), "t", "x"), gram_counts(classes.select("class", F.lower("class").alias("x")), "class", "x"), "t", "class")
    names = classes.agg(F.sort_array(F.collect_set("class")).alias("names"))  # one row: the closed set
    every = distinct.crossJoin(names).select("t", F.explode("names").alias("class")).join(close, ["t", "class"], "left").na.fill({"cosine": 0.0})
    a, b = F.lower("t"), F.lower("class")
    mixed = F.round(0.35 * edit_similarity(a, b) + 0.25 * jaro_winkler_udf(a, b) + 0.4 * F.col("cosine"), 6)
    scored = every.withColumn("score", F.when(a == b, 1.0).otherwise(mixed))
    best = scored.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("s"), "class")).alias("m")).select(F.col("t").alias(text), "m.class", (-F.col("m.s")).alias("score"))
    return items.join(best, text).select(key, "class", "score")

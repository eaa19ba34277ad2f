"""Input tables and the roles they play: targets and boxes on floors, entities, floor texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; only the columns that a query names are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(k: int):
    return F.col("embedding")[k].cast("double")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, floor, x, y."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("target_id"), F.col("label").alias("floor"), component(0).alias("x"), component(1).alias("y"))


def target_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, floor, b: a box about each target."""
    x, y = component(0), component(1)
    b = boxes.box(x, y, x + F.abs(component(2)) + 0.02, y + F.abs(component(3)) + 0.02)
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("target_id"), F.col("label").alias("floor"), b.alias("b"))


#: The same roles in SQL.
TARGETS_SQL = "targets AS (SELECT vec_id AS target_id, label AS floor, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
BOXES_SQL = """boxes AS (SELECT vec_id AS target_id, label AS floor, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS y0,
  CAST(embedding[1] AS DOUBLE) + abs(CAST(embedding[3] AS DOUBLE)) + 0.02 AS x1, CAST(embedding[2] AS DOUBLE) + abs(CAST(embedding[4] AS DOUBLE)) + 0.02 AS y1 FROM embeddings)"""

FLOOR_TEXTS = [
    "{n}F", "F{n} plan", "地下室 B{m}F", "B{m}F-{n}F", "屋面 plan {n}层", "设备层", "十{c}层 标准层", "地下{c}层及{c}层平面图", "负{m}层 首层", "顶层、夹层、避难层", "{m}#、{n}# building", "第{n}层平面图", "地下二层",
    "二楼", "F{n}__B0{m}", "{n}层 B{m}",
]
NUMERALS = "一二三四五六七八"


def floor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, title: a drawing title for each part."""
    k = F.col("p_size") % 8 + 1
    n, m, c = F.col("p_size").cast("string"), k.cast("string"), F.substr(F.lit(NUMERALS), k.cast("int"), F.lit(1))
    texts = [F.replace(F.replace(F.replace(F.lit(t), F.lit("{n}"), n), F.lit("{m}"), m), F.lit("{c}"), c) for t in FLOOR_TEXTS]
    return load(spark, sf_dir, "part").select("p_partkey", F.array(*texts)[(F.col("p_partkey") % 16).cast("int")].alias("title"))


FLOOR_TEXTS_SQL = "titles AS (SELECT p_partkey, p_size AS n, CAST(p_size % 8 + 1 AS INT) AS m, CAST(p_partkey % 16 AS INT) AS k, replace(replace(replace(list_extract([" + ", ".join(f"'{t}'" for t in FLOOR_TEXTS) + f"], CAST(p_partkey % 16 AS INT) + 1), '{{n}}', CAST(p_size AS VARCHAR)), '{{m}}', CAST(p_size % 8 + 1 AS VARCHAR)), '{{c}}', substr('{NUMERALS}', CAST(p_size % 8 + 1 AS INT), 1)) AS title FROM part)"

"""CSV, JSON and GeoJSON tables, closures as arrays, reports, cached decisions; Parquet is the staging format everywhere else."""

from __future__ import annotations

import hashlib
import io
import re
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> None:
    """Columns in their order; nested values as JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed by the schema; cells that don't parse are null, and a byte order mark is no part of the first name."""
    return spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("mode", "PERMISSIVE").schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def features(boxes: DataFrame, properties: list[str]) -> DataFrame:
    """Boxes (x0, y0, x1, y1) as GeoJSON features: one closed ring each."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes.select(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))


def write_geojson(rows: DataFrame, path: str) -> None:
    """One feature a line, so that a reader can split the file."""
    rows.write.mode("overwrite").json(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The properties and the outer ring of each feature."""
    schema = f"properties struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>, geometry struct<type:string, coordinates:array<array<array<double>>>>"
    return spark.read.schema(schema).json(path).select("properties.*", F.col("geometry.coordinates")[0].alias("ring"))


def checked_types(rows: DataFrame, kind: str, excluded: list[str]) -> DataFrame:
    """Rows of other than the excluded obstacle types; a row without a type raises, as it must never become free space."""
    sure = F.when(F.col(kind).isNull(), F.raise_error(F.lit("unknown obstacle type"))).otherwise(F.col(kind))
    return rows.withColumn(kind, sure).where(~F.col(kind).isin(*excluded))


def polygon_features(parts: DataFrame, properties: list[str]) -> DataFrame:
    """Parts of regions (rings: flat, the outer one first, then holes) as GeoJSON features of closed rings."""
    points = lambda r: F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / 2).cast("int") - 1), lambda i: F.array(F.get(r, 2 * i), F.get(r, 2 * i + 1)))
    closed = F.transform("rings", lambda r: F.concat(points(r), F.array(F.array(r[0], r[1]))))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return parts.select(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))


FEATURE = "properties string, geometry struct<type:string,coordinates:string>"


def read_features(spark: SparkSession, path: str, collections: bool = False) -> DataFrame:
    """(properties as JSON, kind, rings) of features, one a line or, with collections, in whole files: every ring of polygons and of
    multi-polygons, flat; other geometries have none."""
    if collections:
        f = spark.read.schema(f"features array<struct<{FEATURE.replace('properties string', 'properties:string').replace('geometry struct', 'geometry:struct')}>>").option("multiLine", True).json(path)
        sure = F.when(F.col("features").isNull(), F.raise_error(F.lit("a file without features"))).otherwise(F.col("features"))
        f = f.select(F.explode(sure).alias("f")).select("f.*")
    else:
        f = spark.read.schema(FEATURE).json(path)
    kind, raw = F.col("geometry.type"), F.col("geometry.coordinates")
    one, many = F.from_json(raw, "array<array<array<double>>>"), F.flatten(F.from_json(raw, "array<array<array<array<double>>>>"))
    rings = F.transform(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many), lambda r: F.flatten(F.transform(r, lambda p: F.slice(p, 1, 2))))
    return f.select("properties", kind.alias("kind"), F.coalesce(rings, F.array().cast("array<array<double>>")).alias("rings"))


def obstacle_details(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("column",)) -> tuple[DataFrame, DataFrame]:
    """(counts, polygons) of obstacle files: a floor's features, those excluded by type and those that are drawn; and rings (scope, ring)
    of the latter. A feature without a floor or a type raises, as it must never become free space."""
    f = read_features(spark, path, True)
    text = lambda name: F.trim(F.coalesce(F.get_json_object("properties", f"$.{name}"), F.lit("")))
    named = lambda c, why: F.when(c != "", c).otherwise(F.raise_error(F.lit(why)))
    f = f.withColumns({"scope": named(text("floor_id"), "an obstacle without a floor"), "kind": named(F.lower(text("obstacle_type")), "an obstacle without a type")})
    out = F.col("kind").isin(*[e.lower() for e in excluded])
    counts = f.groupBy("scope").agg(F.count("*").alias("source"), F.count_if(out).alias("excluded"), F.count_if(~out).alias("rendered"))
    return counts, f.where(~out).select("scope", F.explode("rings").alias("ring"))


def write_csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV whose files begin with a byte order mark, for spreadsheets: the mark is part of the first column's name."""
    first, *rest = df.columns
    write_csv(df.select(F.col(f"`{first}`").alias("\ufeff" + first), *[f"`{c}`" for c in rest]), path)


CLOSURE = "scope string, name string, targets int, bytes long, digest string"


def write_closures(closure: DataFrame, folder: str) -> DataFrame:
    """One compressed file of arrays a scope, sorted ids and a matrix of distances, under a shared folder; returns the manifest (scope,
    name, targets, bytes, digest), written beside them. Files carry names of their attempt: what the manifest names counts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64)]))
        d = np.full((len(ids), len(ids)), np.inf, np.float32)
        d[np.searchsorted(ids, rows["src"]), np.searchsorted(ids, rows["dst"])] = rows["distance"]
        out = io.BytesIO()
        np.savez_compressed(out, target_ids=ids, distance=d)
        data = out.getvalue()
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        name = f"closure-{re.sub('[^0-9A-Za-z_.-]+', '_', str(key[0]))}-{uuid.uuid4().hex[:12]}.npz"
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(data)
        return pd.DataFrame([(str(key[0]), name, len(ids), len(data), hashlib.sha256(data).hexdigest())], columns=[c.split()[0] for c in CLOSURE.split(", ")])

    manifest = closure.groupBy("scope").applyInPandas(run, CLOSURE)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return closure.sparkSession.read.schema(CLOSURE).json(f"{folder}/manifest")


class Closures:
    """Reads the matrices of a manifest scope by scope, each when it is first asked for; a file whose digest differs raises."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.files = {r.scope: (r.name, r.digest) for r in spark.read.schema(CLOSURE).json(f"{folder}/manifest").collect()}  # a row a scope
        self._open: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _scope(self, scope: str) -> tuple[np.ndarray, np.ndarray]:
        if scope not in self._open:
            if scope not in self.files:
                raise KeyError(f"no closure of {scope}")
            name, digest = self.files[scope]
            store, base = opened(self.folder)
            with store.open_input_file(f"{base}/{name}") as f:
                data = f.read()
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"{name} is damaged")
            with np.load(io.BytesIO(data)) as arrays:
                self._open[scope] = arrays["target_ids"], arrays["distance"]
        return self._open[scope]

    def distance(self, scope: str, a: int, b: int) -> float:
        """Infinite for unknown targets and where there is no way."""
        ids, d = self._scope(scope)
        i, j = np.searchsorted(ids, [a, b])
        known = i < len(ids) and j < len(ids) and ids[i] == a and ids[j] == b
        return float(d[i, j]) if known else float("inf")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path: a plain path or file: is a shared folder."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report's table; it is for people, so more than `most` rows raise instead of growing."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: a report shows {most} rows at most; aggregate first")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def write_report(tables: list[tuple[str, DataFrame]], heading: str, path: str) -> None:
    """A Markdown file of tables, written through the shared folder's store."""
    store, base = opened(path)
    store.create_dir(base.rpartition("/")[0], recursive=True)
    with store.open_output_stream(base) as f:
        f.write("\n".join([f"# {heading}\n", *(markdown_table(df, title) for title, df in tables)]).encode())


def write_decisions(decisions: DataFrame, key: list[str], path: str) -> None:
    """Decisions as JSON in shards by the first two digits of the fingerprint of their key columns; a later write of a shard replaces
    it alone."""
    mark = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]), 256)
    out = decisions.withColumn("fingerprint", mark).withColumn("shard", F.substr("fingerprint", F.lit(1), F.lit(2)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").json(path)


def cached_decisions(spark: SparkSession, items: DataFrame, key: list[str], path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(known, missing): items with their decision, and those without one, by the fingerprint of their key columns."""
    mark = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]), 256)
    keyed = items.withColumn("fingerprint", mark)
    stored = spark.read.schema(f"{schema}, fingerprint string, shard string").json(path).drop("shard", *key)
    return keyed.join(stored, "fingerprint"), keyed.join(stored.select("fingerprint"), "fingerprint", "left_anti")


def training_samples(decisions: DataFrame, name: str, role: str) -> DataFrame:
    """(text, label): 1 for objects and 0 for what is ignored; other roles and nameless decisions teach nothing."""
    label = F.when(F.trim(role) == "inspection_object", 1).when(F.trim(role) == "IGNORE", 0)
    return decisions.select(F.trim(name).alias("text"), label.alias("label")).where("label is not null and text <> ''")


def accepted_portals(spark: SparkSession, path: str) -> DataFrame:
    """Portals of a GeoJSON file that were accepted for segmentation: portal_id, floor_id, confidence, width, line."""
    schema = "properties struct<portal_id:string,floor_id:string,status:string,confidence:double,width:double>, geometry struct<type:string,coordinates:array<array<double>>>"
    rows = spark.read.schema(schema).json(path).where("properties.status = 'accepted_for_segmentation'")
    return rows.select("properties.portal_id", "properties.floor_id", "properties.confidence", "properties.width", F.flatten("geometry.coordinates").alias("line"))


def graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a navigation graph in JSON: nodes (floor_id, node_id, kind, x, y, component_id), edges (floor_id, edge_id,
    node_a, node_b, kind, length); without a length the path's own."""
    schema = "nodes array<struct<floor_id:string,node_id:string,kind:string,x:double,y:double,component_id:string>>, edges array<struct<floor_id:string,edge_id:string,node_a:string,node_b:string,kind:string,length:double,geometry:struct<coordinates:array<array<double>>>>>"
    g = spark.read.schema(schema).option("multiLine", True).json(path)
    e = g.select(F.explode("edges").alias("e")).select("e.*")
    c = F.col("geometry.coordinates")
    legs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1]))
    own = F.when(F.size(c) > 1, F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))
    return g.select(F.explode("nodes").alias("n")).select("n.*"), e.withColumn("length", F.coalesce("length", own)).drop("geometry")

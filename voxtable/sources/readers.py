"""Sources: inventories, meshes, transforms, labels, delimited and JSON tables, shards and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable import schemas


def object_inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, length, modified`` of every object under a folder. File bytes are never read: the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def with_places(table: DataFrame) -> DataFrame:
    """Rows of a Parquet table with their place in it: ``__file``, the number of the file in the order of names, and ``__row`` in the file."""
    from voxtable.operators.ordered import range_id

    names = sorted({f.replace(":///", ":/", 1) for f in table.inputFiles()})
    named = table.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    return named.withColumn("__file", range_id(["__path"], [(n,) for n in names[1:]], named.schema)).drop("__path")


def split_keys(inventory: DataFrame, key: str = "path", root: str = "") -> DataFrame:
    """Splits ``<root>scroll/segments/segment/kind/asset`` keys into columns; shorter keys leave NULLs."""
    parts = F.split(F.regexp_replace(F.col(key), F.lit("^" + root), F.lit("")), "/")
    names = ("scroll", "area", "segment", "kind", "asset")
    return inventory.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def children(inventory: DataFrame, prefix: str, key: str = "path") -> DataFrame:
    """One-level listing: the distinct entries right below a prefix, with object count and total size."""
    rest = F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key))
    entry = F.substring_index(rest, "/", 1)
    return inventory.where(F.col(key).startswith(prefix)).groupBy(entry.alias("entry")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("size"), F.bool_or(rest.contains("/")).alias("is_prefix")
    )


def assets_by_owner(inventory: DataFrame, owner: str, pattern: str, key: str, least: int = 2) -> DataFrame:
    """Owners with at least ``least`` distinct assets whose key matches."""
    hits = inventory.where(F.col(key).rlike(pattern))
    return hits.groupBy(owner).agg(F.count_distinct(key).alias("assets")).where(F.col("assets") >= least)


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw chunk files with content, for ``operators.chunks.decode_files``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def transforms(spark: SparkSession, path: str) -> DataFrame:
    """Transform JSON files: key, matrix (4x4 cut to 3x4), landmark lists, status."""
    raw = spark.read.schema(schemas.TRANSFORM_JSON).option("multiLine", "true").json(path)
    return transform_status(raw.select(F.col("_metadata.file_path").alias("key"), "*"))


def transform_status(raw: DataFrame) -> DataFrame:
    matrix = F.slice("transformation_matrix", 1, 3)
    shaped = (F.size("transformation_matrix") >= 3) & F.forall(matrix, lambda r: F.size(r) == 4)
    n_m, n_f = F.coalesce(F.size("moving_landmarks"), F.lit(0)), F.coalesce(F.size("fixed_landmarks"), F.lit(0))
    status = (
        F.when(~F.coalesce(shaped, F.lit(False)), "no 3x4 matrix")
        .when((n_m <= 0) | (n_f <= 0), "no landmarks")
        .when(n_m != n_f, "landmark count mismatch")
        .otherwise("ok")
    )
    return raw.withColumn("matrix", matrix).withColumn("n_landmarks", F.greatest(n_m, F.lit(0))).withColumn("status", status)


def landmark_rows(transforms_df: DataFrame) -> DataFrame:
    """One row per landmark pair of the usable transforms."""
    ok = transforms_df.where("status = 'ok'")
    e = ok.select("key", F.posexplode(F.arrays_zip("moving_landmarks", "fixed_landmarks")).alias("idx", "p"))
    return e.select("key", "idx", *[F.col("p.moving_landmarks")[k].alias(f"m{c}") for k, c in enumerate("xyz")], *[F.col("p.fixed_landmarks")[k].alias(f"f{c}") for k, c in enumerate("xyz")])


def newest_label_set(inventory: DataFrame, owner: str, path: str, date: str) -> DataFrame:
    """The label path with the latest date string per owner."""
    return inventory.groupBy(owner).agg(F.max_by(path, date).alias(path), F.max(date).alias(date))


def mask_region(mask: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """TRUE pixels of a half-open region; the predicate reaches the scan."""
    return mask.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Delimited text with header; short rows keep their columns and leave the rest NULL."""
    return spark.read.schema(schema).option("sep", sep).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def seed_scores(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Score logs of all shards in one scan, with the shard named by its folder."""
    df = spark.read.schema(schemas.SEED_SCORES).option("sep", "\t").option("header", "true").csv(list(paths))
    return df.withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def usable_rows(scores: DataFrame, by: Sequence[str], key: str, order: str, a: str, b: str, maps: DataFrame | None = None, map_keys: Sequence[str] = ()) -> DataFrame:
    """Rows with status ok and differing sides, first row per id, that have a stored map. The sides compare as text."""
    ok = scores.where((F.col("status") == "ok") & (F.col(a).cast("string") != F.col(b).cast("string")))
    rest = [c for c in ok.columns if c not in (*by, key)]
    first = ok.groupBy(*by, key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*by, key, "__r.*")
    return first.join(maps.select(*map_keys), list(map_keys), "left_semi") if maps is not None else first


def with_registry(entries: DataFrame, registry: DataFrame, key: str, fields: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Per-field overrides of a registry entry; ``status`` names the first required field that is still missing."""
    reg = registry.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = entries.join(reg, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, f"__{f}"))
    status: Column = F.lit("ok")
    for f in reversed(list(required)):
        status = F.when(F.col(f).isNull(), F.lit(f"missing {f}")).otherwise(status)
    return out.drop(*[f"__{f}" for f in fields]).withColumn("status", status)

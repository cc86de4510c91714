"""The driver tables read as meshes, rasters, volumes and windows. Every view covers its whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.columns import exact_avg
from voxtable.operators import ordered
from voxtable.operators.nearest import parts
from voxtable.sources.readers import with_places


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_rows(spark: SparkSession, folder: str, name: str, by: Sequence[str], *columns: Column | str) -> DataFrame:
    """A table's groups with their rows as they lie in it: plain sums and means after it fall as those of the SQL text on one thread."""
    df = with_places(table(spark, folder, name))
    return ordered.in_order(df.select(*by, *columns, "__file", "__row"), by, ["__file", "__row"], parts(spark, df.count()))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded output, with -0.0 folded into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as one raster: row y = vec_id, column x = dimension."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))


GRID = "SELECT vec_id::INT AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x, unnest(embedding)::DOUBLE AS v FROM embeddings"


def points(spark: SparkSession, folder: str, first: int = 0, name: str = "vec_id") -> DataFrame:
    """Embeddings as 3-D points from dimensions first..first+2."""
    e = table(spark, folder, "embeddings")
    dims = [F.col("embedding")[first + k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return e.select(F.col("vec_id").alias(name), "label", *dims)


def points_sql(first: int = 0, name: str = "vec_id") -> str:
    dims = ", ".join(f"embedding[{first + k + 1}]::DOUBLE AS {c}" for k, c in enumerate("xyz"))
    return f"SELECT vec_id AS {name}, label, {dims} FROM embeddings"


def volume(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as a uint8 volume: z = vec_id div 16, y = vec_id mod 16, x = dimension, v = 128 + 300 e clipped to 0..255."""
    g = grid(spark, folder)
    v = F.least(F.greatest(F.rint(128 + 300 * F.col("v")), F.lit(0.0)), F.lit(255.0)).cast("smallint")
    return g.select(
        F.lit("emb").alias("volume_id"), F.lit(0).alias("level"), F.floor(F.col("y") / 16).cast("int").alias("z"), F.pmod("y", F.lit(16)).cast("int").alias("y"), "x", v.alias("v")
    )


VOLUME = f"SELECT y // 16 AS z, y % 16 AS y, x, least(greatest(round_even(128 + 300 * v, 0), 0), 255)::INT AS v FROM ({GRID})"


def arms(spark: SparkSession, folder: str, exact: bool = True) -> DataFrame:
    """Suppliers as scored windows: base, new and third arm are mean quantity shares of three ship-date spans; scroll =
    region, segment = nation, fold = nation mod 3. An arm without lines is NULL. Arms with equal means are equal doubles, unless ``exact`` is
    off: then a mean is a sum in the order of rows, and a tie falls as in the SQL text on one thread."""
    wanted = [F.year("l_shipdate").alias("year"), (F.col("l_quantity") / 50).alias("q"), "l_returnflag"]
    li = table(spark, folder, "lineitem").select("l_suppkey", *wanted) if exact else in_rows(spark, folder, "lineitem", ["l_suppkey"], *wanted)
    year, q, mean = F.col("year"), F.col("q"), exact_avg if exact else F.avg

    def arm(lo: int, hi: int) -> Column:
        return mean(F.when((year >= lo) & (year <= hi), q))

    score = li.groupBy("l_suppkey").agg(
        arm(1995, 1996).alias("base"), arm(1997, 1998).alias("new"), arm(1999, 2001).alias("third"),
        F.count_if(F.col("l_returnflag") == "R").alias("pos"), F.count_if(F.col("l_returnflag") != "R").alias("neg"),
    )
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    g = table(spark, folder, "region").select("r_regionkey", "r_name")
    geo = s.join(n, s.s_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    out = geo.join(score, geo.s_suppkey == score.l_suppkey, "left")
    return out.select(
        F.col("s_suppkey").alias("win"), F.col("r_name").alias("scroll"), F.col("n_name").alias("segment"), F.pmod("n_nationkey", F.lit(3)).alias("fold"),
        "base", "new", "third", "pos", "neg",
    )


ARMS = """SELECT s_suppkey AS win, r_name AS scroll, n_name AS segment, n_nationkey % 3 AS fold, base, "new", third, pos, neg
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (
 SELECT l_suppkey, avg(l_quantity / 50) FILTER (year(l_shipdate) BETWEEN 1995 AND 1996) AS base,
  avg(l_quantity / 50) FILTER (year(l_shipdate) BETWEEN 1997 AND 1998) AS "new",
  avg(l_quantity / 50) FILTER (year(l_shipdate) BETWEEN 1999 AND 2001) AS third,
  count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg
 FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and hour number since the epoch: n and mean value."""
    e = table(spark, folder, "events")
    hour = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    return e.groupBy("event_type", hour.alias("h")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean_value"))


HOURLY = "SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS h, count(*)::DOUBLE AS n, avg(value) AS mean_value FROM events GROUP BY ALL"

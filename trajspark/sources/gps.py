"""Sources and sinks of GPS points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "user_id string, trajectory_id string, timestamp timestamp_ntz, latitude double, longitude double, altitude double"


def padded(number: Column, width: int) -> Column:
    """A whole number with leading zeros; a longer one keeps all its digits (lpad alone would cut it)."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def points_from_events(events: DataFrame) -> DataFrame:
    """GPS points derived from an event stream in whole numbers: each trajectory walks by steps taken from the event values."""
    v = F.round(F.col("value") * 100).cast("bigint")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000")
    e = events.select("event_id", "value", (F.expr("user_id div 5")).alias("tr"), F.expr("user_id div 15").alias("us"), micros.alias("e_us"), v.alias("v"))
    e = e.withColumns({"step_y": F.col("v") % 201 - 100 + F.when(F.col("event_id") % 997 == 0, 20000).otherwise(0), "step_x": F.expr("v div 7") % 201 - 100})
    w = Window.partitionBy("tr").orderBy("e_us", "event_id")
    e = e.withColumns({"i": F.row_number().over(w).cast("bigint") - 1, "lat_udeg": 39_900_000 + F.sum("step_y").over(w), "lon_udeg": 116_300_000 + F.sum("step_x").over(w)})
    elapsed = F.col("e_us") + (F.col("tr") % 3) * 3_600_000_000 + F.when(F.col("e_us") >= 1_296_000_000, 400_000_000).otherwise(0)
    user = padded(F.col("us"), 3)
    return e.select(
        user.alias("user_id"),
        F.concat_ws("__", user, padded(F.col("tr"), 4)).alias("trajectory_id"),
        F.col("i").alias("source_point_index"),
        elapsed.alias("elapsed_us"),
        F.col("lat_udeg"),
        F.col("lon_udeg"),
        (F.col("lat_udeg") / 1e6).alias("latitude"),
        (F.col("lon_udeg") / 1e6).alias("longitude"),
        F.when(F.col("i").between(100, 120), 1).otherwise(0).alias("anomaly_label"),
        F.col("value").alias("score"),
        (F.col("value") > 100).cast("int").alias("predicted"),
    )


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_plt(spark: SparkSession, root: str, header_lines: int = 6) -> DataFrame:
    """root/<user>/Trajectory/<file>.plt: header lines skipped, seven comma-parted fields; bad numbers and times become null."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.plt", recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where((F.col("line") >= header_lines) & (F.trim("text") != ""))
    part = lambda k: F.get(F.split("text", ","), F.lit(k))
    number = lambda k: part(k).try_cast("double")
    return lines.select(
        F.regexp_extract("path", r"([^/]+)/Trajectory/[^/]+$", 1).alias("user_id"),
        F.regexp_extract("path", r"([^/]+)\.plt$", 1).alias("trajectory_id"),
        "line",
        F.concat_ws(" ", part(5), part(6)).try_cast("timestamp_ntz").alias("timestamp"),
        number(0).alias("latitude"),
        number(1).alias("longitude"),
        number(3).alias("altitude"),
    )


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).csv(path, header=True, mode="PERMISSIVE")


def first_files(files: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """The first `limit` files of each wanted user by name; users without any keep one row with a null name."""
    w = Window.partitionBy("user_id").orderBy("file_name")
    ranked = files.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return users.join(ranked, "user_id", "left")


def file_checksums(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, *partition_by: str) -> None:
    """Writes Parquet, refusing to overwrite."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_report(df: DataFrame) -> DataFrame:
    """One JSON string a row; NaN becomes null, infinite numbers raise."""
    def safe(c: str):
        return F.when(F.isnan(c), None).when(F.abs(c) == float("inf"), F.raise_error(F.lit(f"{c} is infinite"))).otherwise(F.col(c))

    doubles = {f for f, t in df.dtypes if t in ("double", "float")}
    return df.select(F.to_json(F.struct(*[safe(c).alias(c) if c in doubles else F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))

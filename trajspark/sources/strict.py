"""Strict readers: every line is typed or named with what is wrong with it, and a reader can fail inside the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.operators.guards import guarded

#: Spellings of a timestamp, tried in order.
TIMESTAMPS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
#: What cannot stand in a field, so that the word null and the like stay what they are.
NOTHING = "\u0000"
PROBLEMS, FILE = "_problems", "_file"


def timestamp_of(text: Column) -> Column:
    """A timestamp in any of the spellings, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMPS]).cast("timestamp_ntz")


def _typed(column: str, kind: str) -> tuple[Column, Column]:
    """(value, problem or null). An empty field is null for every type but string, where it stays empty."""
    text = F.col(f"`{column}`")
    given = text.isNotNull() & (text != "")
    if kind == "string":
        return F.coalesce(text, F.lit("")), F.lit(None).cast("string")
    if kind == "boolean":
        value = F.when(text == "True", True).when(text == "true", True).when(text == "False", False).when(text == "false", False)
    elif kind.startswith("timestamp"):
        value = timestamp_of(text)
    else:
        value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text).try_cast(kind) if kind in ("double", "float") else F.when(text.rlike("^[+-]?[0-9]+$"), text).try_cast(kind)
    return F.when(given, value), F.when(given & value.isNull(), F.lit(f"bad {column}"))


def read_dataset_csv(spark: SparkSession, path: str, schema: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of CSV files with a header, `_file` and `_problems`, the list of what is wrong with a line (empty: nothing).

    All fields are read as text: ids keep their leading zeros, empty strings stay empty, timestamps may have any of the spellings of TIMESTAMPS line by line,
    booleans are true or false and nothing else. Lines with too many or too few fields are `corrupt`. A file whose header differs from the schema fails the
    job. `required` columns must not be empty.
    """
    wanted = ", ".join(f"`{c}` string" for c in schema)
    reader = spark.read.schema(f"{wanted}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", False).option("columnPruning", False)
    raw = reader.csv(path, header=True, mode="PERMISSIVE", nullValue=NOTHING, emptyValue="", recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias(FILE))
    typed = {c: _typed(c, k) for c, k in schema.items()}
    empty = [F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") == ""), F.lit(f"empty {c}")) for c in required]
    problems = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("corrupt"))).otherwise(F.array_compact(F.array(*[p for _, p in typed.values()], *empty)))
    return raw.select(*[v.alias(c) for c, (v, _) in typed.items()], F.col(FILE), problems.alias(PROBLEMS))


def file_report(read: DataFrame) -> DataFrame:
    """(file, lines, bad_lines, problems): each file's lines, those with a problem, and the problems with their counts as sorted JSON."""
    rows = read.select(FILE, F.explode_outer(PROBLEMS).alias("problem"), (F.size(PROBLEMS) > 0).alias("bad"))
    lines = read.groupBy(FILE).agg(F.count("*").alias("lines"), F.count_if(F.size(PROBLEMS) > 0).alias("bad_lines"))
    kinds = rows.where("problem is not null").groupBy(FILE, "problem").agg(F.count("*").alias("n")).groupBy(FILE).agg(F.map_from_entries(F.collect_list(F.struct("problem", "n"))).alias("m"))  # a few kinds a file
    return lines.join(kinds, FILE, "left").select(F.col(FILE).alias("file"), "lines", "bad_lines", F.coalesce(geo.sorted_json(F.col("m")), F.lit("{}")).alias("problems"))


def strict(read: DataFrame) -> DataFrame:
    """The rows without `_file` and `_problems`; the job fails at the first bad line, with its file and what is wrong."""
    text = F.concat(F.col(FILE), F.lit(": "), F.array_join(PROBLEMS, ", "))
    return read.where(F.when(F.size(PROBLEMS) == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))).drop(FILE, PROBLEMS)


def load_split(spark: SparkSession, root: str, split: str, manifest: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One split of a dataset written by split, with the sine and cosine of the bearing; only that folder is read.

    The job fails, with the counts, unless: labels are 0 or 1, keys (trajectory_id, source_point_index) stand once and are not null, rows and trajectories of
    every trajectory equal the manifest (trajectory_id, dataset_split, points), none is missing or added, and all users stand in `users`, if given.
    """
    rows = spark.read.parquet(root).where(F.col("dataset_split") == split)
    own = rows.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("anomaly_label").isin(0, 1), F.lit(False))).alias("bad_labels"), F.count_if(F.col("is_training_eligible").isNull()).alias("no_quality"), F.count_if(F.col("source_point_index").isNull() | F.col("trajectory_id").isNull()).alias("null_keys"), (F.count("*") - F.countDistinct("source_point_index")).alias("repeated"), F.min("user_id").alias("user_id"), F.max("user_id").alias("last_user"))
    want = manifest.where(F.col("dataset_split") == split).select("trajectory_id", F.col("points").alias("want"))
    j = own.join(want, "trajectory_id", "full")
    if users is not None:
        j = j.join(users.select("user_id").distinct().withColumn("_known", F.lit(True)), "user_id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    found = {
        "bad_labels": z("bad_labels"), "no_quality": z("no_quality"), "null_keys": z("null_keys"), "repeated_keys": z("repeated"), "several_users": F.count_if(F.col("user_id") != F.col("last_user")),
        "missing_trajectories": F.count_if(F.col("n").isNull()), "added_trajectories": F.count_if(F.col("want").isNull()), "other_counts": F.count_if(F.col("n") != F.col("want")),
    }
    if users is not None:
        found["foreign_users"] = F.count_if(F.col("_known").isNull() & F.col("n").isNotNull())
    violations = j.agg(*[c.alias(name) for name, c in found.items()])
    return guarded(rows, violations).withColumns({"bearing_sin": F.sin(F.radians("bearing")), "bearing_cos": F.cos(F.radians("bearing"))})


def demo_points(read: DataFrame, user: str = "demo_user", trajectory: str = "demo_trajectory") -> DataFrame:
    """Points of a file with timestamp, latitude and longitude; user_id, trajectory_id and altitude get defaults where the columns or their values are missing.

    The job fails unless coordinates are numbers in range and times strictly increase in each trajectory in the order of `line`, or of time where no such
    column stands (then equal times fail). At least one row must stand.
    """
    has = set(read.columns)
    text = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)) if c in has else F.lit(default)
    p = read.withColumns({"user_id": text("user_id", user), "trajectory_id": text("trajectory_id", trajectory), "altitude": F.coalesce(F.col("altitude").try_cast("double"), F.lit(0.0)) if "altitude" in has else F.lit(0.0)})
    at = [F.col(c).try_cast("double") for c in ("latitude", "longitude")]
    fine = F.coalesce(at[0].between(-90, 90) & at[1].between(-180, 180) & F.col("timestamp").isNotNull(), F.lit(False))
    w = Window.partitionBy("trajectory_id").orderBy("line" if "line" in has else "timestamp")
    before = F.lag("timestamp").over(w)
    p = p.withColumns({"_fine": fine, "_later": F.coalesce(F.col("timestamp") > before, before.isNull())})
    violations = p.agg(F.count_if(~F.col("_fine")).alias("invalid_rows"), F.count_if(~F.col("_later")).alias("times_not_increasing"), (F.count("*") == 0).cast("int").alias("no_rows"))
    return guarded(p.drop("_fine", "_later"), violations)


def read_policies(spark: SparkSession, path: str, gates: tuple[tuple[int, int], ...], cooldowns: tuple[int, ...]) -> DataFrame:
    """(policy_id, window_points, minimum_positive, cooldown_s) of a JSON file {"policies": [...]}.

    The job fails unless every id says what its parameters are and the set is exactly all gates under all cooldowns, each once.
    """
    schema = "policies array<struct<policy_id:string,window_points:int,minimum_positive:int,cooldown_s:int>>"
    p = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("policies"))
    own = F.concat_ws("", F.col("minimum_positive").cast("string"), F.lit("of"), F.col("window_points").cast("string"), F.lit("_cd"), F.col("cooldown_s").cast("string"))
    want = spark.createDataFrame([(n, m, c) for n, m in gates for c in cooldowns], "window_points int, minimum_positive int, cooldown_s int")
    keys = ["window_points", "minimum_positive", "cooldown_s"]
    sides = p.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("policy_id") == own, F.lit(False))).alias("odd")).join(want.withColumn("_w", F.lit(1)), keys, "full")
    violations = sides.agg(F.coalesce(F.sum("odd"), F.lit(0)).alias("ids_unlike_parameters"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))
    return guarded(p, violations)


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required: tuple[str, ...], finite: bool = False) -> DataFrame:
    """df, if it has the columns (else ValueError with the missing ones); with `finite` the job fails at a null or non-finite number in them."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not finite:
        return df
    numbers = [c for c, t in df.dtypes if c in required and t in ("double", "float")]
    if not numbers:
        return df
    fine = reduce(lambda x, y: x & y, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in numbers])
    return df.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not finite: "), F.to_json(F.struct(*numbers)))).cast("boolean")))

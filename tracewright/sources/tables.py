"""Trajectory tables as sequences, CSV recordings, and result sinks.

Chunked id lists of a database client become one scan and a semi join; sorting happens inside the group that needs it.
Credentials are read from the caller's options, never kept here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEN_DIGITS = "^[1-9][0-9]{9}$"
SEGMENT = r"_(\d+)$"


def jdbc(spark: SparkSession, table: str, options: dict[str, str], partition: dict[str, str] | None = None) -> DataFrame:
    """A database table; `partition` (column, lower and upper bound, number of partitions) makes the read parallel."""
    return spark.read.format("jdbc").options(dbtable=table, **options, **(partition or {})).load()


def is_trajectory_id(c: str) -> Column:
    return F.col(c).cast("string").rlike(TEN_DIGITS)


def segment_number(c: str) -> Column:
    return F.regexp_extract(c, SEGMENT, 1).cast("int")


def parent_of(c: str) -> Column:
    return F.regexp_replace(c, SEGMENT, "")


def recorded_on(file_name: str, date: str) -> Column:
    return F.regexp_extract(file_name, "record_([^_]*)_", 1) == F.lit(date)


def compact_date(c: str) -> Column:
    """yyyyMMdd of a dd.MM.yyyy text."""
    return F.date_format(F.to_date(c, "dd.MM.yyyy"), "yyyyMMdd")


def at_level(rows: DataFrame, level: str, traj: str = "traj_id", seg: str = "seg_id") -> DataFrame:
    """Rows that describe whole trajectories ('trajectory': the segment id is the trajectory id) or segments."""
    same = F.col(traj).cast("string") == F.col(seg).cast("string")
    return rows.where(same if level == "trajectory" else ~same)


def points(rows: DataFrame, traj: str, seg: str | None, order: list, coordinates: list[str]) -> DataFrame:
    """traj_id, seg_id, ord, v: the canonical point table. Null coordinates become NaN and stay visible."""
    from pyspark.sql import Window

    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in coordinates])
    number = F.row_number().over(Window.partitionBy(traj).orderBy(*order)).cast("long")
    return rows.select(F.col(traj).alias("traj_id"), (F.col(seg) if seg else F.col(traj)).cast("string").alias("seg_id"), number.alias("ord"), v.alias("v"))


def sequences(point_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq (array<array<double>> in order), n: one row a sequence."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "v")))
    return point_rows.groupBy(*keys).agg(F.transform(ordered, lambda s: s.v).alias("seq"), F.count("*").alias("n"))


def sequences_of(ids: DataFrame, point_rows: DataFrame, id_col: str = "id") -> DataFrame:
    """For each id, a trajectory's or a segment's, in one pass: its sequence, empty if it has no points. Keeps ids' other columns."""
    long = point_rows.select(F.explode(F.array(F.col("traj_id").cast("string"), F.col("seg_id"))).alias("key__"), "traj_id", "seg_id", "ord", "v")
    long = long.dropDuplicates(["key__", "traj_id", "ord"])
    wanted = ids.select(F.col(id_col).cast("string").alias("key__")).distinct()
    found = sequences(long.join(wanted, "key__", "left_semi"), ["key__"])
    out = ids.join(found, ids[id_col].cast("string") == F.col("key__"), "left").drop("key__")
    return out.withColumn("seq", F.coalesce("seq", F.array().cast("array<array<double>>"))).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def counts_of(ids: DataFrame, point_rows: DataFrame, id_col: str = "id") -> DataFrame:
    """For each id, a trajectory's or a segment's, the number of its points: counted where they are, no sequence is built."""
    long = point_rows.select("traj_id", F.explode(F.array_distinct(F.array(F.col("traj_id").cast("string"), F.col("seg_id")))).alias("key__"))
    found = long.groupBy("key__").agg(F.count("*").alias("n"))
    return ids.join(found, ids[id_col].cast("string") == F.col("key__"), "left").drop("key__").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def segment_counts(rows: DataFrame, traj: str = "traj_id", seg: str = "seg_id") -> DataFrame:
    return at_level(rows, "segment", traj, seg).groupBy(traj).agg(F.countDistinct(seg).alias("segments"))


#: Column layouts of a recording's CSV by number of columns.
_TIME, _POSE = ["timestamp", "sec", "nanosec"], ["px", "py", "pz", "qx", "qy", "qz", "qw"]


def recording_columns(width: int) -> list[str]:
    """Names of a recording with 40, 43 or 47 columns: stamps, measured channels, joints, then reached positions and orientations."""
    if width not in (40, 43, 47):
        raise ValueError(f"no layout with {width} columns")
    names = list(_TIME)
    for prefix, axes in (("pv_", "xyz"), ("ov_", "xyzw"), ("tcp_", "xyz"), ("ps_", "xyz"), ("os_", "xyzw")):
        names += [prefix + a for a in axes]
    names += ["tcp_speeds", *[f"joint_{i}" for i in range(1, 7)]]
    names += [f"extra_{i}" for i in range(1, 40 - len(names) + 1)]
    return names + [f"ap_{a}" for a in "xyz"][: width - 40] + [f"aq_{a}" for a in "xyzw"][: max(0, width - 43)]


def recording_csv(spark: SparkSession, path: str) -> DataFrame:
    """A recording whose layout follows from the width of its header; every column is a double."""
    width = len(spark.read.option("header", False).csv(path).columns)
    return spark.read.schema(T.StructType([T.StructField(c, T.DoubleType()) for c in recording_columns(width)])).option("header", True).option("enforceSchema", True).csv(path)


def result_csvs(spark: SparkSession, pattern: str, expected: list[str]) -> tuple[DataFrame, list[str]]:
    """All CSVs of a pattern under each other by column name, with source_file and run_stamp from the file name; expected
    columns that none has. Files are grouped by their header line, and each group is one read; absent columns are null."""
    lines = spark.read.text(pattern, wholetext=False).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("n"))
    first = lines.groupBy("path").agg(F.min_by("value", "n").alias("header"))
    layouts = first.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()  # one row a layout
    out = None
    for layout in layouts:
        part = spark.read.option("header", True).option("inferSchema", True).csv(layout.paths)
        part = part.withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
        if out is not None:  # numbers of one name meet as doubles, anything else as text
            mine, theirs = dict(part.dtypes), dict(out.dtypes)
            for c in (c for c in mine if c in theirs and mine[c] != theirs[c]):
                common = "double" if {mine[c], theirs[c]} <= {"int", "bigint", "double"} else "string"
                part, out = part.withColumn(c, F.col(f"`{c}`").cast(common)), out.withColumn(c, F.col(f"`{c}`").cast(common))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file meets {pattern}")
    return out.withColumn("run_stamp", F.regexp_extract("source_file", r"(\d{8}_\d{6})", 1)), [c for c in expected if c not in out.columns]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_nested_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_jdbc(df: DataFrame, table: str, options: dict[str, str], batch: int = 10_000) -> None:
    """Append with batched inserts; NaN is stored as NULL."""
    clean = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.format("jdbc").mode("append").options(dbtable=table, batchsize=str(batch), **options).save()


def write_jdbc_in_batches(df: DataFrame, table: str, options: dict[str, str], batches: tuple[int, ...] = (10_000, 250, 10)) -> int:
    """Insert through a table of its own, `<table>_incoming`, with the largest batch size that the database takes; that size.

    A failed attempt leaves nothing behind: the next one overwrites the incoming table, and only a complete one is appended."""
    incoming = f"{table}_incoming"
    clean = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    for batch in batches:
        try:
            clean.write.format("jdbc").mode("overwrite").options(dbtable=incoming, batchsize=str(batch), **options).save()
        except Exception:
            if batch == batches[-1]:
                raise
            continue
        write_jdbc(jdbc(df.sparkSession, incoming, options), table, options, batch)
        return batch
    raise ValueError("no batch size given")


def write_transformed_poses(poses: DataFrame, path: str, traj: str = "traj_id") -> None:
    """Poses in the robot frame (position, orientation w, x, y, z) in place of those stored for the same trajectories, as
    columns x, y, z, qx, qy, qz, qw with the ids and the calibration's id."""
    keep = [c for c in poses.columns if c not in ("position", "orientation")]
    columns = [F.col("position")[i].alias(c) for i, c in enumerate("xyz")] + [F.col("orientation")[i].alias(c) for i, c in ((1, "qx"), (2, "qy"), (3, "qz"), (0, "qw"))]
    write_replacing(poses.select(*keep, *columns), path, traj)


def write_replacing(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions that df has; the other stored keys stay as they are."""
    df.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

"""Run-to-failure text logs (whitespace separated, no header), RUL side files,
CSV readings, and the sinks/persistence used by the pipeline.

Readers always use explicit types (no schema inference).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store

# Column layout of the 26-column engine log (unit, cycle,
# three operating settings, 21 sensors), the sensors dropped as near-constant,
# and the subsets that run under several operating conditions.
LOG_COLUMNS = (["unit_number", "time_in_cycles", "op_setting_1", "op_setting_2", "op_setting_3"]
               + [f"sensor_{i}" for i in range(1, 22)])
NEAR_CONSTANT_SENSORS = [1, 5, 6, 10, 16, 18, 19]
MULTI_CONDITION_SUBSETS = ["FD002", "FD004"]


def default_sensor_columns() -> list[str]:
    return [f"sensor_{i}" for i in range(1, 22) if i not in NEAR_CONSTANT_SENSORS]


def log_columns_for(subset: str, sensor_indices: list[int] | None = None,
                    include_op_settings: bool | None = None) -> list[str]:
    """Sensors kept for a subset; op settings 1-2 added on multi-condition
    subsets (setting 3 never kept)."""
    sensors = ([f"sensor_{i}" for i in sensor_indices] if sensor_indices else default_sensor_columns())
    ops = (subset.upper() in MULTI_CONDITION_SUBSETS) if include_op_settings is None else include_op_settings
    return (["op_setting_1", "op_setting_2"] if ops else []) + sensors


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ingest_seq): the non-blank lines of a file or folder. ``ingest_seq``
    <file, block, row> orders them as the files in the order of their paths, line
    by line: ``file`` numbers the paths, ``block`` is the byte at which a task's
    piece of the file starts, ``row`` counts inside the task. How Spark packs
    files into tasks (largest first) plays no part in it."""
    text = spark.read.text(path)
    files = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(text.inputFiles()))], "file int, path string")
    rows = text.select("value", F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    return (rows.where(F.length(F.trim("value")) > 0).join(F.broadcast(files), "path")
            .select("value", F.struct("file", "block", "row").alias("ingest_seq")))


def read_sensor_log(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-delimited headerless log (a file or a folder of files in the
    order of their paths) -> typed readings.

    Runs of spaces break the CSV reader, so lines are split on ``\\s+``;
    trailing empty fields are dropped by ``trim``. ``machine_id`` = unit,
    ``timestep`` = cycle, ``ingest_seq`` keeps the order of the lines.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = []
    for i, name in enumerate(LOG_COLUMNS):
        typ = "long" if i < 2 else "double"
        cols.append(F.element_at(parts, i + 1).cast(typ).alias(name))
    df = _lines(spark, path).select(*cols, "ingest_seq")
    return df.withColumnRenamed("unit_number", "machine_id").withColumnRenamed("time_in_cycles", "timestep")


def _ordinals(df: DataFrame, order: str) -> DataFrame:
    """``df`` with its 0-based ``ordinal`` in an order (range partitions, no single task)."""
    from ..operators.sequence import MARK, number_within_key
    ranked = number_within_key(df.withColumn("__all", F.lit(0)), "__all", [order], pos_col="ordinal", total_col=None)
    return ranked.drop("__all", MARK)


def read_rul_file(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, rul_at_last): one integer per line; line i belongs to the i-th engine of the log."""
    lines = _lines(spark, path).select(F.trim("value").cast("long").alias("rul_at_last"), "ingest_seq")
    return _ordinals(lines, "ingest_seq").select("ordinal", "rul_at_last")


def engine_ordinals(log: DataFrame) -> DataFrame:
    """Ordinal of each engine by first appearance in the log (machine_id, ordinal).

    Rows are reduced by number, per engine and piece of a file: the least of a
    struct would sort them. The log is scanned once, the engines are stored."""
    parts = [f.name for f in log.schema["ingest_seq"].dataType.fields]
    pieces = log.select("machine_id", "ingest_seq.*").groupBy("machine_id", *parts[:-1]).agg(F.min(parts[-1]).alias(parts[-1]))
    first = store(pieces.groupBy("machine_id").agg(F.min(F.struct(*parts)).alias("first_seq")))
    return _ordinals(first, "first_seq").select("machine_id", "ordinal")


def write_sensor_log(readings: DataFrame, path: str, sensors: dict[str, str]) -> None:
    """Readings as a log that ``read_sensor_log`` reads: files in (machine, step)
    order; ``sensors`` maps log columns to columns of the readings, others are 0."""
    cols = {"unit_number": F.col("machine_id"), "time_in_cycles": F.col("timestep"), **{k: F.col(v) for k, v in sensors.items()}}
    line = F.concat_ws(" ", *[cols.get(c, F.lit(0.0)).cast("string") for c in LOG_COLUMNS])
    (readings.repartitionByRange("machine_id", "timestep").sortWithinPartitions("machine_id", "timestep")
             .select(line.alias("value")).write.text(path))


def write_rul_file(truth: DataFrame, path: str) -> None:
    """(machine_id, rul_at_last) as RUL lines in machine order."""
    (truth.repartitionByRange("machine_id").sortWithinPartitions("machine_id")
          .select(F.col("rul_at_last").cast("string").alias("value")).write.text(path))


def attach_truth(log: DataFrame, rul: DataFrame) -> DataFrame:
    """I-th engine <-> i-th RUL line; a count mismatch is an error."""
    eng = engine_ordinals(log)
    n_eng, n_rul = eng.count(), rul.count()
    if n_eng != n_rul:
        raise ValueError(f"RUL file has {n_rul} lines but the log has {n_eng} engines")
    return eng.join(rul, "ordinal").select("machine_id", "rul_at_last")


READINGS_CSV_SCHEMA = T.StructType([
    T.StructField("machine_id", T.LongType()), T.StructField("timestep", T.LongType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("vibration", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()), T.StructField("rpm", T.DoubleType()),
    T.StructField("current", T.DoubleType()), T.StructField("machine_type", T.StringType()),
    T.StructField("failure_event", T.IntegerType()), T.StructField("failure_imminent", T.IntegerType()),
    T.StructField("degradation_progress", T.DoubleType())])


def read_readings_csv(spark: SparkSession, path: str, schema: T.StructType = READINGS_CSV_SCHEMA) -> DataFrame:
    """S3: CSV readings with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_readings(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str = "machine_type") -> None:
    """Readings sink, partitioned by machine type (partition pruning on read)."""
    w = df.write.mode("overwrite").partitionBy(partition_by)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    """A tidy result table as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_preprocessor(spark: SparkSession, path: str, scaler, params: dict, splits: DataFrame) -> None:
    """Fitted scaler, every preparation parameter (incl. sizes and seed) and
    the split table itself."""
    meta = dict(params, scaler=json.loads(scaler.to_json()))
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")
    splits.write.mode("overwrite").parquet(f"{path}/splits")


def load_preprocessor(spark: SparkSession, path: str):
    from ..operators.prepare import FittedScaler
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    scaler = FittedScaler(**meta.pop("scaler"))
    return scaler, meta, spark.read.parquet(f"{path}/splits")


def save_model(fitted, path: str) -> None:
    """Spark ML persistence plus the window standardiser (JSON)."""
    fitted.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    std = fitted.standardizer
    meta = {"name": fitted.name, "class": type(fitted.model).__name__,
            "mean": std.mean if std else None, "std": std.std if std else None}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_model(path: str):
    from pyspark.ml import classification as C
    from ..operators.models import FittedClassifier, VectorStandardizer
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    cls = getattr(C, meta["class"])
    model = cls.load(f"{path}/model")
    std = VectorStandardizer(meta["mean"], meta["std"]) if meta["mean"] is not None else None
    return FittedClassifier(meta["name"], model, std)

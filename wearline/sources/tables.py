"""Parquet inputs and the readings table derived from them.

``readings`` re-expresses the driver's star schema as run-to-failure sensor
logs: one machine per supplier, one reading per line item in ship order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import MARK, number_within_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SENSORS = ["quantity", "price", "discount", "tax"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def machine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> region name. Nation/region have a fixed size (25/5 rows)."""
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return (supplier.join(F.broadcast(geo), supplier.s_nationkey == geo.n_nationkey)
                    .select(F.col("s_suppkey").alias("machine_id"),
                            F.col("r_name").alias("machine_type")))


def machine_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(machine_id, machine_type) of the machines that have readings."""
    used = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("machine_id")).distinct()
    return used.join(machine_types(spark, sf_dir), "machine_id")


def readings(spark: SparkSession, sf_dir: str, machines: DataFrame | None = None) -> DataFrame:
    """Readings keyed by (machine_id, timestep).

    Columns: machine_id, timestep, sensors (quantity, price, discount, tax),
    attributes of ``machines`` (one row per machine; default: machine_type),
    ingest keys (l_orderkey, l_linenumber), l_shipdate, max_timestep (per
    machine) and failure_event (last 'R'/'F' row).

    Plan: line items are laid out once by (machine, ship order); machine
    attributes join the small part table, never the fact table. The last
    failure of a machine is the largest layout mark among its 'R'/'F' rows.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("machine_id"), "l_orderkey", "l_linenumber", "l_shipdate",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.coalesce((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.lit(False)).alias("__rf"))
    machines = machines if machines is not None else machine_types(spark, sf_dir)
    numbered = number_within_key(
        li, "machine_id", ["l_shipdate", "l_orderkey", "l_linenumber"], pos_col="timestep", total_col="__n_rows",
        part_aggs={"__last_rf": F.max(F.when(F.col("__rf"), F.col(MARK)))},
        key_aggs={"__fail": F.max("__last_rf")}, key_table=machines)
    return numbered.select(
        "machine_id", "timestep", *SENSORS, *[c for c in machines.columns if c != "machine_id"], "l_orderkey", "l_linenumber",
        "l_shipdate", (F.col("__n_rows") - 1).alias("max_timestep"),
        (F.col("__rf") & (F.col(MARK) == F.col("__fail"))).cast("int").alias("failure_event"))


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-style readings from ``events``: machine = user, one sensor ``value``,
    timestep = position in (ts, event_id) order, n_readings = rows of the machine."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("machine_id"), "event_id", "ts", "event_type", "value")
    return number_within_key(ev, "machine_id", ["ts", "event_id"], pos_col="timestep", total_col="n_readings").drop(MARK)

"""The driver's tables as operator sums: masks from integer keys, labels from digests, whole-number coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import OperatorFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_op(spark: SparkSession, sf_dir: str) -> OperatorFrame:
    """6 qubits, a term a line; ids hold the order's key and the line's number, of which there are seven at most."""
    masks = {"x0": F.col("l_partkey").bitwiseAND(F.lit(63)), "z0": F.col("l_suppkey").bitwiseAND(F.lit(63))}
    return OperatorFrame.from_df(table(spark, sf_dir, "lineitem"), 6, masks=masks, re=F.col("l_quantity"), im=F.col("l_linenumber"), term_id=F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def part_op(spark: SparkSession, sf_dir: str) -> OperatorFrame:
    """8 qubits, a term a part."""
    masks = {"x0": (F.col("p_partkey") * 37).bitwiseAND(F.lit(255)), "z0": (F.col("p_partkey") * 91).bitwiseAND(F.lit(255))}
    return OperatorFrame.from_df(table(spark, sf_dir, "part"), 8, masks=masks, re=F.col("p_size"), term_id=F.col("p_partkey"))


def supplier_op(spark: SparkSession, sf_dir: str, num_qubits: int = 8) -> OperatorFrame:
    """A term a supplier."""
    top = F.lit((1 << num_qubits) - 1)
    masks = {"x0": (F.col("s_suppkey") * 29).bitwiseAND(top), "z0": (F.col("s_suppkey") * 53).bitwiseAND(top)}
    return OperatorFrame.from_df(table(spark, sf_dir, "supplier"), num_qubits, masks=masks, re=F.col("s_suppkey") % 7, im=F.col("s_nationkey"), term_id=F.col("s_suppkey"))


def part_labels(spark: SparkSession, sf_dir: str, num_qubits: int = 96) -> DataFrame:
    """p_partkey, label of num_qubits characters, p_size."""
    hexa = F.concat(*[F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(s)).cast("binary")) for s in ("", "a", "b")])
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.translate(hexa, "0123456789abcdef", "IXYZ" * 4), 1, num_qubits).alias("label"), "p_size")

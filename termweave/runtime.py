"""A frozen snapshot of what the session offers, and versions."""

from __future__ import annotations

import platform
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .plans.strategy import STRATEGIES


@dataclass(frozen=True)
class Capabilities:
    spark_version: str
    master: str
    parallelism: int
    shuffle_partitions: int
    adaptive: bool
    strategies: tuple[str, ...]
    max_words_in_codegen: int = 64


def capabilities(spark: SparkSession) -> Capabilities:
    conf = spark.conf
    return Capabilities(spark.version, spark.sparkContext.master, spark.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")), conf.get("spark.sql.adaptive.enabled") == "true", STRATEGIES)


def build_info() -> dict[str, str]:
    import numpy
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__}

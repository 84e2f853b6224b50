"""Tables written to the folder all executors share, to cut a lineage or hold a stage's result."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as a table below spark.checkpoint.dir (a local folder only where that is unset and all runs on one machine, as in tests)."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    root = root or _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='kerbline-')}")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free hash) of a table, to tell whether a finished result's input is unchanged."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first())

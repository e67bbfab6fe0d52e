"""Tables that operators write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds on tables that are sent to every task: rows, and bytes of strings.
MOST_SENT_ROWS, MOST_SENT_BYTES = 100_000, 16 << 20


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, nothing is computed twice, and Spark knows its size."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(table: DataFrame) -> DataFrame:
    """A written table, to be sent to every task where it is within the bounds; else joined as it is."""
    strings = [F.length(f.name) for f in table.schema.fields if f.dataType.simpleString() == "string"]
    rows, chars = table.agg(F.count("*"), F.sum(sum(strings, F.lit(0)))).first()
    return F.broadcast(table) if rows <= MOST_SENT_ROWS and (chars or 0) * 4 <= MOST_SENT_BYTES else table

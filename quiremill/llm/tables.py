"""Tables in the shared checkpoint folder, and bitmaps of hashes that filter rows where they are read."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.session import ensure_checkpoint_dir

#: Bits of a bitmap, at most: eight megabytes, however many hashes it holds. Fuller bitmaps let more rows through, which the join behind them takes out.
MOST_BITS = 1 << 26
#: Bits of one row of Spark's bitmap functions.
_ROW = 1 << 15


def cut_table(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it: compressed, and safe from lost executors.

    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = f"{jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


class Bitmap:
    """Which 64-bit hashes may have been seen: none that was is missed; the driver and every executor hold MOST_BITS bits at most."""

    def __init__(self, bits: np.ndarray, shift: int) -> None:
        self.bits, self.shift = bits, np.uint64(shift)

    def __contains__(self, x: int) -> bool:
        return bool(self.has(np.array([x], np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame, per: int = 64) -> Bitmap:
    """The bitmap of the one bigint column of `hashes`, with `per` bits for each as long as that is under MOST_BITS.

    Bits are put together on the executors: the driver gets one row for every 32,768 bits that has any set.
    """
    name = hashes.columns[0]
    n = hashes.count()
    size = min(MOST_BITS, max(_ROW, 1 << (n * per - 1).bit_length() if n else 0))
    shift = 64 - (size.bit_length() - 1)
    bit = F.shiftrightunsigned(name, shift)
    rows = hashes.where(F.col(name).isNotNull()).groupBy(F.floor(bit / _ROW).alias("row")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(_ROW))).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        bits[r["row"] * (_ROW // 8) : (r["row"] + 1) * (_ROW // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Bitmap(bits, shift)

"""Small helpers of the operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: Words are runs of anything but these characters.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that all executors share: lineage ends here, and a lost
    executor costs nothing that has been written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text_ids(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id as text, whole ``text`` (empty for null): pandas would read long ids beside nulls as floats."""
    return df.select(F.col("doc_id").cast("string").alias("doc_id"),
                     *[F.coalesce("text", F.lit("")).alias("text") if c == "text" else c for c in columns])


def slices(batch, rows: int = 512):
    """An Arrow batch in parts, so that what a task builds at once stays small."""
    for k in range(0, len(batch), rows):
        yield batch.iloc[k:k + rows]


def with_long_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def packed(a: np.ndarray) -> bytes:
    """Whole numbers by byte planes, in as few planes as the largest needs: the upper ones compress well."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or w == 8 or int(a.max()) < 1 << (8 * w))
    return a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    width = len(data) // n if n else 1
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)


#: Size of a filter; a multiple of 32768, which is what one bitmap of the engine holds.
FLAGS = 1 << 24


def flags(df: DataFrame, column: str) -> np.ndarray:
    """FLAGS bits, of which each value of ``column`` sets one: a filter of a fixed size (2 MB), which lets ever
    more other values through as they fill, but loses none."""
    at = F.pmod(F.xxhash64(column), F.lit(FLAGS)) + 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(FLAGS // 8, np.uint8)
    for r in rows.collect():  # at most FLAGS / 32768
        out[(r["k"] - 1) * 4096:r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def flagged(column: str, bits: np.ndarray) -> Column:
    """Whether a value may be one of those that have set ``bits``."""
    shared = SparkSession.active().sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)
    return test(F.pmod(F.xxhash64(column), F.lit(FLAGS)))

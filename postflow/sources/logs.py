"""Line logs and key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank and corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_lines(df: DataFrame, line: str, schema: T.StructType) -> DataFrame:
    """S5 for lines that already sit in a column: bad lines are dropped."""
    checked = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    parsed = F.from_json(line, checked, {"columnNameOfCorruptRecord": "_bad"})
    good = (F.trim(F.col(line)) != "") & F.col("_row").isNotNull() & F.col("_row._bad").isNull()
    return df.withColumn("_row", parsed).where(good).select(
        *[c for c in df.columns if c != line], *[F.col(f"_row.{f.name}") for f in schema.fields])


def new_rejections(rejections: DataFrame, logged: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per (group, URL) not logged yet, the first by ``order`` if given; rows without URL always pass."""
    keys = ["search_group_id", "provider_url"]
    has_url = F.coalesce(F.col("provider_url"), F.lit("")) != ""
    with_url = rejections.where(has_url)
    if order is None:
        with_url = with_url.dropDuplicates(keys)
    else:
        rest = F.struct(*[c for c in rejections.columns if c not in keys])
        with_url = with_url.groupBy(*keys).agg(F.min_by(rest, order).alias("first")).select(*keys, "first.*").select(*rejections.columns)
    known = logged.select(*keys).distinct()
    return with_url.join(known, keys, "left_anti").unionByName(rejections.where(~has_url))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _key_list(raw: Column, field: str | None = None) -> Column:
    source = raw if field is None else F.get_json_object(raw, f"$.{field}")
    return F.from_json(source, "array<string>")


def key_sets(df: DataFrame, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    """(url keys, project ids) of key files in list form (v1) or object form (v2).

    A corrupt file yields no key.
    """
    c = F.col(raw)
    is_list = c.rlike(r"^\s*\[")
    url_keys = F.when(is_list, _key_list(c)).otherwise(_key_list(c, "url_keys"))
    ids = F.when(~is_list, _key_list(c, "project_ids"))
    return (df.select(F.explode(url_keys).alias("url_key")).where("url_key is not null").distinct(),
            df.select(F.explode(ids).alias("project_id")).where("project_id is not null").distinct())


def read_key_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return key_sets(spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value")))


def unseen(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in the processed set."""
    return df.join(keys, on, "left_anti")


def seen(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in the processed set."""
    return df.join(keys, on, "left_semi")


def add_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """U6."""
    return keys.unionByName(new).distinct()

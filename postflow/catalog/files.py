"""Readers and writers over real files (S1, S4-S7, S14, S15): the rows of the given tables are written
below the session's shared folder, one file for each row where the reader takes whole files, and read back."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import shared_dir
from ..sources import frontmatter as FM, inventory, logs
from .base import query, table, view
from .scans import KEY_FILE, LINE, RECORD_SQL, REJECTION, RUN_FILE, RUNS_SQL, documents


def folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def one_file_each(df: DataFrame, key: str, value: str, path: str) -> str:
    """One text file ``<key>=<its value>.txt`` for each row (keys are ids), in one folder for each task.

    The tasks write the files themselves: Spark's writer makes a folder, a checksum file and two renames for
    each of them, and the readers then list as many folders as there are rows.
    """
    root = re.sub(r"^file:/+", "/", path)

    def write(batches):
        files, at = fs.FileSystem.from_uri(root)
        at = f"{at}/slice={TaskContext.get().partitionId()}"
        files.create_dir(at, recursive=True)
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_output_stream(f"{at}/{key}={k}.txt") as out:
                    out.write(f"{v or ''}\n".encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    shared, folder_ = fs.FileSystem.from_uri(root)
    shared.create_dir(folder_, recursive=True)  # without rows there is no task
    # Written where the rows are: dealing the texts anew would put them on the disk once more.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select(F.col(key).cast("string").alias("k"), F.col(value).alias("v")).coalesce(tasks)
    named.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return path


def key_of(path: str, key: str):
    return F.regexp_extract(path, rf"/{key}=([^/]*)[.]txt$", 1)


@query("s1_document_files", """SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 11 < 9 AS has_header,
 sha256(CASE WHEN doc_id % 11 = 9 THEN '---' || chr(10) || 'title: open header' || chr(10) || text ELSE text END) AS body FROM documents""")
def s1_files(spark, d):
    at = one_file_each(documents(spark, d), "path", "content", folder(spark, "documents"))
    read = FM.read_documents(spark, at).select(key_of("path", "path").alias("path"), F.regexp_replace("content", r"\n\z", "").alias("content"))
    return FM.parse(read).select("path", (F.size("header") > 0).alias("has_header"), F.sha2("body", 256).alias("body"))


@query("s4_posting_files", f"SELECT path, title, state, project_id, search_groups, llm_score FROM ({RECORD_SQL})")
def s4_files(spark, d):
    at = folder(spark, "postings")
    FM.write_postings(FM.to_records(FM.parse(documents(spark, d)).where("size(header) > 0")), at)
    return spark.read.parquet(at).select("path", "title", "state", "project_id", F.array_join("search_groups", ",").alias("search_groups"), "llm_score")


@query("s4_document_export", f"SELECT title, state, project_id FROM ({RECORD_SQL})")
def s4_export(spark, d):
    at = folder(spark, "export")
    FM.write_documents(FM.to_records(FM.parse(documents(spark, d)).where("size(header) > 0")), at)
    texts = spark.read.option("lineSep", "\x00\n").text(at).select(F.col("value").alias("content"), F.lit("").alias("path"))
    return FM.to_records(FM.parse(texts)).select("title", "state", "project_id")


JSON_LINE = T.StructType([T.StructField("type", T.StringType()), T.StructField("k", T.LongType())])


@query("s5_jsonl_files", "SELECT event_type AS type, user_id AS k FROM events WHERE event_id % 7 NOT IN (3, 5)")
def s5_files(spark, d):
    at = folder(spark, "lines")
    view(spark, d, "events", LINE).select("line").write.text(at)
    return logs.read_jsonl(spark, at, JSON_LINE)


@query("s6_log_files", """SELECT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS search_group_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE url END AS provider_url,
 CAST(CASE WHEN page_id % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) * count(*) AS n FROM pages GROUP BY 1, 2, page_id % 10 = 0""")
def s6_files(spark, d):
    """Two runs append what is not logged yet; rows without URL are logged each time."""
    at = folder(spark, "rejections")
    rows = view(spark, d, "pages", REJECTION)
    logs.append_jsonl(rows.where("1 = 0"), at)
    for _ in range(2):
        known = spark.read.schema(rows.schema).json(at)
        logs.append_jsonl(logs.new_rejections(rows, known), at)
    return spark.read.schema(rows.schema).json(at).groupBy("search_group_id", "provider_url").agg(F.count("*").alias("n"))


@query("s7_key_files", """SELECT 'url' AS kind, 'gulp:' || url AS k FROM pages WHERE page_id % 3 < 2 UNION SELECT 'id', 'url-' || page_id FROM pages WHERE page_id % 3 = 1""")
def s7_files(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(KEY_FILE["value"]).alias("value"))
    keys, ids = logs.read_key_files(spark, one_file_each(rows, "page_id", "value", folder(spark, "keys")))
    return keys.select(F.lit("url").alias("kind"), F.col("url_key").alias("k")).unionByName(
        ids.select(F.lit("id").alias("kind"), F.col("project_id").alias("k")))


@query("s14_scanned_files", "SELECT page_id, octet_length(encode(url)) + 1 AS length FROM pages")
def s14_files(spark, d):
    at = one_file_each(table(spark, d, "pages"), "page_id", "url", folder(spark, "inventory"))
    return inventory.scan_files(spark, at, "*.txt").select(key_of("path", "page_id").cast("long").alias("page_id"), "length")


@query("s15_run_files", f"SELECT schedule_id, run_id, started_at, status FROM ({RUNS_SQL})")
def s15_files(spark, d):
    rows = view(spark, d, "conversations", RUN_FILE).withColumn("n", F.monotonically_increasing_id())
    at = one_file_each(rows, "n", "value", folder(spark, "runs"))
    return inventory.read_runs(spark, at).select("schedule_id", "run_id", "started_at", "status")

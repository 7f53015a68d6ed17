"""Whole files of a folder as rows, listed and read by tasks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch; a single file may be larger.
BATCH = 8 << 20
#: What Spark writes as %.. in ``_metadata.file_path``.
ODD = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]""")


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content (bytes) of every file below a folder, or of one file.

    The driver gets no list of the files: Spark's own reader keeps a record of each of them there.  One task
    lists the folder itself, many list those in it, and the files are dealt to all.  Stores that Arrow does not
    know, patterns and missing folders are left to Spark's reader.  Empty files are rows, too, which that one leaves out.
    """
    root = re.sub(r"^file:/+", "/", path)
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if re.search(r"[*?\[{]", root):
        return by_spark.load(path).selectExpr("_metadata.file_path AS path", "content")
    try:
        files, at = fs.FileSystem.from_uri(root)
        kind = files.get_file_info(at).type
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        kind = fs.FileType.NotFound
    if kind == fs.FileType.NotFound:
        return by_spark.load(path).selectExpr("_metadata.file_path AS path", "content")
    head = "file:" if root.startswith("/") else root[:len(root.rstrip("/")) - len(at.rstrip("/"))]

    def entries(files, folder: str, recursive: bool):
        base = folder.rstrip("/") + "/"
        for e in files.get_file_info(fs.FileSelector(folder, recursive=recursive)):
            if not any(map(_hidden, e.path[len(base):].split("/"))) and (e.type == fs.FileType.File or not recursive):
                yield e.path, e.type == fs.FileType.Directory

    def rows(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_())], ["path", "folder"])

    def top(batches):
        files = fs.FileSystem.from_uri(root)[0]
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield rows(list(entries(files, p, False)) if kind == fs.FileType.Directory else [(p, False)])

    def below(batches):
        files = fs.FileSystem.from_uri(root)[0]
        for batch in batches:
            for p, folder in zip(*(c.to_pylist() for c in batch.columns)):
                yield rows(list(entries(files, p, True)) if folder else [(p, False)])

    def read(batches):
        files = fs.FileSystem.from_uri(root)[0]
        names, contents, held = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        for batch in batches:
            for p in batch.column(0).to_pylist():
                with files.open_input_stream(p) as stream:
                    data = stream.read()
                names.append(head + ODD.sub(lambda c: f"%{ord(c[0]):02X}", p))
                contents.append(data)
                held += len(data)
                if held >= BATCH or len(names) >= 4_096:
                    yield full()
                    names, contents, held = [], [], 0
        if names:
            yield full()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.createDataFrame([(at,)], "path string").mapInArrow(top, "path string, folder boolean").repartition(tasks)
    found = listed.mapInArrow(below, "path string, folder boolean").select("path").repartition(tasks, "path")
    return found.mapInArrow(read, "path string, content binary")

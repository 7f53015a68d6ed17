"""Readers of files that a row of a table cannot stand for."""

import json

import pytest

from postflow.sources import config, inventory, profiles


def test_profiles_by_file_name(spark, tmp_path):
    (tmp_path / "alpha.md").write_text("# A\n<!-- x -->text")
    (tmp_path / "beta.md").write_text("B")
    (tmp_path / "gamma.txt").write_text("no profile")
    found = profiles.read_profiles(spark, str(tmp_path), ["alpha", "gone"])
    assert [tuple(r) for r in found.collect()] == [("alpha", "# A\n<!-- x -->text")]
    ids = spark.createDataFrame([("alpha",), ("gone",)], "profile_id string")
    texts = {r.profile_id: r.text for r in profiles.with_stubs(found, ids).collect()}
    assert texts == {"alpha": "# A\n<!-- x -->text", "gone": "# gone\n[Profil nicht gefunden]"}


GROUPS = {"search_groups": {"one": {"providers": {"p": {"channels": {"rss": {"feed_urls": ["u1", "u2"], "limit": None}}}},
                                    "filters": {"include_terms": ["Mondlicht*", {"term": "Teich", "with": ["Frosch"]}]}}}}


@pytest.mark.parametrize("form", ["json", "yaml"])
def test_configuration_file(spark, tmp_path, form):
    path = tmp_path / f"groups.{form}"
    yaml = pytest.importorskip("yaml") if form == "yaml" else None
    path.write_text(json.dumps(GROUPS) if form == "json" else yaml.safe_dump(GROUPS))
    groups = config.load_groups(config.load_file(str(path)))
    rules = config.term_rules(spark, groups).collect()
    assert [(r.term, r.context_terms) for r in rules] == [("Mondlicht*", []), ("Teich", ["Frosch"])]
    shared = config.shared_feeds(config.subscriptions(spark, groups)).collect()
    assert sorted((r.feed, r.limit, r.groups) for r in shared) == [("u1", None, ["one"]), ("u2", None, ["one"])]


def test_scan_takes_no_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a_20240102_030405.md").write_text("12345")
    (tmp_path / "b.log").write_text("1")
    rows = inventory.scan_files(spark, str(tmp_path), "*.md").collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in rows] == [("a_20240102_030405.md", 5)]


def test_one_file_each_makes_few_folders(spark, tmp_path):
    from postflow.catalog.files import key_of, one_file_each
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'ä' || id || chr(10) END AS v")
    at = one_file_each(df, "id", "v", f"file:{tmp_path}/many")
    assert len(list((tmp_path / "many").iterdir())) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = spark.read.text(at, wholetext=True).select(key_of("_metadata.file_path", "id").cast("int").alias("id"), "value").collect()
    assert {(r.id, r.value) for r in read} == {(i, ("" if i % 3 == 0 else f"ä{i}\n") + "\n") for i in range(300)} and len(read) == 300
    assert spark.read.text(one_file_each(df.limit(0), "id", "v", f"{tmp_path}/none"), wholetext=True).count() == 0


def test_documents_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """the files of a folder equal those of Spark's reader, whose list of them the driver has to hold."""
    from pyspark.sql.readwriter import DataFrameReader

    from postflow.sources import frontmatter
    (tmp_path / "a=1" / "b c").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for name in ("top.md", "a=1/größe 1.txt", "a=1/b c/x#y%.md", "a=1/.skip", "_hidden/no.md", "a=1/empty"):
        (tmp_path / name).write_bytes(b"" if name.endswith("empty") else f"---\nä {name}\n".encode() + b"\xff")
    spark_rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).selectExpr(
        "_metadata.file_path", "CAST(content AS STRING)").collect()

    def listed(self, *a, **b):
        raise AssertionError("the driver lists the files")
    monkeypatch.setattr(DataFrameReader, "load", listed)
    for path in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        rows = frontmatter.read_documents(spark, path).collect()
        assert sorted(map(tuple, rows)) == sorted([*map(tuple, spark_rows), (f"file:{tmp_path}/a=1/empty", "")]) and len(rows) == 4
    one, = frontmatter.read_documents(spark, f"{tmp_path}/top.md").collect()
    assert one["path"] == f"file:{tmp_path}/top.md"


def test_texts_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """before, all texts went through the shuffle to the tasks that wrote them."""
    from postflow.catalog.files import one_file_each

    def dealt(self, *a):
        raise AssertionError("dealt anew")
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(0)), "repartition", dealt)
        at = one_file_each(spark.range(50, numPartitions=9).selectExpr("id % 40 AS id", "'x' AS v"), "id", "v", f"{tmp_path}/out")
    assert spark.read.text(at).count() >= 40

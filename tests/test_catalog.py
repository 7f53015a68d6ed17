"""Registered queries next to their SQL counterparts on the smallest tables.

All of them run; POSTFLOW_QUICK=1 takes one of each family.
"""

import hashlib
import os

import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["s2_typed_records", "p3_tracking_free_url", "p19_must_sections", "f6_rate_bounds", "f10_order_volume", "j2_rule_table",
          "j4_ledger_lookup", "a6_ingestion_counters", "a10_capped_points", "w2_last_changes", "w10_budget_admission", "o2_page_info",
          "u3_distinct_urls", "t8_state_fold", "c5_evaluation_ingest", "x1_extractor_extension"]
NAMES = SAMPLE if os.environ.get("POSTFLOW_QUICK") else sorted(entry.oracle_sql())

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_longest_block_reads_the_real_page(spark, tmp_path):
    own = " ".join(["Beschreibung"] * 300)  # longer than what the query puts behind a page
    pages = [(1, "https://a.example/1", f"<html><body><div><p>{own}</p></div></body></html>"), (2, "https://www.a.example/jobs/2", "<html><body><div>kurz</div></body></html>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["block"] for r in entry.queries()["o7_longest_block"](spark, str(tmp_path)).collect()}
    behind = "https://www.a.example/jobs/2\n" * 9 + "Schluss 2"
    assert got == {1: hashlib.sha256(own[:2500].encode()).hexdigest(), 2: hashlib.sha256(behind.encode()).hexdigest()}


def test_same_url_on_two_pages(spark, tmp_path):
    """A key stays processed when a later page shows its URL with a tag; two ledger files may know one URL."""
    urls = ["http://a.example.net/en/5", "http://a.example.net/en/5?utm_source=feed", "http://b.example.com/en/6", "http://b.example.com/en/6"]
    spark.createDataFrame([(i + 1, u, "<title>x</title>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("t2_seen_dedupe", "s8_ledger_scan"):
        df = entry.queries()[name](spark, str(tmp_path))
        cursor = c.execute(entry.oracle_sql()[name])
        assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_first_page_of_a_repeated_rejection_stays(spark, tmp_path):
    """a rejection is logged once, for the first page of its URL wherever the table holds it."""
    urls = {9: "http://a.example/1", 4: "http://a.example/1", 2: "http://b.example/2", 7: "http://b.example/2", 5: "https://c.example/3", 3: "", 6: ""}
    spark.createDataFrame([(k, u, "") for k, u in urls.items()], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in entry.queries()["j6_unlogged_rejections"](spark, str(tmp_path)).collect()) == [2, 3, 4, 6]


def test_rule_dimension_of_odd_words(spark, tmp_path):
    """F8: patterns start with the word start, as the SQL writes them."""
    texts = ["Über C++ und ci/cd", "über x_y, Straße", "", None]
    spark.createDataFrame([(i, t, "de" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = entry.queries()["s13_rule_dimension"](spark, str(tmp_path))
    cursor = c.execute(entry.oracle_sql()["s13_rule_dimension"])
    got = rows(df.columns, df.collect())
    assert got and got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_late_stream_landings_of_several_files(spark, con, monkeypatch):
    from pathlib import Path

    from postflow.catalog import streams
    from postflow.session import shared_dir
    before = set(Path(shared_dir(spark)).glob("late-*"))
    monkeypatch.setattr(streams, "LANDING_ROWS", 50, raising=False)
    df = entry.queries()["t7_late_stream"](spark, "/root/testdata/sf0.001")
    cursor = con.execute(entry.oracle_sql()["t7_late_stream"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())
    made, = set(Path(shared_dir(spark)).glob("late-*")) - before
    many = [len(list(part.glob("*.parquet"))) for part in (made / "landing").iterdir()]
    assert len(many) == 3 and len(set(many)) == 1 and many[0] > 1

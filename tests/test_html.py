"""Paragraphs of pages against their SQL, on forms that the smallest tables lack."""

import duckdb
import oracle

from lectern import registry


def test_references_without_semicolon(spark, tmp_path):
    """Character references count with or without their semicolon, in the query and in its SQL."""
    html = "<html><body><article><h1>Ores&amp;&amp</h1><p>1 &lt 2 &gt; 0, &quot;a&quot b</p><p>&amp;lt; stays</p></article></body></html>"
    spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = registry.queries()["html_paragraphs"](spark, str(tmp_path))
    assert [r["text"] for r in found.orderBy("k").collect()] == ["Ores&&", '1 < 2 > 0, "a" b', "&lt; stays"]
    assert oracle.compare(found, registry.oracle_sql()["html_paragraphs"], con) == ""

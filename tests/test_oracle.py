"""Registered queries against their SQL on the smallest tables: those that run in a moment, and one of each heavy chain."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pyspark
import pytest

from scamsift.functions.domains import public_suffixes
from scamsift.plans.queries import QUERIES, SQL, _suffix_sql
from scamsift.sources import pages

NAMES = (
    "q_normalize_msgs", "q_rule_text", "q_extract_emails", "q_extract_phones", "q_extract_urls", "q_tokens_topk", "q_bigrams_topk", "q_truncate", "q_relative_time", "q_usable_messages", "q_rule_secrecy_request",
    "q_rule_delivery_redispatch_fee", "q_registrable_domain", "q_lookalike", "q_url_signals", "q_feed_entries", "q_feed_hits", "q_redirect_join", "q_idf", "q_lr_score", "q_allow_block", "q_history", "q_csv_guard", "q_csv_lines",
    "q_health", "q_session_scans", "q_recycled_nodes", "q_verdicts", "q_page_verdicts", "q_rule_hits", "q_public_suffix", "q_clean_mail", "q_rates_by_script", "q_page_holdout",
)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return Counter(tuple(str(plain(v[i])) for i in order) for v in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, tables, name):
    got, want = QUERIES[name](spark, sf), tables.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_all_queries_have_distinct_plans_or_sql():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) - len(SQL) <= 5


def test_suffix_sql_is_the_same_without_spark_archives(monkeypatch, tmp_path):
    """SQL may be made by a process whose ``pyspark`` is an archive, without Spark's libraries beside it."""
    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "pyspark.zip" / "pyspark" / "__init__.py"))
    assert _suffix_sql() == SQL["q_public_suffix"]
    assert all(f"'{rule}'" in SQL["q_public_suffix"] for rule in public_suffixes()) and len(public_suffixes()) == 9467


def test_page_titles_with_odd_references_and_spaces(spark, tmp_path):
    titles = ("a &amp", "a &quot", "a &am", "&", "&&amp;&lt;b&gt; &amp;lt; &amp;amp;", "Tom&#x27;s &eacute;t&eacute; &nbsp; &copy", "\n a\t\r\n b \n", " \u00a0 a \u00a0 b\u2003", "a\u0085\x0bb\u2028", "")
    htmls = [f"<html><head><title>{t}</title></head><body><a href='x?a=1&copy=2'>{t}</a><svg><title>not this</title></svg></body></html>" for t in titles]
    spark.createDataFrame(list(enumerate([*htmls, "<p>no title</p>", "", None])), "page_id long, html string").selectExpr("page_id", "'http://a.com/' as url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["q_page_titles"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(SQL["q_page_titles"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    shown = pages.collect_page("<title>\n Q&amp A&eacute;\u00a0\u00a0b </title><title>c</title>", None)
    assert shown["title"] == "Q& Aé\u00a0\u00a0b" and pages.collect_page("<title></title><title>c</title>", None)["title"] == ""

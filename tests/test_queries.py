"""Every registered query runs; those with SQL give the rows of the SQL."""

import re
from html import unescape

import pytest

from pressmill.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(same_as_sql, sf, name):
    same_as_sql(QUERIES[name], ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bodies_of_real_pages(spark, sf):
    """Every page holds articles: what stands in them, without marks, with entities read, squeezed and cut."""
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    wide = r"[\s\u00a0\u3000]"

    def plain(page):
        page = re.sub(r"(?s)<!--.*?-->", "", page)
        inner = "".join(re.findall(r"(?s)<article[^>]*>(.*?)</article>", page))
        # what stands in scripts and styles is kept, and has no marks or entities
        parts = re.split(r"(?s)(<script[^>]*>.*?</script>|<style[^>]*>.*?</style>)", inner)
        texts = [re.sub(r"(?s)^<[^>]*>|</[a-z]*>$", "", p) if re.match("<(script|style)", p) else unescape(re.sub(r"(?s)</?[a-zA-Z!][^>]*>", "", p)) for p in parts]
        return re.sub(rf"^{wide}+|{wide}+$", "", re.sub(rf"{wide}{{2,}}", " ", "".join(texts)))[:8000]

    got = {r["page_id"]: r["body"] for r in QUERIES["scrape_body_text"](spark, sf).collect()}
    assert got == {k: plain(h) or None for k, h in html.items()} and any(got.values())

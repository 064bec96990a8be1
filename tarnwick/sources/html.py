"""Title and excerpt of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import url_product_id

EXCERPT = 2000


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.skip, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.in_title = tag == "title" or self.in_title

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.skip:
            self.text.append(data)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("excerpt", T.StringType())]))
def page_text(html: pd.Series) -> pd.DataFrame:
    rows = []
    for source in html:
        page = _Page()
        page.feed(source or "")
        page.close()
        rows.append(("".join(page.title).strip() or None, " ".join("".join(page.text).split())[:EXCERPT]))
    return pd.DataFrame(rows, columns=["title", "excerpt"])


def product_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """product_id (the URL's UUID), name (the title, else the URL) and description (the excerpt) of each page."""
    read = pages.withColumn("p", page_text(html))
    return read.select(url_product_id(F.col(url)).alias("product_id"), F.coalesce(F.col("p.title"), F.col(url)).alias("name"), F.col("p.excerpt").alias("description"), F.col(url).alias("url"))

"""A front end for raw web pages: their headings, paragraphs and list items as elements, by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = r"(?is)<(?:h[1-6]|p|li|pre)(?:\s[^>]*)?>.*?(?=</(?:h[1-6]|p|li|pre)>|<(?:h[1-6]|p|li|ul|ol|pre|article|footer|nav|div)(?:\s[^>]*)?>|</(?:article|nav|ul|ol|div)>|$)"
KINDS = {"h": "heading", "p": "paragraph", "l": "list_item"}


def unescaped(c) -> F.Column:
    """c with the usual entities replaced, & last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def elements(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_name, ord, page_number, element_type, content, section of each page. Scripts, styles and comments are dropped; a
    block ends where the next begins. The section is that of the last heading, Introduction before the first."""
    from pyspark.sql import Window

    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    rows = pages.select(F.concat(F.lit("page_"), F.col(id_col).cast("string"), F.lit(".html")).alias("doc_name"), F.posexplode(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0))).alias("at", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([A-Za-z]+[0-9]?)", 1))
    text = F.trim(F.regexp_replace(unescaped(F.regexp_replace("block", "<[^>]*>", " ")), r"\s+", " "))
    rows = rows.select("doc_name", "at", tag.alias("tag"), text.alias("content")).where("content <> ''")
    kind = F.when(F.col("tag") == "pre", "code").when(F.col("tag").startswith("h"), "heading").when(F.col("tag") == "li", "list_item").otherwise("paragraph")
    rows = rows.withColumn("element_type", kind)
    sofar = Window.partitionBy("doc_name").orderBy("at")
    section = F.coalesce(F.last(F.when(F.col("element_type") == "heading", F.col("content")), ignorenulls=True).over(sofar), F.lit("Introduction"))
    return rows.select("doc_name", F.row_number().over(sofar).alias("ord"), F.lit(1).alias("page_number"), "element_type", "content", section.alias("section"))

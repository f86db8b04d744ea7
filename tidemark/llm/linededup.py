"""Line dedup by a line's frequency within its site. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_names
from tidemark.sources.scratch import cut

#: A broadcast table of boilerplate lines has at most so many lines (64 bytes each).
BROADCAST_LINES = 50_000


#: What ends a line of a page: tags of blocks. Scripts, styles and comments are no text.
_NO_TEXT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:html|head|title|body|p|div|h[1-6]|ul|ol|li|dl|dt|dd|br|hr|pre|table|tr|td|th|nav|header|footer|section|article|aside|main|form|blockquote)(?:[\x20\x09-\x0D/][^>]*)?>"
_TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def url_host(url: Column) -> Column:
    """The site of a page, in lower case, without user and port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """The text of a page: its blocks, and lines within them, parted by newlines."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _NO_TEXT, ""), _BLOCK, "\n"), _TAG, "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _full(line: Column) -> Column:
    """Lines of white space alone are never boilerplate."""
    return F.length(F.btrim(line, F.lit(" \t\r"))) > 0


def boilerplate_lines(docs: DataFrame, site: Column, max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``_site, line`` (digest in hexadecimal): lines on more than ``max_ratio`` of a site's pages, ``min_pages`` at least.

    A page counts once for a line however often it has it. Counting is a sum with a map-side combine,
    so a line on each page of a huge site is no hot group.
    """
    # A null site is a site of its own.
    pages = docs.select(F.coalesce(site, F.lit("\0")).alias("_site"), "text")
    total = pages.groupBy("_site").agg(F.count("*").alias("pages"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _full), F.md5))
    counts = pages.select("_site", F.explode(digests).alias("line")).groupBy("_site", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(total, "_site").filter(F.col("n") > max_ratio * F.col("pages")).select("_site", "line")


def line_dedup(docs: DataFrame, site: Column, max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """All columns of ``docs``, the text without boilerplate lines, and two more: lines it had and lost.

    These are ``_n_lines`` and ``_n_dropped``, with more underscores in front where ``docs`` has such columns.
    No rows give none. A null text stays null and has no lines. Other rows, empty texts included, stay too. A site
    has at most (distinct lines per page) / ``max_ratio`` boilerplate lines, so its list fits in a row
    however many pages it has. Lists are broadcast up to BROADCAST_LINES lines in all; beyond that
    rows are joined by site, where adaptive execution splits a site with very many.
    """
    found = cut(boilerplate_lines(docs, site, max_ratio, min_pages), "boilerplate")
    lists = found.groupBy("_site").agg(F.collect_list("line").alias("_drop"))
    if found.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    names = free_names(docs, "_n_lines", "_n_dropped")
    # Sets of strings are met by hashing, so a page costs its lines and its site's list, not their product.
    hit = F.array_intersect(F.transform("_all", F.md5), "_drop")
    stay = F.when(F.size("_hit") == 0, F.col("_all")).otherwise(F.filter("_all", lambda x: ~(_full(x) & F.array_contains(F.col("_hit"), F.md5(x)))))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join("_stay", "\n"))
    return (
        docs.select(F.struct("*").alias("_row"), "text", F.coalesce(site, F.lit("\0")).alias("_site"))
        .join(lists, "_site", "left")
        .withColumn("_all", _lines(F.col("text")))
        .withColumn("_hit", F.when(F.col("_drop").isNotNull(), hit))
        .withColumn("_stay", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(stay))
        .select(
            *[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns],
            F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias(names[0]),
            F.when(F.col("text").isNull(), 0).otherwise(F.size("_all") - F.size("_stay")).cast("long").alias(names[1]),
        )
    )


def page_line_dedup(pages: DataFrame, max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``page_id, host, text, n_lines, n_dropped`` of web pages ``page_id, url, html``, grouped by host.

    ``text`` has the lines of a page that are not boilerplate of its host. Pages without an address, or with
    one without host, are a group of their own (null host). A null page has a null text and no lines.
    Repeated pages count each, ids may be null, other columns are ignored, and no pages give no rows.
    """
    # Written once: both passes read the lines, and the markup is taken apart once.
    lines = cut(pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")), "page-lines")
    return line_dedup(lines, F.col("host"), max_ratio, min_pages).toDF("page_id", "host", "text", "n_lines", "n_dropped")

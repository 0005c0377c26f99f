"""Main text of web pages by the paths that the pages of a host agree on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import markup
from .common import store, table

PATHS_PER_HOST = 3  # a host may use several designs; each page takes the first it contains


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))


def vote(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths of each host with most votes, best first.

    Every page votes for the generalised tag-and-class path of its best container. Pages without
    text do not vote. Votes are counted before they meet, so a large host is no large group.
    """

    def best(frames):
        for frame in frames:
            found = [markup.best_path(*markup.parse(page)) for page in frame["html"]]
            rows = [(h, *f) for h, f in zip(frame["host"], found, strict=True) if f]
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    counted = (
        _with_host(pages)
        .select("host", "html")
        .mapInPandas(best, "host string, path string, score double")
        .groupBy("host", "path")
        .agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    )
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return (
        counted.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= PATHS_PER_HOST)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("ranked"))
        .select("host", F.col("ranked.path").alias("paths"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page.

    A page in which none of its host's paths holds text falls back on its own best container.
    Null and empty pages, and those without text outside menus and the like, have an empty text.
    Repeated rows and rows without page_id or url are answered each; pages without url form a
    host of their own. White space, no-break spaces included, becomes one space.
    """
    paths = store(vote(pages), "paths")

    def extracted(frames):
        for frame in frames:
            texts = [_text(*row) for row in zip(frame["html"], frame["paths"], strict=True)]
            yield pd.DataFrame(
                {"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts}
            )

    return (
        _with_host(pages)
        .join(paths, "host", "left")
        .select("page_id", "url", "html", "paths")
        .mapInPandas(extracted, "page_id long, url string, text string")
    )


def _text(page: str | None, paths) -> str:
    elements, blocks = markup.parse(page)
    for path in paths if paths is not None else ():
        if text := markup.text_of(elements, blocks, path):
            return text
    own = markup.best_path(elements, blocks)
    return markup.text_of(elements, blocks, own[0]) if own else ""


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))

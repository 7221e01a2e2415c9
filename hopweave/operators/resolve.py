"""From dump tables to edges: titles to pages, targets to pages, links to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def title_index(pages: DataFrame) -> DataFrame:
    """page_title -> page_id: the first page (smallest id) of each title owns it."""
    return pages.groupBy("page_title").agg(F.min("page_id").alias("page_id"))


def resolve_linktargets(linktargets: DataFrame, index: DataFrame) -> DataFrame:
    """lt_id -> page_id for targets whose title is a page's; of a repeated lt_id one counts."""
    return linktargets.join(index, F.col("lt_title") == F.col("page_title")).groupBy("lt_id").agg(F.min("page_id").alias("page_id"))


def resolve_links(pagelinks: DataFrame, pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges (src, dst), one for each link whose source is a page and whose target is resolved."""
    known = pagelinks.join(pages.select(F.col("page_id").alias("pl_from")).distinct(), "pl_from", "left_semi")
    return known.join(resolved, F.col("pl_target_id") == F.col("lt_id")).select(F.col("pl_from").alias("src"), F.col("page_id").alias("dst"))


def red_links(linktargets: DataFrame, index: DataFrame) -> DataFrame:
    """Targets whose title is no page's."""
    return linktargets.join(index, F.col("lt_title") == F.col("page_title"), "left_anti").select("lt_id", "lt_title")


def link_stats(pages: DataFrame, linktargets: DataFrame, pagelinks: DataFrame) -> DataFrame:
    """One row: targets parsed, mapped, missed; links parsed, inserted, and those whose source or target is missing (one link may count in both)."""
    index = title_index(pages)
    resolved = resolve_linktargets(linktargets, index)
    targets = linktargets.join(index, F.col("lt_title") == F.col("page_title"), "left").agg(F.count("*").alias("targets_parsed"), F.count("page_id").alias("targets_mapped"), F.count_if(F.col("page_id").isNull()).alias("title_misses"))
    sources = pages.select(F.col("page_id").alias("s")).distinct()
    ends = pagelinks.join(sources, F.col("pl_from") == F.col("s"), "left").join(resolved, F.col("pl_target_id") == F.col("lt_id"), "left")
    links = ends.agg(F.count("*").alias("links_parsed"), F.count_if(F.col("s").isNotNull() & F.col("page_id").isNotNull()).alias("links_inserted"), F.count_if(F.col("s").isNull()).alias("source_misses"), F.count_if(F.col("page_id").isNull()).alias("target_misses"))
    return targets.crossJoin(links)  # two single rows

"""From a folder of dump files to a graph that can be searched, with the time each stage takes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dumps, wikis
from .graph import LinkGraph


class MissingDump(ValueError):
    """A wiki that lacks one of its three files."""


@dataclass
class Durations:
    """Milliseconds of each stage: page, linktarget, pagelinks, build, search."""

    ms: dict[str, int] = field(default_factory=dict)

    def timed(self, stage: str, run: Callable):
        start = time.perf_counter()
        out = run()
        self.ms[stage] = round(1000 * (time.perf_counter() - start))
        return out

    @property
    def load_total(self) -> int:
        """What loading and building took together."""
        return sum(v for k, v in self.ms.items() if k != "search")


def load(spark: SparkSession, folder: str, language_code: str, date: str, target: str, title_mode: str = "strict", multigraph: bool = False) -> tuple[LinkGraph, Durations]:
    """The graph of a downloaded wiki, kept at `target`/graph (`LinkGraph.open` reads it again), its tables beside it.

    MissingDump if one of the three files isn't in the folder.
    """
    here = wikis.downloaded(wikis.listing(spark, folder)).where((F.col("language_code") == language_code) & (F.col("date") == date))
    if not here.limit(1).count():
        raise MissingDump(f"{folder} lacks files of {language_code}wiki {date}")
    took = Durations()
    tables: dict[str, DataFrame] = {}
    for kind in wikis.FILE_TYPES:
        source = f"{folder.rstrip('/')}/{language_code}wiki-{date}-{kind}.sql.gz"
        tables[kind] = took.timed(kind, lambda source=source, kind=kind: dumps.materialized(spark, source, f"{target}/{kind}", kind, title_mode))
    graph = took.timed("build", lambda: LinkGraph.resolved(tables["page"], tables["linktarget"], tables["pagelinks"], multigraph).save(f"{target}/graph"))
    return graph, took


def searched(graph: LinkGraph, start_title: str, end_title: str, took: Durations, limit: int | None = None) -> DataFrame:
    """A search whose time is added to the durations."""
    return took.timed("search", lambda: graph.search(start_title, end_title, limit))

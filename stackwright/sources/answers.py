"""Stored answers of providers as a data source that prunes before it opens anything.

Answers lie in files ``<provider>/<artist>/page-<n>.json`` below a folder that all executors mount: each is one page of an
artist's releases. ``spark.read.format("provider_answers").load(folder)`` gives one row for each release on a page. Filters
on provider, artist and page are taken over by the source: only folders and files that can hold wanted rows are listed
and opened. Other filters stay with Spark. Files are dealt out in partitions of about ``pagesPerPartition`` pages.

Register it once for a session with ``register(spark)``, which also lets Python sources take filters over.
"""

from __future__ import annotations

import json
import operator
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "provider string, artist string, page int, ord int, release_id string, title string, year string, json string"
#: Where each provider's pages keep their releases.
LISTS = ["releases", "release-groups", "results"]
PAGE = re.compile(r"page-(\d+)\.json")
COMPARISONS = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class Pages(InputPartition):
    files: list[tuple[str, str, int, str]]

    def __init__(self, files: list[tuple[str, str, int, str]]):
        super().__init__(0)
        self.files = files


def _test(wanted: Filter) -> tuple[str, Callable] | None:
    """(column, test of a value) of a filter that names of files decide; null of another."""
    if not hasattr(wanted, "attribute") or len(wanted.attribute) != 1 or wanted.attribute[0] not in ("provider", "artist", "page"):
        return None
    column = wanted.attribute[0]
    if isinstance(wanted, In):
        held = frozenset(wanted.value)
        return column, held.__contains__
    compare = COMPARISONS.get(type(wanted))
    if compare is None or wanted.value is None:
        return None
    return column, lambda v: compare(v, wanted.value)


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file:").rstrip("/")
        self.pages = max(1, int(options.get("pagesPerPartition", "64")))
        self.tests: dict[str, list[Callable]] = {"provider": [], "artist": [], "page": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            found = _test(wanted)
            if found:
                self.tests[found[0]].append(found[1])
            else:
                yield wanted

    def _fits(self, column: str, value: object) -> bool:
        return all(test(value) for test in self.tests[column])

    def files(self) -> Iterator[tuple[str, str, int, str]]:
        """(provider, artist, page, path) of the files that can hold wanted rows; other folders aren't listed."""
        for provider in sorted(os.listdir(self.root)):
            if not self._fits("provider", provider) or not os.path.isdir(f"{self.root}/{provider}"):
                continue
            for artist in sorted(os.listdir(f"{self.root}/{provider}")):
                if not self._fits("artist", artist):
                    continue
                for name in sorted(os.listdir(f"{self.root}/{provider}/{artist}")):
                    page = PAGE.fullmatch(name)
                    if page and self._fits("page", int(page[1])):
                        yield provider, artist, int(page[1]), f"{self.root}/{provider}/{artist}/{name}"

    def partitions(self) -> list[InputPartition]:
        found = list(self.files())
        return [Pages(found[k : k + self.pages]) for k in range(0, len(found), self.pages)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """Rows of the pages; a page that isn't JSON, or lists no releases, has none."""
        for provider, artist, page, path in partition.files:
            with open(path, encoding="utf-8", errors="replace") as f:
                try:
                    answer = json.load(f)
                except ValueError:
                    continue
            releases = next((answer[k] for k in LISTS if isinstance(answer.get(k), list)), []) if isinstance(answer, dict) else []
            for k, release in enumerate(r for r in releases if isinstance(r, dict)):
                year = release.get("year") or release.get("date") or release.get("first-release-date")
                own = (release.get("id"), release.get("title"), year)
                yield (provider, artist, page, k, *(None if v is None else str(v)[:4] if v is year else str(v) for v in own), json.dumps(release, sort_keys=True, ensure_ascii=False))


class AnswerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AnswerReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswerSource)


def answers(spark: SparkSession, folder: str, pages_per_partition: int = 64) -> DataFrame:
    """The releases on all stored pages below ``folder``; filter the result, and only the pages needed are read."""
    register(spark)
    return spark.read.format(AnswerSource.name()).option("pagesPerPartition", pages_per_partition).load(folder)

"""Files of a pull request as a Spark data source, one partition a page.

    spark.dataSource.register(PullFiles)
    spark.read.format("pull_files").options(owner="o", repo="r", number=7, changed_files=250, fetch="module:function").load()

`fetch` names a function (owner, repo, number, page, per_page) -> list of the hosting service's file objects that workers can
import; without it, pages lie as JSON in `folder` (owner/repo/number/page.json), which all machines must see.  With
`changed_files`, known from the pull request itself, pages are planned and read in parallel; without it one partition
reads on.  Either way an empty or short page is the last: what is planned beyond it is empty.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the files of a page.
PER_PAGE = 100
FIELDS = ("filename", "status", "additions", "deletions", "changes", "raw_url", "patch")


class Page(InputPartition):
    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class PullFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pull_files"

    def schema(self) -> str:
        return "page int, filename string, status string, additions int, deletions int, changes int, raw_url string, patch string"

    def reader(self, schema) -> PullReader:
        return PullReader(dict(self.options))


class PullReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        # Options' names don't keep their case.
        self.options = {k.lower(): v for k, v in options.items()}
        self.per_page = int(self.options.get("per_page", PER_PAGE))

    def partitions(self) -> list[Page]:
        n = self.options.get("changed_files")
        return [Page(1, None)] if n is None else [Page(p, p) for p in range(1, max(1, -(-int(n) // self.per_page)) + 1)]

    def _fetch(self) -> Callable[..., list[dict]]:
        if named := self.options.get("fetch"):
            module, _, function = named.partition(":")
            return getattr(importlib.import_module(module), function)
        return lambda owner, repo, number, page, per_page: _stored(Path(self.options["folder"], owner, repo, str(number), f"{page}.json"))

    def read(self, partition: Page) -> Iterator[tuple]:
        fetch, page = self._fetch(), partition.first
        while partition.last is None or page <= partition.last:
            files = fetch(self.options["owner"], self.options["repo"], int(self.options["number"]), page, self.per_page)
            for f in files:
                yield (page, *(f.get(name) for name in FIELDS))
            if len(files) < self.per_page:
                return
            page += 1


def _stored(at: Path) -> list[dict]:
    return json.loads(at.read_text()) if at.is_file() else []

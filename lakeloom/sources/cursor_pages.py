"""A stream over pages that name the next one: the cursor is the stream's offset.

Each page is a JSON document {"items": [...], "next": cursor or null} under its
cursor's name, in any folder that pyarrow can open.  The driver follows the
cursors, and reads nothing else of the pages; tasks read the items.

    spark.dataSource.register(CursorPages)
    spark.readStream.format("cursor_pages").option("path", folder).load()

Options: ``path``; ``first``, the first cursor (default "first"); ``per_batch``,
pages of a batch (default 10); ``broken``, what to do with a page that can't be
read as such: "fail" (default), or "skip" its items where its ``next`` can
still be read.  A page that isn't there yet, and one without ``next``, end the
chain for now: a later batch looks again.  A chain that comes back to a page is
an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "cursor string, place int, item string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _page(path: str, cursor: str) -> dict | None:
    """The page of a cursor; None if there is none.  A page that isn't JSON has no items and no next."""
    fs, base = _open(path)
    name = f"{base}/{cursor}.json"
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(name) as f:
        try:
            page = json.loads(f.read())
        except ValueError:
            return {"broken": True}
    whole = isinstance(page, dict) and isinstance(page.get("items"), list)
    return page if whole else {"broken": True, "next": page.get("next") if isinstance(page, dict) else None}


class _Page(InputPartition):
    def __init__(self, cursor: str) -> None:
        self.cursor = cursor


class _Reader(DataSourceStreamReader):
    """Offsets are {"next": cursor that comes next, "after": the one before, "pages": pages so far}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.first = options["path"], options.get("first", "first")
        self.per_batch, self.skip = int(options.get("per_batch", 10)), options.get("broken", "fail") == "skip"
        if options.get("broken", "fail") not in ("fail", "skip"):
            raise ValueError("broken is 'fail' or 'skip'")
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"next": self.first, "after": None, "pages": 0}

    def _steps(self, start: dict, pages: int) -> Iterator[tuple[str, dict]]:
        """(cursor, offset behind it) of up to so many pages from an offset on."""
        now, seen = dict(start), set()
        for _ in range(pages):
            cursor = now["next"]
            if cursor is None:  # the last page had no next: it may have one by now
                last = _page(self.path, now["after"])
                cursor = last.get("next") if last else None
            page = _page(self.path, cursor) if cursor is not None else None
            if page is None:
                return
            if page.get("broken") and not self.skip:
                raise ValueError(f"page {cursor} of {self.path} can't be read")
            if cursor in seen or page.get("next") == cursor:
                raise ValueError(f"the chain comes back to page {cursor}")
            seen.add(cursor)
            now = {"next": page.get("next"), "after": cursor, "pages": now["pages"] + 1}
            yield cursor, now

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        out = start
        for _, out in self._steps(start, self.per_batch):
            pass
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        self.at = end  # after a restart the chain goes on from what the checkpoint has
        return [_Page(cursor) for cursor, _ in self._steps(start, end["pages"] - start["pages"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = _page(self.path, partition.cursor) or {}
        for place, item in enumerate(page.get("items") or []):
            yield partition.cursor, place, item if isinstance(item, str) else json.dumps(item, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class CursorPages(DataSource):
    """The source for ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))

"""Channel posts as a data source, in batches or as a stream.

format("channel_posts"), registered with spark.dataSource.register(ChannelPosts).
Options:

- channels: comma-separated ids, one partition each;
- reader: module:function(channel, after) that yields (id, body, postedAt) of one page
  of posts after an id (None: from the first), oldest first, nothing at the end;
- folder: instead of a reader, an archive of JSON lines (id, body, postedAt) under
  source_id=<channel>, as Spark writes it, in any store that pyarrow opens; every file
  is a partition and is read once;
- newest: module:function(channel) that returns the newest id, or None; without it a
  stream looks for it page by page on the driver, from where it last stood, and in an
  archive through the files that it has not seen;
- after: JSON of the last id of each channel, where a first run begins;
- until: JSON of the id of each channel where a run ends; a stream then looks for none.

Stream offsets are {channel: last id}; ids compare as numbers.  A micro-batch reaches
from the offset that the last one ended at to the ids that were newest when it was
planned, so a batch that is run again after a failure reads the same posts, and only
a finished batch moves the offset.  No post is lost or doubled, however often a run is
killed; the sink must overwrite what a batch id wrote before (see flows.write_batches).
"""

from __future__ import annotations

import importlib
import io
import json
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, id string, body string, postedAt string"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def archive_files(folder: str, channel: str) -> list[tuple]:
    """(path, size, time) of the files of an archived channel."""
    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(f"{path}/source_id={quote(channel, safe=' ')}", allow_not_found=True))
    return [(f.path, f.size, f.mtime_ns) for f in found if not f.base_name.startswith(("_", "."))]


def archived(folder: str, file: str, after: str | None, last: str | None) -> Iterator[tuple]:
    """The posts of one file that follow an id, up to another."""
    with _store(folder)[0].open_input_stream(file, compression=None) as lines:
        for line in io.TextIOWrapper(lines, "utf-8"):
            r = json.loads(line)
            if (after is None or int(r["id"]) > int(after)) and (last is None or int(r["id"]) <= int(last)):
                yield r["id"], r.get("body"), r.get("postedAt")


class ChannelPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channel_posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Channels:
    """What both readers know of the options."""

    def __init__(self, options):
        self.options = dict(options)
        self.channels = [c.strip() for c in self.options["channels"].split(",") if c.strip()]
        self.after = json.loads(self.options.get("after", "{}"))
        self.until = json.loads(self.options.get("until", "{}"))

    def parts(self, channel: str, after: str | None, last: str | None) -> list[InputPartition]:
        """(channel, after, last, file) for each file of an archive, else one without a file."""
        files = [f for f, *_ in archive_files(self.options["folder"], channel)] if "folder" in self.options else [None]
        return [InputPartition((channel, after, last, f)) for f in files]

    def read(self, partition) -> Iterator[tuple]:
        channel, after, last, file = partition.value
        if file is None:
            yield from self.posts(channel, after, last)
            return
        for id, body, posted in archived(self.options["folder"], file, after, last):
            yield channel, str(id), body, posted

    def named(self, option: str):
        module, _, function = self.options[option].partition(":")
        return getattr(importlib.import_module(module), function)

    def posts(self, channel: str, after: str | None, last: str | None = None) -> Iterator[tuple]:
        """Page after page, up to an id."""
        page = self.named("reader")
        while True:
            found = list(page(channel, after))
            for id, body, posted in found:
                if last is not None and int(id) > int(last):
                    return
                yield channel, str(id), body, posted
            if not found:
                return
            after = str(max(int(id) for id, _, _ in found))


class _BatchReader(_Channels, DataSourceReader):
    def partitions(self):
        return [p for c in self.channels for p in self.parts(c, self.after.get(c), self.until.get(c))]


class _StreamReader(_Channels, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {c: self.after.get(c) for c in self.channels}

    def latestOffset(self) -> dict:
        """The newest id of each channel."""
        known = getattr(self, "known", None) or self.initialOffset()
        for c in self.channels:
            if "until" in self.options:
                known[c] = self.until.get(c) or known.get(c)
            elif "newest" in self.options:
                known[c] = self.named("newest")(c) or known.get(c)
            elif "folder" in self.options:
                known[c] = self._newest_archived(c, known.get(c))
            else:
                for _, id, _, _ in self.posts(c, known.get(c)):
                    known[c] = id
        self.known = known
        return dict(known)

    def _newest_archived(self, channel: str, known: str | None) -> str | None:
        seen = self.seen = getattr(self, "seen", set())
        for file in archive_files(self.options["folder"], channel):
            if file not in seen:
                for id, _, _ in archived(self.options["folder"], file[0], known, None):
                    known = str(id) if known is None or int(id) > int(known) else known
                seen.add(file)
        return known

    def partitions(self, start: dict, end: dict):
        return [p for c, last in end.items() if last is not None and last != start.get(c) for p in self.parts(c, start.get(c), last)]

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the offset."""

"""A data source that lists the videos of many directories, each directory by a task."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framelake.functions.exprs import VIDEO_EXTENSIONS

SCHEMA = "path string, length bigint, modificationTime timestamp"


@dataclass
class Directories(InputPartition):
    paths: tuple[str, ...]


def is_video(name: str) -> bool:
    """Names that begin with a dot are hidden; all others count, those that begin with an underscore too."""
    return not name.startswith(".") and "." in name and name.rsplit(".", 1)[1].lower() in VIDEO_EXTENSIONS


class _Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], tasks: int) -> None:
        self.paths, self.tasks = list(paths), tasks

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.tasks, len(self.paths)))
        return [Directories(tuple(self.paths[k::n])) for k in range(n)]

    def read(self, partition: Directories) -> Iterator[tuple[str, int, datetime]]:
        from pyarrow import fs

        for directory in partition.paths:
            files, root = fs.FileSystem.from_uri(directory)
            for f in files.get_file_info(fs.FileSelector(root, allow_not_found=False)):
                if f.type == fs.FileType.File and is_video(f.base_name):
                    changed = f.mtime or datetime.fromtimestamp(0, timezone.utc)
                    yield f"{directory.rstrip('/')}/{f.base_name}", f.size, changed.astimezone(timezone.utc)


class MediaListing(DataSource):
    """The videos in directories, not below them: path, length, modificationTime, unsorted.

    Options: `path`, one directory, or `directories`, a JSON list of them (absolute paths, or URIs of a store that Arrow
    reads); `tasks`, among how many the directories are dealt. The driver lists nothing. A directory that isn't there is an
    error.
    """

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        given = self.options.get("directories")
        paths = json.loads(given) if given else [self.options["path"]] if "path" in self.options else []
        if not paths:
            raise ValueError("media_listing needs the option path or directories")
        return _Reader(paths, int(self.options.get("tasks", "64")))

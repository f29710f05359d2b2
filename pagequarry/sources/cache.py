"""A store of cached pages as a Spark data source: one file for each page, named by its key, plain or packed by gzip, some of them PDFs.

``spark.read.format("page_cache").load(folder)`` gives (key, is_pdf, html); see ``pages``. Conditions on the key go to the reader:
keys that are asked for are opened by name, without listing the folder, and a common beginning of keys leaves other files unopened. Of a PDF
only the first bytes are read.

Cases: a missing file has no row; an empty file is an empty page; what begins like gzip but can't be unpacked is taken as it
stands; bytes that aren't UTF-8 become U+FFFD; a folder without files gives no rows. Files with other endings than the store's are none of its
pages. Subfolders are read, a task for each, only if the store is ``deep``; keys asked for are then looked up in lists of names. Two files of one key
(page and packed page) are two rows. A key has no point or slash; a condition on null keys finds nothing.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "key string, is_pdf boolean, html string"
PDF, GZIP = b"%PDF-", b"\x1f\x8b\x08"
#: What a file's name has behind its key; files of one task; bytes of pages handed over at once.
ENDINGS, FILES, BATCH_BYTES = ("", ".html", ".html.gz", ".gz", ".pdf"), 512, 8 << 20


@dataclass
class Files(InputPartition):
    """Files by their paths, or a folder whose files the task lists itself."""

    paths: list[str]
    folder: str = ""

    def __post_init__(self):
        super().__init__(self.paths)


def key_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def page_of(store: fs.FileSystem, path: str) -> tuple[bool, str | None]:
    """(whether it is a PDF, the page)."""
    with store.open_input_stream(path, compression=None) as f:
        head = f.read(len(PDF))
        if head == PDF:
            return True, None
        content = head + f.read()
    if content.startswith(GZIP):
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError, zlib.error):
            pass
    return False, content.decode("utf-8", "replace")


class CacheReader(DataSourceReader):
    def __init__(self, folder: str, files: int, endings: Iterable[str], deep: bool = False):
        self.folder, self.files, self.endings, self.deep = folder.rstrip("/"), files, tuple(endings), deep
        self.keys: set[str] | None = None
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                asked = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.keys = asked if self.keys is None else self.keys & asked
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",):
                self.starts.append(f.value)
            else:
                yield f

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def wanted(self, path: str) -> bool:
        key, name = key_of(path), path.rsplit("/", 1)[-1]
        return name[len(key) :] in self.endings and (self.keys is None or key in self.keys) and all(key.startswith(s) for s in self.starts)

    def by_name(self) -> bool:
        return self.keys is not None and not self.deep

    def partitions(self) -> list[Files]:
        """Keys asked for, by name; else the folder's own files in even parts and, in a deep store, a part for each subfolder."""
        store, root = self.store()
        if self.by_name():
            paths, folders = [p for k in sorted(self.keys) if k and "/" not in k for e in self.endings if self.wanted(p := f"{root}/{k}{e}")], []
        else:
            infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            paths = sorted(i.path for i in infos if i.type == fs.FileType.File and self.wanted(i.path))
            folders = sorted(i.path for i in infos if i.type == fs.FileType.Directory and self.deep)
        return [Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] + [Files([], f) for f in folders] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self.store()
        if partition.folder:
            infos = store.get_file_info(fs.FileSelector(partition.folder, recursive=True))
        else:
            infos = store.get_file_info(partition.paths) if self.by_name() else None
        paths = partition.paths if infos is None else [i.path for i in infos if i.type == fs.FileType.File and self.wanted(i.path)]
        rows, size = [], 0
        for path in paths:
            rows.append((key_of(path), *page_of(store, path)))
            size += len(rows[-1][2] or "")
            if size > BATCH_BYTES or path == paths[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.string()), strict=True)], names=["key", "is_pdf", "html"])
                rows, size = [], 0


class PageCache(DataSource):
    """Options: ``path``; ``files``, of one task at most; ``endings`` that a key's file may have, with commas between; ``deep``, whether subfolders are read."""

    @classmethod
    def name(cls) -> str:
        return "page_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CacheReader:
        return CacheReader(self.options["path"], int(self.options.get("files", FILES)), self.options["endings"].split(",") if "endings" in self.options else ENDINGS, self.options.get("deep", "false").lower() == "true")


def pages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The store's pages: (key, is_pdf, html). Registers the source with the session and lets Python sources take conditions there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageCache)
    return spark.read.format("page_cache").options(**options).load(folder)

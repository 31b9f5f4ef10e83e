"""Scanned uploads as a data source (S1, S3, S4): ``spark.read.format("scanned")``.

The source lists a folder, plans its files into partitions by size, tells each file's
type by its first bytes, and hands its bytes to a recogniser, a function
``(bytes, content type) -> pages`` that is named by an option and imported where it
runs.  A page is a dict with ``text``, ``tsv`` (word rows as ``readers.tsv_rows`` reads
them), ``width``, ``height``, ``n_chars`` and ``has_image``, each optional.  What cannot
be read is a row with a reason and not an error: an unknown type, no recogniser, a
recogniser that is not available or fails, a file that has no page.

Folders are opened with Arrow's file systems, so they may be local or in a store that
these know.
"""

from __future__ import annotations

from importlib import import_module

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, content_type string, page int, method string, text string, tsv string, width double, height double, n_chars int, has_image boolean, reject_reason string"
PARTITION_BYTES = 64 << 20
MAX_BYTES = 256 << 20
MAGIC = ((b"%PDF", "application/pdf"), (b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG", "image/png"))


class Unavailable(Exception):
    """The recogniser cannot run here, such as without its program."""


class _Part(InputPartition):
    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def planned(sizes: list[tuple[str, int]], limit: int) -> list[tuple[str, ...]]:
    """Files in order of their path, in runs of up to ``limit`` bytes; a larger file has a partition of its own."""
    out: list[list[str]] = []
    held = limit + 1
    for path, size in sorted(sizes):
        if held + size > limit:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [tuple(x) for x in out]


def content_type(data: bytes) -> str | None:
    return next((kind for magic, kind in MAGIC if data.startswith(magic)), None)


def recogniser(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class ScanReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name = options["path"], options.get("recogniser")
        self.limit, self.most = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("maxbytes", MAX_BYTES))
        self.min_chars = int(options.get("minchars", 20))

    def _files(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        store, folder = self._files()
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        return [_Part(p) for p in planned([(f.path, f.size) for f in found if f.is_file], self.limit)]

    def read(self, partition: _Part):
        store, _ = self._files()
        for path in partition.paths:
            yield from self._rows(path, store)

    def _rows(self, path: str, store: fs.FileSystem):
        size = store.get_file_info(path).size
        with store.open_input_stream(path) as stream:
            data = stream.read(min(size, self.most))
        kind = content_type(data)
        reject = lambda why, page=None: (path, kind, page, None, None, None, None, None, None, None, why)
        if kind is None or size > self.most:
            yield reject("unsupported content type" if kind is None else "file too large")
            return
        try:
            read = recogniser(self.name)
            if read is None:
                yield reject("no recogniser")
                return
            pages = list(read(data, kind))
        except Unavailable as error:
            yield reject(f"recogniser unavailable: {error}")
            return
        except Exception as error:  # noqa: BLE001 - one bad file does not stop the scan
            yield reject(f"recogniser failed: {type(error).__name__}: {error}")
            return
        if not pages:
            yield reject("no pages")
        for n, page in enumerate(pages, 1):
            text = page.get("text")
            chars = int(page.get("n_chars", len("".join((text or "").split()))))
            image = bool(page.get("has_image", kind != "application/pdf"))
            method = "text" if kind == "application/pdf" and (chars >= self.min_chars or not image) else "ocr"
            measure = lambda k, p=page: None if p.get(k) is None else float(p[k])
            yield (path, kind, n, method, text, page.get("tsv"), measure("width"), measure("height"), chars, image, None)


class Scanned(DataSource):
    """Options: ``path``, ``recogniser`` (module:function), ``partitionBytes``, ``maxBytes``, ``minChars``."""

    @classmethod
    def name(cls) -> str:
        return "scanned"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScanReader:
        return ScanReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Scanned)

"""A vault as a bounded batch source: what a scan may list, take and report has ceilings.

register(spark), then spark.read.format("markdown_vault") with the option path and any of max_entries, max_files,
max_total_bytes, max_file_bytes and max_errors; or bounded_scan(). The path is a folder that all machines see, or an address
of a store that pyarrow knows (hdfs://, s3://; links are not told apart there, and a folder's names are listed whole).

Folders are listed when the query is planned, up to the ceilings, so the driver holds max_files names at most; texts are
read in tasks, neighbouring files of a folder together. A file that a ceiling leaves out is never opened. Conditions
on relative_path (equality, in a list, a beginning) reach the source: they take nothing from the scan, whose ceilings
count as they would without, but only files that meet them are opened."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

#: Ceilings unless others are given, and the files and bytes that one task reads.
LIMITS = {"max_entries": 1_000_000, "max_files": 200_000, "max_total_bytes": 1 << 36, "max_file_bytes": 1 << 26, "max_errors": 100}
TASK_FILES, TASK_BYTES = 2_000, 1 << 26
#: Codes of what goes wrong (fixed values).
LISTING, READING, LIMIT, LINK_FOUND, MISSING = "SOURCE_DISCOVERY_FAILED", "SOURCE_READ_FAILED", "SOURCE_SCAN_LIMIT_EXCEEDED", "PATH_SECURITY_VIOLATION", "SOURCE_UNAVAILABLE"
SCHEMA = "relative_path string, size long, modified_at timestamp, text string, error string, complete boolean"


class Found(NamedTuple):
    relative_path: str
    size: int
    modified: float
    is_link: bool


class Entry(NamedTuple):
    name: str
    is_folder: bool
    is_link: bool
    size: int | None  # None: it could not be told
    modified: float


class Scan(NamedTuple):
    files: list[Found]
    entries: int
    total_bytes: int
    complete: bool
    errors: list[str]


def _store(root: str):
    """File system and path of a root that is an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _is_folder(root: str) -> bool:
    if "://" not in root:
        return os.path.isdir(root)
    store, path = _store(root)
    return store.get_file_info(path).type.name == "Directory"


def _entries(root: str, folder: str, most: int) -> list[Entry]:
    """At most `most` entries of a folder; OSError where it cannot be listed."""
    if "://" in root:
        from pyarrow import fs

        store, path = _store(root)
        found = store.get_file_info(fs.FileSelector(f"{path}/{folder}".rstrip("/")))
        return [Entry(i.base_name, i.type.name == "Directory", False, i.size, (i.mtime_ns or 0) / 1e9) for i in found[:most]]
    entries = []
    with os.scandir(os.path.join(root, folder)) as listing:
        for e in islice(listing, most):
            try:
                status = e.stat()
                entries.append(Entry(e.name, e.is_dir(), e.is_symlink(), status.st_size, status.st_mtime))
            except OSError:
                entries.append(Entry(e.name, False, e.is_symlink(), None, 0.0))
    return entries


def discover(root: str, limits: dict[str, int], wanted: Callable[[str], bool] = lambda path: True) -> Scan:
    """The .md files below root in the order they are met: a folder's own by name, then its folders, the last name
    first. Hidden folders are passed over, folders that are links are an error and not entered. The scan ends at
    the first entry, file or byte above a ceiling; errors above max_errors are not kept, but a scan with any is not complete.
    All files count, those that are not wanted too, but only wanted ones are kept."""
    files: list[Found] = []
    errors: list[str] = []
    seen = taken = total = failed = 0

    def error(code: str) -> None:
        nonlocal failed
        failed += 1
        if len(errors) < limits["max_errors"]:
            errors.append(code)

    def stopped() -> Scan:
        error(LIMIT)
        return Scan(files, seen, total, False, errors)

    if not _is_folder(root):
        return Scan([], 0, 0, False, [MISSING])
    folders = [""]
    while folders:
        folder = folders.pop()
        try:
            entries = _entries(root, folder, limits["max_entries"] - seen + 1)
        except OSError:
            error(LISTING)
            continue
        seen += len(entries)
        if seen > limits["max_entries"]:
            return stopped()
        for entry in sorted(entries):
            name = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_folder:
                if entry.is_link and not entry.name.startswith("."):
                    error(LINK_FOUND)
                elif not entry.name.startswith("."):
                    folders.append(name)
            elif os.path.splitext(entry.name)[1] == ".md":
                if entry.size is None:
                    error(READING)
                    continue
                if entry.size > limits["max_file_bytes"] or total + entry.size > limits["max_total_bytes"] or taken >= limits["max_files"]:
                    return stopped()
                if wanted(name):
                    files.append(Found(name, entry.size, entry.modified, entry.is_link))
                taken += 1
                total += entry.size
    return Scan(files, seen, total, not failed, errors)


class Stretch(InputPartition):
    """Files that one task reads, or (without files) errors of the scan."""

    def __init__(self, files: list[Found], errors: list[str], complete: bool):
        super().__init__(len(files))
        self.files, self.errors, self.complete = files, errors, complete


class VaultReader(DataSourceReader):
    def __init__(self, root: str, limits: dict[str, int]):
        self.root, self.limits, self.conditions = root, limits, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("relative_path",):
                self.conditions.append(f)
            else:
                yield f

    def _wanted(self, path: str | None) -> bool:
        meets = lambda f: path.startswith(f.value) if isinstance(f, StringStartsWith) else path in f.value if isinstance(f, In) else path == f.value
        return not self.conditions or (path is not None and all(meets(f) for f in self.conditions))

    def partitions(self) -> list[Stretch]:
        scan = discover(self.root, self.limits, self._wanted)
        found = [Stretch([], scan.errors, scan.complete)] if scan.errors and self._wanted(None) else []
        part: list[Found] = []
        for file in scan.files:
            if part and (len(part) >= TASK_FILES or sum_of + file.size > TASK_BYTES):
                found.append(Stretch(part, [], scan.complete))
                part = []
            sum_of = file.size + (sum_of if part else 0)
            part.append(file)
        return [*found, Stretch(part, [], scan.complete)] if part or not found else found

    def _opened(self, relative_path: str):
        if "://" not in self.root:
            return open(os.path.join(self.root, relative_path), "rb")
        store, path = _store(self.root)
        return store.open_input_file(f"{path}/{relative_path}")

    def _text(self, file: Found) -> tuple[str | None, str | None]:
        if file.is_link:
            return None, LINK_FOUND
        try:
            with self._opened(file.relative_path) as f:
                raw = f.read(self.limits["max_file_bytes"] + 1)
            return (None, LIMIT) if len(raw) > self.limits["max_file_bytes"] else (raw.decode(), None)
        except (OSError, UnicodeDecodeError):
            return None, READING

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for code in partition.errors:
            yield None, None, None, None, code, partition.complete
        for file in partition.files:
            text, error = self._text(file)
            yield file.relative_path, file.size, datetime.fromtimestamp(file.modified, timezone.utc), text, error, partition.complete


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VaultReader:
        limits = {name: int(self.options.get(name, most)) for name, most in LIMITS.items()}
        if min(limits.values()) <= 0:
            raise ValueError("limits of a scan must be positive")
        return VaultReader(self.options["path"].removeprefix("file://").removeprefix("file:"), limits)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets conditions reach Python sources there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)


def bounded_scan(spark: SparkSession, root: str, **limits: int) -> DataFrame:
    """relative_path, size, modified_at, text, error, complete of the .md files below root, within limits (see LIMITS).

    complete tells whether the listing met no error and no ceiling. A file that cannot be read, is no UTF-8, is a
    link or has grown above max_file_bytes has its error and no text; each error of the listing is a row without a path,
    max_errors at most. A root that is not there gives one such row; an empty one gives no row."""
    if any(name not in LIMITS for name in limits):
        raise ValueError(f"limits of a scan are {', '.join(LIMITS)}")
    register(spark)
    return spark.read.format("markdown_vault").options(path=root, **limits).load()

"""The change log as a stream source: pages of a Parquet folder in the order of its sequence numbers.

spark.dataSource.register(ChangeLogSource), then spark.readStream.format("change_log") with a schema and the
options path, sequence (the column, "sequence" unless given), max_rows and max_bytes. Each micro-batch is
one page, as change_log.delta_page() gives it: at most max_rows rows whose JSON has at most max_bytes, though
always one row. The offset is the last sequence read, so a stream that is started again at its
checkpoint goes on behind the last page it finished; a page that was begun is read again as it was.

A page is small by its bounds. Rows are read a stretch of some pages ahead, in the order of their sequences and
bounded by rows and bytes, and held until pages were made of them: however row groups overlap, each is decoded once
a stretch, not once a page, and by its statistics only where it can have rows of it. Files that come meanwhile make
the rest of a stretch void. For bulk reads of a log whose pages don't matter, Spark's own file stream is the faster way."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from datetime import date, datetime
from itertools import chain

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from mnemospark.streaming.change_log import PAGE_BYTES, cursor_token

MOST_ROWS = 64
#: Pages and bytes that a stretch has about.
AHEAD_PAGES, AHEAD_BYTES = 32, 1 << 26


class ChangeLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_log"

    def simpleStreamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(schema, dict(self.options))


def _wire(value):
    """A value as Spark's to_json() writes it, for its size."""
    if isinstance(value, datetime):
        return f"{value:%Y-%m-%dT%H:%M:%S}.{value.microsecond // 1000:03d}" + ("Z" if value.tzinfo else "")
    return value.isoformat() if isinstance(value, date) else base64.b64encode(value).decode() if isinstance(value, bytes) else value


class ChangeLogReader(SimpleDataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.columns = schema, schema.fieldNames()
        self.path, self.sequence = options["path"], options.get("sequence", "sequence")
        self.most_rows, self.most_bytes = int(options.get("max_rows", MOST_ROWS)), int(options.get("max_bytes", PAGE_BYTES))
        if self.most_rows < 1 or self.most_bytes < 1:
            raise ValueError("max_rows and max_bytes must be positive")
        if self.sequence not in self.columns:
            raise ValueError(f"the schema has no column {self.sequence}")
        self.at, self.ahead = None, iter(())  # files and last sequence as they were, and the rows that follow

    def initialOffset(self) -> dict:
        return {"last_sequence": 0}

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def _files(self) -> list[tuple]:
        """Path, size and time of all files below the path."""
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((i.path, i.size, i.mtime_ns) for i in found if i.type == fs.FileType.File)

    def _groups(self) -> Iterator[tuple[int, int, object, int, int, int]]:
        """Least and largest sequence, fragment, number, rows and bytes of each row group, from the files' footers."""
        import pyarrow.dataset as ds

        store, path = self._store()
        for fragment in ds.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False).get_fragments():
            for group in fragment.row_groups:
                bounds = (group.statistics or {}).get(self.sequence)
                if group.num_rows and bounds:  # none where no row has a sequence
                    yield bounds["min"], bounds["max"], fragment, group.id, group.num_rows, group.total_byte_size

    def _read(self, fragment, group: int, columns: list[str], above: int, up_to: int | None):
        """A row group's rows with a sequence above one, as a table."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.types import TimestampType

        place = ds.field(self.sequence)
        table = fragment.subset(row_group_ids=[group]).to_table(columns=columns, filter=(place > above) if up_to is None else (place > above) & (place <= up_to))
        for i, c in enumerate(columns):  # files may hold instants without a zone: they are of UTC
            if pa.types.is_timestamp(table.schema.field(i).type):
                table = table.set_column(i, c, table.column(i).cast(pa.timestamp("us", "UTC" if isinstance(self.schema[c].dataType, TimestampType) else None)))
        return table

    def _stretch(self, groups: list[tuple], above: int, up_to: int | None):
        """The next rows above a sequence, as a table in their order; None where there are none. The sequences alone tell
        where it ends; rows that share the last one all belong to it."""
        import numpy as np
        import pyarrow as pa

        groups = [g for g in groups if g[1] > above and (up_to is None or g[0] <= up_to)]
        if not groups:
            return None
        row = sum(g[5] for g in groups) // sum(g[4] for g in groups)
        most = max(1, min(AHEAD_PAGES * self.most_rows, AHEAD_BYTES // max(row, 1)))
        first = np.empty(0, np.int64)
        for low, _, fragment, group, *_ in groups:
            full = len(first) == most
            if full and low > first[-1]:
                break
            more = self._read(fragment, group, [self.sequence], above, int(first[-1]) if full else up_to).column(0).to_numpy()
            first = np.sort(np.concatenate([first, more.astype(np.int64)]))[:most]
        if not len(first):
            return None
        last = int(first[-1])
        table = pa.concat_tables([self._read(fragment, group, self.columns, above, last) for low, _, fragment, group, *_ in groups if low <= last], promote_options="permissive")
        return table.sort_by(self.sequence)

    def _rows(self, above: int, up_to: int | None = None) -> Iterator[tuple]:
        """Rows with a sequence above one, in order."""
        groups = sorted(self._groups(), key=lambda g: (g[0], g[1], g[2].path, g[3]))
        while (table := self._stretch(groups, above, up_to)) is not None:
            for batch in table.to_batches(max_chunksize=1024):
                yield from zip(*[batch.column(c).to_pylist() for c in self.columns], strict=True)
            above = table.column(self.sequence)[-1].as_py()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        above = last = int(start["last_sequence"])
        files = self._files()
        rows = self.ahead if self.at == (files, above) else self._rows(above)
        page: list[tuple] = []
        size = 0
        place = self.columns.index(self.sequence)
        self.ahead = iter(())
        for row in rows:
            entry = {c: _wire(v) for c, v in zip(self.columns, row, strict=True) if v is not None}
            size += len(json.dumps(entry, separators=(",", ":"), ensure_ascii=False).encode())
            if page and (len(page) >= self.most_rows or size > self.most_bytes):
                self.ahead = chain([row], rows)
                break
            page.append(row)
            last = row[place]
        self.at = (files, last)
        return iter(page), {"last_sequence": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(int(start["last_sequence"]), int(end["last_sequence"]))

    def cursor(self, offset: dict) -> str:
        """The cursor token of an offset, for readers of pages."""
        return cursor_token(int(offset["last_sequence"]))

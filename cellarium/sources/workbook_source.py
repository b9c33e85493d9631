"""spark.read.format("xlsx"): the cells of workbooks, a partition for each sheet.

Files are opened by Arrow's file systems (local and shared folders, HDFS, S3, ...) and read as streams: a task holds the
shared texts of its workbook and BATCH cells, never a file or a sheet. A store that only Spark reads is served by
xlsx.cells, which takes whole files from Spark's binary reader.

Options: sheet (only this one), mode (`cells`: values and formulas; `formulas`: only formula cells; `sheets`: a row for each
sheet; `refused`: a row for each file that can't be read, with the reason), largest and ratio (unpacked bytes, and how many
times its size a file may unpack to). Files that can't be read are left out of the other modes, as one bad file mustn't end
a job over many; `refused` lists them.
"""

from __future__ import annotations

import fnmatch
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from cellarium.sources import xlsx

BATCH = 10_000
MODES = {"cells": xlsx.CELLS, "formulas": xlsx.CELLS, "sheets": "file string, sheet string, position int, state string", "refused": "file string, reason string"}


class Sheet(InputPartition):
    def __init__(self, file: str, name: str, part: str) -> None:
        self.file, self.name, self.part = file, name, part


def listed(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The files of a path, which may be a folder or have * and ? in its last part."""
    root, _, last = path.rstrip("/").rpartition("/")
    pattern = last if re.search(r"[*?\\[]", last) else None
    system, base = fs.FileSystem.from_uri(root if pattern else path.rstrip("/")) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), root if pattern else path)
    if not pattern and system.get_file_info(base).is_file:
        return system, [base]
    found = [i.path for i in system.get_file_info(fs.FileSelector(base)) if i.is_file]
    return system, sorted(f for f in found if fnmatch.fnmatch(f.rpartition("/")[2], pattern or "*.xlsx"))


def opened(system: fs.FileSystem, file: str, largest: int, ratio: float) -> zipfile.ZipFile:
    """The workbook, of which only the list of its parts has been read."""
    size = system.get_file_info(file).size
    try:
        z = zipfile.ZipFile(system.open_input_file(file))
    except (zipfile.BadZipFile, OSError, pa.ArrowInvalid) as e:  # ArrowInvalid: shorter than a zip file can be
        raise xlsx.Refused("no zip file") from e
    whole = sum(i.file_size for i in z.infolist())
    if whole > largest or whole > ratio * max(1, size):
        raise xlsx.Refused(f"it unpacks to {whole} bytes")
    if "xl/workbook.xml" not in z.namelist():
        raise xlsx.Refused("no workbook in it")
    return z


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.mode, self.sheet = options["path"], options.get("mode", "cells"), options.get("sheet")
        self.largest, self.ratio = int(options.get("largest", xlsx.LARGEST)), float(options.get("ratio", xlsx.RATIO))
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {sorted(MODES)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """sheet = '...' prunes partitions; all filters are still applied."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",) and self.mode != "refused":
                self.sheet = self.sheet or f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        """A partition a sheet; a file for the modes that look at whole files. Only lists of parts are read here."""
        system, files = listed(self.path)
        if self.mode in ("sheets", "refused"):
            return [Sheet(f, "", "") for f in files]
        out: list[InputPartition] = []
        for f in files:
            try:
                with opened(system, f, self.largest, self.ratio) as z:
                    out += [Sheet(f, name, part) for name, _, part in xlsx._sheets(z) if self.sheet in (None, name)]
            except xlsx.Refused:
                continue
        return out

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no sheet to read
            return
        system, _ = listed(self.path)
        names = [c.split()[0] for c in MODES[self.mode].split(", ")]
        if self.mode in ("sheets", "refused"):
            rows: list[tuple] = []
            try:
                with opened(system, partition.file, self.largest, self.ratio) as z:
                    if self.mode == "sheets":
                        rows = [(partition.file, name, i, state) for i, (name, state, _) in enumerate(xlsx._sheets(z)) if self.sheet in (None, name)]
            except xlsx.Refused as e:
                if self.mode == "refused":
                    rows = [(partition.file, str(e))]
            yield from _batched(rows, names, self.mode)
            return
        with opened(system, partition.file, self.largest, self.ratio) as z:
            cells = ((partition.file, partition.name, *r) for r in xlsx._rows(z, partition.part, xlsx._strings(z)) if self.mode == "cells" or r[-1] is not None)
            yield from _batched(cells, names, self.mode)


def _batched(rows: Iterator[tuple] | list[tuple], names: list[str], mode: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MODES[mode].split(", ")])
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return MODES.get(self.options.get("mode", "cells"), xlsx.CELLS)

    def reader(self, schema: object) -> WorkbookReader:  # noqa: ARG002
        return WorkbookReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("xlsx") known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)

"""A data source in Python: folders of Arrow files, with a list that a write is added to as one, and files left out by their bounds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "arrow_files"
LIST = "list.json"
#: Types whose least and greatest values are kept for each file.
BOUNDED = (pa.types.is_integer, pa.types.is_floating, pa.types.is_string)


def use(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)


def _listed(folder: str) -> dict | None:
    where, base = fs.FileSystem.from_uri(folder)
    if where.get_file_info(f"{base}/{LIST}").type != fs.FileType.File:
        return None
    with where.open_input_stream(f"{base}/{LIST}") as file:
        return json.loads(file.read())


class ArrowFiles(DataSource):
    """Format `arrow_files` with the option `path`, a URI of a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = _listed(self.options["path"])
        if found is None:
            raise ValueError(f"no {LIST} in {self.options['path']}")
        return StructType.fromJson(found["schema"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


@dataclass
class Piece(InputPartition):
    path: str


class Reader(DataSourceReader):
    """A partition for each listed file that filters on its bounds don't rule out."""

    def __init__(self, folder: str) -> None:
        self.folder, self.filters = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons leave files out; rows are still told one by one by Spark, so all filters are handed back."""
        self.filters = [f for f in filters if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1]
        return filters

    def _may_hold(self, bounds: dict[str, list]) -> bool:
        for f in self.filters:
            if f.attribute[0] not in bounds:
                continue
            low, high = bounds[f.attribute[0]]
            if low is None:  # nulls alone, of which no comparison is true
                return False
            out = {EqualTo: lambda: f.value < low or f.value > high, GreaterThan: lambda: high <= f.value, GreaterThanOrEqual: lambda: high < f.value, LessThan: lambda: low >= f.value, LessThanOrEqual: lambda: low > f.value}
            try:
                if out[type(f)]():
                    return False
            except TypeError:
                continue
        return True

    def partitions(self) -> list[InputPartition]:
        found = _listed(self.folder)
        return [Piece(f["path"]) for f in found["files"] if self._may_hold(f["bounds"])] if found else []

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what is read where there are no partitions
            return
        where, base = fs.FileSystem.from_uri(self.folder)
        with where.open_input_stream(f"{base}/{partition.path}") as file:
            yield from pa.ipc.open_stream(file)


@dataclass
class Done(WriterCommitMessage):
    path: str | None
    rows: int
    bounds: dict[str, list]


class Writer(DataSourceArrowWriter):
    """Each task writes a file of a name of its own; no reader sees one before the list names it.

    The list is written once, by the driver, when every task is done, and takes the old one's place in one step.
    A task that is run twice leaves a second file that no list names. A write that fails leaves the list as it was.
    """

    def __init__(self, folder: str, schema: StructType, overwrite: bool) -> None:
        self.folder, self.fields, self.overwrite = folder, schema.jsonValue(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        where, base = fs.FileSystem.from_uri(self.folder)
        name, rows, bounds, sink, out = f"{uuid.uuid4().hex}.arrow", 0, {}, None, None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if out is None:
                    where.create_dir(base, recursive=True)
                    sink = where.open_output_stream(f"{base}/{name}")
                    out = pa.ipc.new_stream(sink, b.schema)
                out.write_batch(b)
                rows += b.num_rows
                for field, column in zip(b.schema, b.columns, strict=True):
                    if any(is_kind(field.type) for is_kind in BOUNDED):
                        here, was = pc.min_max(column).as_py(), bounds.get(field.name, [None, None])
                        low, high = ([x for x in (a, here[k]) if x is not None] for a, k in zip(was, ("min", "max"), strict=True))
                        bounds[field.name] = [min(low, default=None), max(high, default=None)]
        finally:
            for x in (out, sink):
                if x is not None:
                    x.close()
        # NaN compares with nothing, so bounds of a column that holds one say nothing
        bounds = {c: b for c, b in bounds.items() if all(x == x for x in b)}
        return Done(name if rows else None, rows, bounds)

    def commit(self, messages: list[Done | None]) -> None:
        where, base = fs.FileSystem.from_uri(self.folder)
        where.create_dir(base, recursive=True)
        old = None if self.overwrite else _listed(self.folder)
        if old is not None and old["schema"] != self.fields:
            self.abort(messages)
            raise ValueError("the rows' columns aren't those of the folder")
        files = [{"path": m.path, "rows": m.rows, "bounds": m.bounds} for m in messages if m is not None and m.path]
        text = json.dumps({"schema": self.fields, "files": [*(old["files"] if old else []), *files]})
        own = f"{base}/.{LIST}.{uuid.uuid4().hex}"
        with where.open_output_stream(own) as out:
            out.write(text.encode())
        where.move(own, f"{base}/{LIST}")

    def abort(self, messages: list[Done | None]) -> None:
        where, base = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None and m.path:
                where.delete_file(f"{base}/{m.path}")

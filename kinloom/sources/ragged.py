"""Ragged CSV as a Python data source.

Spark's own CSV reader drops blank lines, cuts surplus cells and numbers no rows. This one emits
(source_file, source_row, cells) for every record, blank ones included: one partition a file, read
as a stream, rows numbered from 1 with the header. Files on any file system that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_file string, source_row int, cells array<string>"


def records(chunks: Iterable[str]) -> Iterator[list[str]]:
    """Cells of each record. Quotes open only at the beginning of a cell; elsewhere they are text.
    A line without a character is a record of one empty cell."""
    cells, cell, state, any_, skip_lf = [], [], "start", False, False
    for chunk in chunks:
        for c in chunk:
            if skip_lf:
                skip_lf = False
                if c == "\n":
                    continue
            any_ = True
            if state == "quoted":
                if c == '"':
                    state = "closing"
                else:
                    cell.append(c)
                continue
            if state == "closing" and c == '"':
                cell.append(c)
                state = "quoted"
            elif state == "start" and c == '"':
                state = "quoted"
            elif c == ",":
                cells.append("".join(cell))
                cell, state = [], "start"
            elif c in "\r\n":
                skip_lf = c == "\r"
                yield [*cells, "".join(cell)]
                cells, cell, state, any_ = [], [], "start", False
            else:
                cell.append(c)
                state = "plain"
    if any_:
        yield [*cells, "".join(cell)]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        import io

        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(partition.path)
        name = inner.rpartition("/")[2]
        with io.TextIOWrapper(system.open_input_file(inner), encoding="utf-8-sig", errors="replace", newline="") as f:
            for i, cells in enumerate(records(iter(lambda: f.read(1 << 20), "")), 1):
                yield name, i, cells


class RaggedCsv(DataSource):
    """spark.read.format("ragged_csv").load(path), or option("paths", JSON list)."""

    @classmethod
    def name(cls):
        return "ragged_csv"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        import json

        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _Reader([p if "://" in p else f"file://{p}" for p in paths])


def read_ragged(spark: SparkSession, *paths: str) -> DataFrame:
    import json
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that plans the scan need not have this package
    spark.dataSource.register(RaggedCsv)
    return spark.read.format("ragged_csv").option("paths", json.dumps(paths)).load()

"""Positioned content of documents as a data source: ``spark.read.format("layout")``.

A layout folder keeps each kind of content, a part, apart, and each part by spans of pages: ``part=lines/span=3/*.json``, one JSON object a
row.  The source reads one part; its partitions are byte ranges of files, and filters on ``page_index`` leave out the files of all
other spans before anything is opened.  Rows go from the file to Spark as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Pages of one span.
SPAN = 16
#: Bytes of a file that one task reads.
BYTES = 32 << 20
_PLACE = "doc_id bigint, page_index int"
_BOX = "x double, y double, width double, height double"
_FONT = "font_family string, font_size double, bold boolean, color string"
#: Columns of each part.
PARTS = {
    "pages": f"{_PLACE}, unit string, width double, height double",
    "items": f"{_PLACE}, item_seq int, str string, transform array<double>, width double, height double",
    "lines": f"{_PLACE}, line_seq int, text string, {_BOX}, baseline double, {_FONT}",
    "boxes": f"{_PLACE}, box_seq int, {_BOX}, stroke string, fill string, stroke_width double",
    "images": f"{_PLACE}, image_seq int, id string, {_BOX}, natural_w int, natural_h int",
    "tables": f"{_PLACE}, table_seq int, {_BOX}, columns array<double>, row_heights array<double>",
    "cells": f"{_PLACE}, table_seq int, row int, col int, row_span int, col_span int, text string, stroke string, fill string, {_FONT}",
}


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in a range of bytes."""

    path: str
    start: int
    end: int


class LayoutReader(DataSourceReader):
    def __init__(self, path: str, part: str, schema: T.StructType, size: int = BYTES) -> None:
        self.path, self.part, self.schema, self.size = path.rstrip("/"), part, schema, size
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the pages to read; every filter is given back, as files hold pages around them."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page_index",):
                continue
            low, high = None, None
            if isinstance(f, EqualTo):
                low = high = f.value
            elif isinstance(f, In) and f.value:
                low, high = min(f.value), max(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
            self.low = self.low if low is None else max(self.low, low)
            self.high = self.high if high is None else high if self.high is None else min(self.high, high)
        return filters

    def partitions(self) -> list[Piece]:
        """Pieces of the files whose span meets the pages asked for."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        out = []
        for info in store.get_file_info(fs.FileSelector(f"{root}/part={self.part}", recursive=True, allow_not_found=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            if not info.is_file or not info.size or not info.base_name.endswith(".json") or info.base_name.startswith(("_", ".")):
                continue
            span = int(parts["span"])
            if (span + 1) * SPAN > self.low and (self.high is None or span * SPAN <= self.high):
                out += [Piece(scheme + info.path, a, min(a + self.size, info.size)) for a in range(0, info.size, self.size)]
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, json
        from pyspark.sql.pandas.types import to_arrow_schema

        if piece is None:  # nothing to read
            return
        store, path = fs.FileSystem.from_uri(piece.path) if "://" in piece.path or piece.path.startswith("file:") else (fs.LocalFileSystem(), piece.path)
        with store.open_input_file(path) as f:
            f.seek(max(0, piece.start - 1))
            data = f.read(piece.end - max(0, piece.start - 1))
            if piece.start:  # the line that runs over the border is the piece's before
                data = data[data.index(b"\n") + 1 :] if b"\n" in data else b""
                if not data:
                    return
            while not data.endswith(b"\n") and (more := f.read(1 << 16)):
                data += more[: more.find(b"\n") + 1] or more
        if not data.strip():
            return
        schema = to_arrow_schema(self.schema)
        table = json.read_json(pa.BufferReader(data), json.ReadOptions(block_size=max(1 << 20, len(data))), json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"))
        yield from table.select(schema.names).to_batches(max_chunksize=4096)


class LayoutSource(DataSource):
    """Option ``part`` names what is read (default ``lines``), ``path`` the layout folder.  Folders without that part give no rows."""

    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        return PARTS[self.options.get("part", "lines")]

    def reader(self, schema: T.StructType) -> LayoutReader:
        return LayoutReader(self.options["path"], self.options.get("part", "lines"), schema)


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a layout folder; filters on ``page_index`` are pushed into the scan."""
    spark.dataSource.register(LayoutSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("layout").option("part", part).load(path)


def write_part(rows: DataFrame, path: str, part: str) -> None:
    """Adds rows of a part, by spans of pages; columns that the part doesn't have are left out, those it lacks stay null."""
    have = [c for c in T._parse_datatype_string(PARTS[part]).names if c in rows.columns]
    spans = rows.select(*have, F.expr(f"page_index div {SPAN}").cast("int").alias("span"))
    spans.hint("rebalance", "span").write.partitionBy("span").mode("append").json(f"{path.rstrip('/')}/part={part}")

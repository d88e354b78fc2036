"""What Parquet files tell without their data pages: footer statistics and dictionaries of column chunks.

Row groups are the unit of work: :func:`row_groups` lists them in tasks, and callers describe or read them one at a time, each
with only the chunks they need (:class:`RowGroup`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dictionaries with more values than this aren't read for distinct values: their chunk is scanned.
MOST_VALUES = 100_000
#: Rows that a scan of a chunk holds at a time.
BATCH_ROWS = 65_536


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = buf[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _compact_struct(buf: bytes, at: int) -> tuple[dict, int]:
    """A struct in the compact protocol of Thrift as {field id: value}; nested structs alike."""
    fields, last = {}, 0
    while True:
        head = buf[at]
        at += 1
        if not head:
            return fields, at
        kind = head & 15
        if head >> 4:
            last += head >> 4
        else:
            raw, at = _varint(buf, at)
            last = raw >> 1 ^ -(raw & 1)
        if kind in (1, 2):
            fields[last] = kind == 1
        elif kind == 3:
            fields[last], at = buf[at], at + 1
        elif kind in (4, 5, 6):
            raw, at = _varint(buf, at)
            fields[last] = raw >> 1 ^ -(raw & 1)
        elif kind == 7:
            at += 8
        elif kind == 8:
            size, at = _varint(buf, at)
            at += size
        elif kind == 12:
            fields[last], at = _compact_struct(buf, at)
        else:
            raise ValueError("unexpected field in a page header")


def chunk_dictionary(source, chunk: pq.ColumnChunkMetaData) -> list | np.ndarray | None:
    """All distinct non-null values of a column chunk from its dictionary page; None unless every data page refers to it."""
    if not chunk.has_dictionary_page or chunk.physical_type not in ("BYTE_ARRAY", "INT32", "INT64", "DOUBLE", "FLOAT"):
        return None
    at, end, values = chunk.dictionary_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size, None
    while at < end:
        source.seek(at)
        head = source.read(min(1024 + 64, end - at))
        try:
            page, used = _compact_struct(head, 0)
        except (IndexError, ValueError):  # statistics longer than the window
            source.seek(at)
            page, used = _compact_struct(source.read(end - at), 0)
        if page[1] == 2:
            count = page[7][1]
            if count > MOST_VALUES:
                return None
            source.seek(at + used)
            body = source.read(page[3])
            if chunk.compression != "UNCOMPRESSED":
                body = pa.Codec(chunk.compression.lower()).decompress(body, page[2], asbytes=True)
            if chunk.physical_type == "BYTE_ARRAY":
                values, k = [], 0
                for _ in range(count):
                    size = int.from_bytes(body[k : k + 4], "little")
                    values.append(body[k + 4 : k + 4 + size])
                    k += 4 + size
            else:
                kind = {"INT32": np.int32, "INT64": np.int64, "DOUBLE": np.float64, "FLOAT": np.float32}[chunk.physical_type]
                values = np.frombuffer(body, kind, count)
        else:
            encoding = (page.get(5) or {}).get(2) if page[1] == 0 else (page.get(8) or {}).get(4)
            if encoding not in (2, 8):  # PLAIN_DICTIONARY, RLE_DICTIONARY: anything else left the dictionary
                return None
        at += used + page[3]
    return values


@dataclass
class Chunk:
    """What is known of a column chunk. ``kind``: int (also timestamps as microseconds, and dates), float, bool, text or other.

    ``values``: all distinct non-null values (numpy arrays, a list of bytes for text), ``lo`` and ``hi``: exact extrema, NaN
    aside; ``nulls``: their exact number. What the file doesn't tell is None.
    """

    kind: str
    rows: int
    nulls: int | None = None
    values: np.ndarray | list | None = None
    lo: object = None
    hi: object = None

    @property
    def empty(self) -> bool:
        return self.nulls is not None and self.nulls == self.rows


def _kind(chunk: pq.ColumnChunkMetaData, column) -> tuple[str, int]:
    """(kind, factor) of a leaf; a negative factor divides, to microseconds."""
    physical, logical = chunk.physical_type, column.logical_type.type
    if physical in ("INT32", "INT64") and logical in ("NONE", "INT", "DATE", "TIMESTAMP"):
        if "isSigned=false" in str(column.logical_type):
            return "other", 1
        unit = str(column.logical_type) if logical == "TIMESTAMP" else ""
        return "int", 1000 if "milli" in unit else -1000 if "nano" in unit else 1
    if physical in ("DOUBLE", "FLOAT"):
        return "float", 1
    if physical == "BOOLEAN":
        return "bool", 1
    return ("text" if physical == "BYTE_ARRAY" and logical not in ("DECIMAL",) else "other"), 1


def _scaled(v, factor: int):
    return v * factor if factor > 0 else v // -factor


class RowGroup:
    """One row group of a file: what its footer and dictionaries tell of a column, and its rows by batches."""

    def __init__(self, source, meta: pq.FileMetaData, group: int, source_name: str = ""):
        self.source, self.meta, self.group, self.source_name = source, meta, group, source_name
        self.rows = meta.row_group(group).num_rows
        self.leaves = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        self.tops = {p.split(".")[0] for p in self.leaves}

    def chunk(self, name: str) -> Chunk:
        """What is known of a column without its data pages. A file without the column holds NULL throughout."""
        if name not in self.tops or not self.rows:
            return Chunk("other", self.rows, self.rows, [])
        if name not in self.leaves:
            return Chunk("other", self.rows)
        at = self.leaves[name]
        chunk = self.meta.row_group(self.group).column(at)
        kind, factor = _kind(chunk, self.meta.schema.column(at))
        stats = chunk.statistics
        out = Chunk(kind, self.rows, stats.null_count if stats is not None and stats.has_null_count else None)
        extrema = stats is not None and stats.has_min_max
        if kind == "bool":
            if extrema:
                out.values = np.unique(np.array([stats.min, stats.max], np.int64))
        elif kind != "other":
            out.values = chunk_dictionary(self.source, chunk)
        if out.empty:
            out.values = [] if kind == "text" else np.zeros(0, np.int64)
            return out
        if kind == "int":
            if out.values is not None:
                out.values = np.unique(_scaled(out.values.astype(np.int64), factor))
            if extrema:
                out.lo, out.hi = _scaled(int(stats.min_raw), factor), _scaled(int(stats.max_raw), factor)
            elif out.values is not None and len(out.values):
                out.lo, out.hi = int(out.values[0]), int(out.values[-1])
        # statistics of floats leave NaN out and those of text may be cut: their extrema are those of the dictionary
        elif kind == "float" and out.values is not None:
            out.values = np.unique(out.values.astype(np.float64) + 0.0)
            solid = out.values[~np.isnan(out.values)]
            out.lo, out.hi = (float(solid[0]), float(solid[-1])) if len(solid) else (None, None)
        elif kind == "text" and out.values:
            out.lo, out.hi = min(out.values), max(out.values)
        return out

    def batches(self, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows of the named columns, read a batch at a time; columns that the file lacks are NULL."""
        held = [c for c in dict.fromkeys(columns) if c in self.tops]
        file = pq.ParquetFile(self.source, metadata=self.meta)
        if not held:
            yield pa.RecordBatch.from_arrays([pa.nulls(self.rows)] * len(columns), columns)
            return
        for batch in file.iter_batches(BATCH_ROWS, row_groups=[self.group], columns=held, use_threads=False):
            arrays = [batch.column(batch.schema.get_field_index(c)) if c in self.tops else pa.nulls(batch.num_rows) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)


def described(values: pa.Array) -> Chunk:
    """The same of values that were read."""
    kind = values.type
    out = Chunk("other", len(values), values.null_count)
    solid = values.drop_null()
    if pa.types.is_timestamp(kind):
        solid = solid.cast(pa.timestamp("us", kind.tz), safe=False).cast(pa.int64())
    elif pa.types.is_date32(kind):
        solid = solid.cast(pa.int32())
    kind = solid.type
    if pa.types.is_integer(kind) and kind != pa.uint64():
        out.kind, out.values = "int", np.unique(solid.to_numpy(zero_copy_only=False).astype(np.int64))
    elif pa.types.is_floating(kind):
        out.kind, out.values = "float", np.unique(solid.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0)
    elif pa.types.is_boolean(kind):
        out.kind, out.values = "bool", np.unique(solid.to_numpy(zero_copy_only=False).astype(np.int64))
    elif pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        out.kind, out.values = "text", solid.unique().cast(pa.large_binary()).to_pylist()
    else:
        out.values = sorted({repr(v).encode() for v in solid.to_pylist()})
    if out.kind in ("int", "float"):
        kept = out.values if out.kind == "int" else out.values[~np.isnan(out.values)]
        out.lo, out.hi = (kept[0].item(), kept[-1].item()) if len(kept) else (None, None)
    elif out.kind == "text" and out.values:
        out.lo, out.hi = min(out.values), max(out.values)
    return out


def _open(uri: str):
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    scheme, _, rest = uri.partition("://")
    where, path = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}" if rest else uri)
    return where.open_input_file(path)


class Files:
    """Opens row groups by (file, number); the file last asked for stays open."""

    def __init__(self):
        self.uri, self.source, self.meta = None, None, None

    def group(self, uri: str, group: int) -> RowGroup:
        if uri != self.uri:
            self.uri, self.source = uri, _open(uri)
            self.meta = pq.read_metadata(self.source)
        return RowGroup(self.source, self.meta, group, uri)


def row_groups(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(table_name, file, row_group) of Parquet tables (name -> path). Files are listed and their footers read by tasks, not by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files, groups = [], [], []
            for table, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(file) as source:
                    n = pq.read_metadata(source).num_row_groups
                names += [table] * n
                files += [file] * n
                groups += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.string()), pa.array(groups, pa.int32())], ["table_name", "file", "row_group"])

    # only the path of each file is selected, so none is opened for its content
    listed = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").load(p).select(F.lit(t).alias("table_name"), F.col("path").alias("file")) for t, p in tables.items()])
    return listed.mapInArrow(run, "table_name string, file string, row_group int").repartition(tasks_for(spark, list(tables.values())), "file", "row_group")


def tasks_for(spark: SparkSession, paths: list[str]) -> int:
    """Tasks that read the tables a scan partition each, by the size of their files, which the session knows from listing them."""
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = sum(int(str(spark.read.parquet(p)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for p in paths)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))

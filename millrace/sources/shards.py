"""A Python data source: Arrow shards with a manifest, read in splits with pushed filters and written with commit and abort.

A table is a folder of Arrow IPC files, one a task, and a manifest that names them with their batches and each column's
least and greatest value. Only files that the manifest names belong to the table: the manifest is written last and in one step, so
a job that fails or is run twice leaves the table as it was. Files are reached by pyarrow.fs, so any path that it and all executors know is fine.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

NAME, MANIFEST, SPLIT, BATCH = "millrace_shards", "_manifest.json", 16, 1 << 16  # batches of a split; rows of a batch
COMPARED = {EqualTo: pc.equal, EqualNullSafe: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
PUSH = "spark.sql.python.filterPushdown.enabled"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a plain path or an address; Hadoop's file:/x is a path too."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def ends(column: pa.ChunkedArray | pa.Array):
    """(least, greatest) of a column whose kind the manifest can hold, else nothing; doubles with NaN have none, as it compares as no value."""
    kind = column.type
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_temporal(kind)) or len(column) == column.null_count:
        return None
    if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
        return None
    x = pc.min_max(column)
    return base64.b64encode(_packed(pa.array([x["min"].as_py(), x["max"].as_py()], kind))).decode()


def _packed(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", values.type)])) as w:
        w.write_batch(pa.record_batch([values], ["x"]))
    return sink.getvalue().to_pybytes()


def _unpacked(text: str) -> pa.Array:
    return pa.ipc.open_stream(base64.b64decode(text)).read_next_batch().column(0)


@dataclass
class Split(InputPartition):
    file: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    batches: int = 0
    rows: int = 0
    ends: dict | None = None


def taken(f: Filter) -> bool:
    """Whether the reader applies a filter itself: comparisons of a top-level column with a value."""
    return isinstance(f, (*COMPARED, In, IsNull, IsNotNull, StringStartsWith)) and len(f.attribute) == 1


def holds(f: Filter, column: pa.Array) -> pa.Array:
    """Which rows hold a filter; null is no."""
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.and_(pc.is_in(column, pa.array(list(f.value), column.type)), pc.is_valid(column))
    if isinstance(f, StringStartsWith):
        return pc.fill_null(pc.starts_with(column, f.value), False)
    if f.value is None:
        return pc.is_null(column) if isinstance(f, EqualNullSafe) else pa.array([False] * len(column))
    value, mask = pa.scalar(f.value, column.type), COMPARED[type(f)]
    if pa.types.is_floating(column.type):  # NaN is the greatest value and equal to itself
        nan, own = pc.is_nan(column), f.value != f.value
        found = mask(pc.if_else(nan, float("inf"), column), float("inf") if own else value)
        if own:
            found = {EqualTo: nan, EqualNullSafe: nan, GreaterThan: pc.and_(nan, False), GreaterThanOrEqual: nan, LessThan: pc.invert(nan), LessThanOrEqual: pc.or_(nan, True)}[type(f)]
        else:
            found = pc.if_else(nan, isinstance(f, (GreaterThan, GreaterThanOrEqual)), found)
        return pc.fill_null(found, False)
    return pc.fill_null(mask(column, value), False)


def may_hold(f: Filter, known: str | None) -> bool:
    """Whether a file with these ends of the filter's column can have a row that holds it."""
    if known is None or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.value is None or f.value != f.value:
        return True
    low, high = _unpacked(known).to_pylist()
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    return high > f.value if isinstance(f, GreaterThan) else high >= f.value if isinstance(f, GreaterThanOrEqual) else low < f.value if isinstance(f, LessThan) else low <= f.value


class Reader(DataSourceReader):
    """Splits of SPLIT batches; files whose ends rule a pushed filter out are not read, rows that don't hold one not given."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if taken(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        out = []
        for f in manifest(self.path)["files"]:
            if all(may_hold(x, f["ends"].get(x.attribute[0])) for x in self.filters):
                out += [Split(f["file"], at, min(at + SPLIT, f["batches"])) for at in range(0, f["batches"], SPLIT)]
        return out or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.file:
            return
        fs, path = file_system(self.path)
        with fs.open_input_file(f"{path}/{split.file}") as f:
            reader = pa.ipc.open_file(f)
            for i in range(split.first, split.last):
                b = reader.get_batch(i).select(self.schema.names)
                for x in self.filters:
                    b = b.filter(holds(x, b.column(b.schema.get_field_index(x.attribute[0]))))
                if b.num_rows:
                    yield b


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows as a file of a new name, so that a task that runs twice overwrites nothing."""
        fs, path = file_system(self.path)
        name, n, rows, known, out = f"part-{uuid.uuid4().hex}.arrow", 0, 0, {}, None
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                if out is None:
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{name}")
                    out = pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(part)
                n, rows = n + 1, rows + part.num_rows
                for c in b.schema.names:
                    known.setdefault(c, []).append((len(part) - part[c].null_count, ends(part[c]), part[c].type))
        if out is None:
            return Written(None)
        out.close()
        sink.close()
        return Written(name, n, rows, {c: e for c, own in known.items() if (e := _together(own))})

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of this job in a new manifest, which takes the old one's place; files of an overwritten table go after that."""
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        before = manifest(self.path, missing=True)
        new = [{"file": m.file, "batches": m.batches, "rows": m.rows, "ends": m.ends} for m in messages if m and m.file]
        _put(fs, path, {"schema": self.schema.json(), "files": new if self.overwrite else [*before["files"], *new]})
        for f in before["files"] if self.overwrite else ():
            fs.delete_file(f"{path}/{f['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        """Removes the files of the tasks that ended; those of others are in no manifest."""
        fs, path = file_system(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{path}/{m.file}")


def _together(own: list) -> str | None:
    """The ends of batches put together; none where a batch with values has none."""
    if any(n and e is None for n, e, _ in own):
        return None
    values = [v for n, e, _ in own if n for v in _unpacked(e).to_pylist()]
    return ends(pa.array(values, own[0][2])) if values else None


def _put(fs: pafs.FileSystem, path: str, content: dict) -> None:
    temporary = f"{path}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(json.dumps(content).encode())
    fs.move(temporary, f"{path}/{MANIFEST}")


def manifest(path: str, missing: bool = False) -> dict:
    fs, own = file_system(path)
    if missing and fs.get_file_info(f"{own}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"files": []}
    with fs.open_input_stream(f"{own}/{MANIFEST}") as f:
        return json.loads(f.read())


class Shards(DataSource):
    """Option path. The schema is the manifest's; a table that isn't there yet takes the writer's."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(manifest(self.options["path"])["schema"]))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def write_shards(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes df, a file for each partition with rows. mode: append or overwrite."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(Shards)
    df.write.format(NAME).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A table of shards. The session lets Python sources take filters from then on, as Spark refuses readers that do where it is off."""
    ship(spark)
    spark.conf.set(PUSH, "true")
    spark.dataSource.register(Shards)
    return spark.read.format(NAME).load(path)

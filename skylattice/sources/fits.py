"""FITS binary tables as a data source: headers on the driver, ranges of rows in tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of rows of a task, and of a batch within it.
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
BLOCK = 2880
# FITS column codes, numpy types and SQL types (fixed values of the format).
CODES = {"L": ("S1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}


def _cards(data: bytes | _Blocks, at: int) -> tuple[dict[str, str], int]:
    out: dict[str, str] = {}
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("the file ends inside a header")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return out, at
            if card[8:10] == "= ":
                value = card[10:].split("/")[0] if "'" not in card[10:] else card[10:].split("'")[1]
                out[key] = value.strip()


class _Blocks:
    """The first blocks of a file, read as far as they are asked for."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def __getitem__(self, part: slice) -> bytes:
        return self.file.read_at(min(part.stop, self.size) - part.start, part.start) if part.start < self.size else b""

    def __len__(self) -> int:
        return self.size


def _table(data: bytes | _Blocks, extension: str | int) -> tuple[dict[str, str], int]:
    """Header and data offset of a table: by number (1: the first extension) or by name."""
    at, number = 0, 0
    while at < len(data):
        header, start = _cards(data, at)
        size = abs(int(header.get("BITPIX", 8))) // 8 if int(header.get("NAXIS", 0)) else 0
        for i in range(int(header.get("NAXIS", 0))):
            size *= int(header[f"NAXIS{i + 1}"])
        size += int(header.get("PCOUNT", 0))
        if number == extension or header.get("EXTNAME") == extension:
            return header, start
        at, number = start + -(-size // BLOCK) * BLOCK, number + 1
    raise KeyError(f"no table {extension!r}")


def _fields(header: dict[str, str]) -> list[tuple[str, str, int]]:
    out = []
    for i in range(int(header["TFIELDS"])):
        form = header[f"TFORM{i + 1}"]
        n = int("".join(c for c in form if c.isdigit()) or 1)
        code = next(c for c in form if c.isalpha())
        out.append((header.get(f"TTYPE{i + 1}", f"c{i + 1}"), code, n))
    return out


def _files(path: str) -> list[tuple[pafs.FileSystem, str]]:
    """A file, or the FITS files of a folder in the order of their names, in any store that Arrow opens."""
    store, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    if info.type == pafs.FileType.Directory:
        found = sorted(x.path for x in store.get_file_info(pafs.FileSelector(name)) if x.path.lower().endswith((".fits", ".fit")))
    else:
        found = [name] if info.type == pafs.FileType.File else []
    if not found:
        raise FileNotFoundError(path)
    return [(store, x) for x in found]


@dataclass
class Rows(InputPartition):
    """A range of rows of one file."""

    file: int
    first: int
    count: int


class FitsReader(DataSourceReader):
    """Reads ranges of rows; a task opens its file at its range and decodes the asked columns only."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        extension = options.get("extension", "1")
        self.extension: str | int = int(extension) if extension.isdigit() else extension
        self.columns = json.loads(options["columns"]) if "columns" in options else None
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def header(self, file: int = 0) -> tuple[dict[str, str], int]:
        store, name = _files(self.path)[file]
        with store.open_input_file(name) as handle:
            return _table(_Blocks(handle), self.extension)

    def fields(self) -> list[tuple[str, str, int]]:
        every = _fields(self.header()[0])
        fields = [f for f in every if self.columns is None or f[0] in self.columns]
        if self.columns is not None and len(fields) < len(self.columns):
            raise KeyError(f"no column {sorted(set(self.columns) - {f[0] for f in fields})}; there are {[f[0] for f in every]}")
        return fields

    def schema(self) -> str:
        kind = {name: CODES[code][1] if code == "A" or n == 1 else f"array<{CODES[code][1]}>" for name, code, n in self.fields()}
        return "row long, " + ", ".join(f"`{name}` {k}" for name, k in kind.items())

    def partitions(self) -> list[Rows]:
        out = []
        for file in range(len(_files(self.path))):
            header, _ = self.header(file)
            width, count = int(header["NAXIS1"]), int(header["NAXIS2"])
            step = max(1, self.task_bytes // max(1, width))
            out += [Rows(file, at, min(step, count - at)) for at in range(0, count, step)]
        return out or [Rows(0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, name = _files(self.path)[partition.file]
        fields = self.fields()
        with store.open_input_file(name) as handle:
            own, start = _table(_Blocks(handle), self.extension)
            width = int(own["NAXIS1"])
            layout = np.dtype([(c, f"S{n}") if code == "A" else (c, CODES[code][0], (n,)) if n > 1 else (c, CODES[code][0]) for c, code, n in _fields(own)])
            if layout.itemsize != width:
                raise ValueError("row length doesn't match the columns")
            step = max(1, BATCH_BYTES // max(1, width))
            for at in range(partition.first, partition.first + partition.count, step):
                n_rows = min(step, partition.first + partition.count - at)
                part = np.frombuffer(handle.read_at(n_rows * width, start + at * width), layout)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n_rows)), *[_column(part[c], code, n) for c, code, n in fields]], ["row", *[c for c, _, _ in fields]])


def _column(v: np.ndarray, code: str, n: int) -> pa.Array:
    if code == "A":
        return pa.array([x.decode("ascii", "replace").strip() for x in v.tolist()], pa.string())
    flat = np.ascontiguousarray(v).reshape(-1)
    flat = flat == b"T" if code == "L" else flat.astype(flat.dtype.newbyteorder("="))
    kind = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[CODES[code][1]]
    values = pa.array(flat).cast(kind)
    return values if n == 1 else pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * n, values)


class FitsSource(DataSource):
    """``spark.read.format("fits")`` with options ``extension`` (number or name), ``columns`` (a JSON list) and
    ``taskBytes``.  The driver reads header blocks only; tasks read ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return FitsReader(self.options).schema()

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(self.options)


def read_fits(spark: SparkSession, path: str, extension: str | int = 1, columns: list[str] | None = None, task_bytes: int | None = None) -> DataFrame:
    """``row`` (from 0 in each file) and the chosen columns, of a file or of a folder's files of one layout.

    A column of several numbers in a row is an array; text is trimmed.  Files may have any size: a task
    reads some tens of megabytes of rows, and the driver only headers.
    """
    spark.dataSource.register(FitsSource)
    reader = spark.read.format("fits").option("extension", str(extension))
    if columns is not None:
        reader = reader.option("columns", json.dumps(columns))
    if task_bytes is not None:
        reader = reader.option("taskBytes", str(task_bytes))
    FitsReader({"path": path, "extension": str(extension)} | ({} if columns is None else {"columns": json.dumps(columns)})).fields()  # errors by their own names
    return reader.load(path)


def read_map(spark: SparkSession, path: str, column: str = "FULL") -> DataFrame:
    """``pix, value`` of a map column, whether its rows hold one pixel or many."""
    df = read_fits(spark, path, 1, [column])
    if dict(df.dtypes)[column].startswith("array"):
        wide = df.select("row", F.size(column).alias("n"), F.posexplode(column).alias("i", "value"))
        return wide.select((F.col("row") * F.col("n") + F.col("i")).alias("pix"), F.col("value").cast("double").alias("value"))
    return df.select(F.col("row").alias("pix"), F.col(column).cast("double").alias("value"))


# Columns of the SZ cluster catalogue by type (fixed values: names of the published table in lower case,
# with their unit where there is one).
CLUSTER_COLUMNS = {
    "int": "index pipeline pipe_det validation psz pccs2 wise_flag".split(),
    "double": "glon_deg glat_deg ra_deg dec_deg pos_err_arcmin".split(),
    "float": "snr redshift y5r500 y5r500_err msz msz_err_up msz_err_low q_neural".split(),
    "boolean": ["ir_flag"],
    "string": "name redshift_id mcxc redmapper act spt comment".split(),
}


def read_cluster_catalogue(spark: SparkSession, path: str, extension: str | int = "PSZ2_UNION") -> DataFrame:
    """The SZ cluster catalogue with typed columns, trimmed strings, and ``z`` (null where unknown)."""
    return cluster_catalogue(read_fits(spark, path, extension))


def cluster_catalogue(table: DataFrame) -> DataFrame:
    """Typed columns of a cluster table with the published names in any case."""
    own = {c.lower(): c for c in table.columns}
    source = lambda name: name.removesuffix("_deg").removesuffix("_arcmin")
    missing = [n for names in CLUSTER_COLUMNS.values() for n in names if source(n) not in own]
    if missing:
        raise KeyError(f"no column {', '.join(map(source, missing))}; there are {', '.join(table.columns)}")
    typed = [(F.trim(F.col(own[source(n)]).cast("string")) if kind == "string" else F.col(own[source(n)]).cast(kind)).alias(n) for kind, names in CLUSTER_COLUMNS.items() for n in names]
    return table.select(*typed).withColumn("z", F.when((F.col("redshift") >= 0) & ~F.isnan("redshift"), F.col("redshift").cast("double")))

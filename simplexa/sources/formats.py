"""Readers and writers of the file formats.

``cs``: a NumPy structured array, or a folder of them; a Python data source of record batches
with row-range partitions, column pruning by ``columns`` and pushed comparisons, and a sink
with a two-phase commit.  ``matrix``: arrays of ``.npy`` and ``.npz``, read by ranges of rows.
Files are read and written by the executors, so their folder must be one that all of them see.
"""

from __future__ import annotations

import io
import pickle
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from simplexa.session import ship


def _spark_type(dt: np.dtype):
    if dt.subdtype:
        base, shape = dt.subdtype
        t = _spark_type(base)
        for _ in shape:
            t = ArrayType(t)
        return t
    if dt.kind in "SU":
        return StringType()
    if dt.kind == "f":
        return FloatType() if dt.itemsize == 4 else DoubleType()
    return IntegerType() if dt.kind in "iu" and dt.itemsize < 4 or dt == np.int32 else LongType()


def part_files(path: str) -> list[str]:
    """The file, or the part files of a folder in their order; row numbers count within a file."""
    import os

    path = path.removeprefix("file://").removeprefix("file:")
    if not os.path.isdir(path):
        return [path]
    found = sorted(f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-") and f.endswith(".cs"))
    if not found:
        raise FileNotFoundError(f"no part files in {path}")
    return found


class RowRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _ranges(path: str, n: int, rows: int) -> list[RowRange]:
    return [RowRange(path, a, min(a + rows, n)) for a in range(0, n, rows)] or [RowRange(path, 0, 0)]


def _arrow(values: np.ndarray, t) -> pa.Array:
    """A field of a structured array as Arrow: strided copies, no rows."""
    if isinstance(t, ArrayType):
        inner = _arrow(values.reshape(-1, *values.shape[2:]), t.elementType)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), inner)
    if isinstance(t, StringType):
        return pa.array(values.tolist(), pa.binary()).cast(pa.string()) if values.dtype.kind == "S" else pa.array(values.tolist(), pa.string())
    values = np.ascontiguousarray(values)
    if values.dtype == np.uint64:
        return pa.array(values.view(np.int64))  # the bit pattern
    return pa.array(values.astype({LongType: np.int64, IntegerType: np.int32, FloatType: np.float32, DoubleType: np.float64}[type(t)]))


#: filters that a scan answers itself, by the comparison they make
COMPARISONS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class CsReader(DataSourceReader):
    """Ranges of rows of a memory-mapped file as record batches, columns and simple comparisons on scalar fields applied before."""

    def __init__(self, path: str, schema: StructType, rows: int, batch: int = 8192):
        self.path, self.schema, self.rows, self.batch, self.filters = path, schema, rows, batch, []

    def pushFilters(self, filters):
        scalar = {f.name for f in self.schema.fields if not isinstance(f.dataType, ArrayType | StringType)}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in scalar and len(f.attribute) == 1 and (type(f) in COMPARISONS and f.value is not None or isinstance(f, In)):
                self.filters.append((name, "in" if isinstance(f, In) else type(f).__name__, [v for v in f.value if v is not None] if isinstance(f, In) else f.value))
            elif isinstance(f, IsNotNull) and name in scalar:
                continue  # a field of a file is never null
            else:
                yield f

    def partitions(self):
        return [r for f in part_files(self.path) for r in _ranges(f, len(np.load(f, mmap_mode="r")), self.rows)]

    def _kept(self, part: np.ndarray, first: int) -> np.ndarray:
        keep = np.ones(len(part), bool)
        for name, kind, value in self.filters:
            own = np.arange(first, first + len(part)) if name == "row_id" else np.asarray(part[name])
            own = own.view(np.int64) if own.dtype == np.uint64 and own.flags.c_contiguous else own.astype(np.int64) if own.dtype == np.uint64 else own
            keep &= np.isin(own, value) if kind == "in" else next(f for t, f in COMPARISONS.items() if t.__name__ == kind)(own, value)
        return keep

    def read(self, p: RowRange) -> Iterator[pa.RecordBatch]:
        whole = np.load(p.path, mmap_mode="r")
        for a in range(p.start, p.stop, self.batch):
            part = whole[a : min(a + self.batch, p.stop)]
            at = np.flatnonzero(self._kept(part, a)) if self.filters else np.arange(len(part))
            columns = [pa.array(a + at) if f.name == "row_id" else _arrow(part[f.name][at], f.dataType) for f in self.schema.fields]
            yield pa.RecordBatch.from_arrays(columns, self.schema.fieldNames())


class Staged(WriterCommitMessage):
    def __init__(self, files: list[str], folder: str):
        self.files, self.folder = files, folder


class CsWriter(DataSourceArrowWriter):
    """Files ``<path>/part-<n>.cs`` in the types of ``schema``; text as UTF-8, as wide as the file's longest.

    A task spools its batches, learning lengths and widths, then writes its file from them
    block by block, all under ``<path>/_staging-<job>``.  ``commit`` moves the files of the
    tasks that count into place; ``abort`` removes the folder.  Arrays of a field have one shape.
    """

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        import uuid

        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.job = uuid.uuid4().hex
        self.staging = f"{path}/_staging-{self.job}"

    def _field(self, name: str, t, column: pa.Array, seen: dict) -> None:
        shape = []
        while pa.types.is_list(column.type):
            lengths = pc.unique(pc.list_value_length(column)).to_pylist()
            if len(lengths) > 1 or None in lengths:
                raise ValueError(f"{name}: a field of a structured file has arrays of one length, not {lengths}")
            shape.append(lengths[0] if lengths else 0)
            column = column.flatten()
        if column.null_count:
            raise ValueError(f"{name}: a structured file holds no nulls")
        wide = (pc.max(pc.binary_length(column)).as_py() or 0) if pa.types.is_string(column.type) else 0
        before = seen.setdefault(name, [shape, 1])
        if before[0] != shape:
            raise ValueError(f"{name}: arrays of one length, not {before[0]} and {shape}")
        before[1] = max(before[1], wide)

    def _dtype(self, seen: dict) -> np.dtype:
        out = []
        for f in self.schema.fields:
            t = f.dataType
            while isinstance(t, ArrayType):
                t = t.elementType
            shape, wide = seen[f.name]
            base = "f4" if isinstance(t, FloatType) else "f8" if isinstance(t, DoubleType) else f"S{wide}" if isinstance(t, StringType) else "u8" if f.name == "uid" else "i8" if isinstance(t, LongType) else "i4"
            out.append((f.name, base, tuple(shape)) if shape else (f.name, base))
        return np.dtype(out)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.staging}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        os.makedirs(self.staging, exist_ok=True)
        spool, n, seen, sink = f"{name}.arrow", 0, {}, None
        for b in iterator:
            if not b.num_rows:
                continue
            for f, column in zip(self.schema.fields, b.columns, strict=True):
                self._field(f.name, f.dataType, column, seen)
            sink = sink or pa.ipc.new_file(spool, b.schema)
            sink.write_batch(b)
            n += b.num_rows
        if sink is None:
            return Staged([], self.staging)
        sink.close()
        dt = self._dtype(seen)
        with open(f"{name}.cs", "wb") as out, pa.memory_map(spool) as source:
            np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dt), "fortran_order": False, "shape": (n,)})
            held = pa.ipc.open_file(source)
            for i in range(held.num_record_batches):
                b = held.get_batch(i)
                block = np.zeros(b.num_rows, dt)
                for (field, column) in zip(dt.names, b.columns, strict=True):
                    while pa.types.is_list(column.type):
                        column = column.flatten()
                    base = dt[field].base
                    values = np.array(column.cast(pa.binary()).to_pylist(), base) if base.kind == "S" else column.to_numpy(zero_copy_only=False)
                    block[field] = (values.view(np.uint64) if base == np.uint64 else values).reshape(b.num_rows, *dt[field].shape)
                out.write(block.tobytes())
        os.remove(spool)
        return Staged([f"{name}.cs"], self.staging)

    def commit(self, messages) -> None:
        import os
        import shutil

        files = [f for m in messages if m for f in m.files]
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in os.listdir(self.path):
                if old.startswith("part-") and old.endswith(".cs"):
                    os.remove(f"{self.path}/{old}")
        for f in files:
            part = os.path.basename(f).rsplit("-", 1)[0]
            os.replace(f, f"{self.path}/{part}.cs" if self.overwrite else f"{self.path}/{part}-{self.job}.cs")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


class CsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cs"

    def schema(self) -> StructType:
        dt = np.load(part_files(self.options["path"])[0], mmap_mode="r").dtype
        names = [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()] or list(dt.names)
        fields = [StructField(n, LongType() if n == "row_id" else _spark_type(dt[n])) for n in names if n != "row_id"]
        return StructType([StructField("row_id", LongType()), *fields] if "row_id" in names or self.options.get("rowid") == "true" else fields)

    def reader(self, schema: StructType) -> CsReader:
        return CsReader(self.options["path"], schema, int(self.options.get("rows", "65536")))

    def writer(self, schema: StructType, overwrite: bool) -> CsWriter:
        return CsWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CsSource)
    spark.dataSource.register(MatrixSource)


def write_cs(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One file a partition, in the order of the partition (K1)."""
    register(df.sparkSession)
    df.write.format("cs").option("path", path).mode("overwrite" if overwrite else "append").save()


def read_cs(spark: SparkSession, path: str, columns: list[str] | None = None, row_id: bool = False) -> DataFrame:
    register(spark)
    r = spark.read.format("cs").option("path", path).option("rowid", str(row_id).lower())
    return (r.option("columns", ",".join(columns)) if columns else r).load()


def uids(spark: SparkSession, path: str) -> DataFrame:
    """uid only, an error if there is none (S3)."""
    return read_cs(spark, path, ["uid"])


class Member:
    """Where the values of an array lie: a file, or a stored or compressed member of an archive."""

    def __init__(self, path: str, key: str | None):
        self.path, self.member, self.start = path, None, 0
        if key is None:
            with open(path, "rb") as f:
                self.shape, fortran, self.dtype = _npy_header(f)
                self.start = f.tell()
        else:
            with zipfile.ZipFile(path) as z:
                info = z.getinfo(f"{key}.npy")
                with z.open(info) as f:
                    self.shape, fortran, self.dtype = _npy_header(f)
                    inside = f.tell()
                if info.compress_type == zipfile.ZIP_STORED:
                    with open(path, "rb") as f:
                        f.seek(info.header_offset + 26)
                        self.start = info.header_offset + 30 + sum(struct.unpack("<2H", f.read(4))) + inside
                else:
                    self.member, self.start = info.filename, inside
        if fortran and len(self.shape) > 1 or self.dtype.hasobject:
            raise ValueError("a matrix in C order without Python objects is needed")
        self.width = int(np.prod(self.shape[1:], dtype=np.int64))
        self.bytes = self.width * self.dtype.itemsize

    def blocks(self, start: int, stop: int, rows: int) -> Iterator[np.ndarray]:
        """Rows by seeking; a compressed member is read through up to ``start``."""
        with zipfile.ZipFile(self.path).open(self.member) if self.member else open(self.path, "rb") as f:
            at, skip = self.start + start * self.bytes, 1 << 20
            if self.member:
                while at > 0:
                    at -= len(f.read(min(at, skip)))
            else:
                f.seek(at)
            for a in range(start, stop, rows):
                n = min(rows, stop - a)
                yield np.frombuffer(f.read(n * self.bytes), self.dtype).reshape(n, self.width)


def _npy_header(f) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, key: str | None, rows: int):
        self.path, self.key, self.rows = path, key, rows

    def partitions(self):
        m = Member(self.path, self.key)
        n = m.shape[0] if m.shape else 0
        return _ranges(self.path, n, n or 1) if m.member else _ranges(self.path, n, self.rows)

    def read(self, p: RowRange) -> Iterator[pa.RecordBatch]:
        m, at = Member(p.path, self.key), p.start
        for x in m.blocks(p.start, p.stop, 8192):
            values = pa.array(np.ascontiguousarray(x, np.float64).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x))), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.width), values)], ["row_id", "v"])
            at += len(x)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row_id long, v array<double>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], self.options.get("key"), int(self.options.get("rows", "65536")))


def read_matrix(spark: SparkSession, path: str, name: str = "z", key: str | None = None) -> DataFrame:
    """A ``.npy`` or, with ``key``, ``.npz`` matrix as row_id, vector (S11, S12); one-dimensional ones are widened.

    Executors read ranges of rows by their place in the file; only its header is read on the driver.
    """
    register(spark)
    r = spark.read.format("matrix").option("path", path)
    return (r.option("key", key) if key else r).load().withColumnRenamed("v", name)


class _Arrays(pickle.Unpickler):
    """Admits arrays and nothing else."""

    def find_class(self, module: str, name: str):
        if (module.removeprefix("numpy.").removeprefix("_core.").removeprefix("core."), name) in {("multiarray", "_reconstruct"), ("multiarray", "scalar"), ("numeric", "_frombuffer"), ("numpy", "ndarray"), ("numpy", "dtype")} or module == "_codecs" and name == "encode":
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not an array")


def read_pickle(spark: SparkSession, path: str, name: str = "z") -> DataFrame:
    """Pickled matrices (one file or a pattern) as path, row_id, vector (S5); a file is read by one task, several by several."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.asarray(_Arrays(io.BytesIO(content)).load(), np.float64)
                x = x[:, None] if x.ndim == 1 else x
                for a in range(0, len(x), 8192):
                    part = x[a : a + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["path", "row_id", name])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, row_id long, {name} array<double>")


def component_latent(df: DataFrame, modes: int = 3) -> DataFrame:
    """Scalar component fields as one vector."""
    return df.select("uid", F.array(*[F.col(f"`components_mode_{m}/value`").cast("double") for m in range(modes)]).alias("z"))


def parse_mrc(content: bytes) -> tuple[np.ndarray, float]:
    """A volume and its voxel size (S14); modes 0, 1, 2 and 6."""
    nx, ny, nz, mode = struct.unpack("<4i", content[:16])
    mx = struct.unpack("<i", content[28:32])[0]
    cell = struct.unpack("<f", content[40:44])[0]
    ext = struct.unpack("<i", content[92:96])[0]
    kinds = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2"}
    if mode not in kinds:
        raise ValueError(f"volume mode {mode}")
    v = np.frombuffer(content, kinds[mode], nx * ny * nz, 1024 + ext).reshape(nz, ny, nx)
    return v.astype(np.float32), cell / mx if mx else 1.0


def mrc_bytes(volume: np.ndarray, voxel: float = 1.0) -> bytes:
    """A mode-2 volume file (K8)."""
    v = np.ascontiguousarray(volume, "<f4")
    nz, ny, nx = v.shape
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, nx, ny, nz, 2)
    struct.pack_into("<3i3f3f", head, 28, nx, ny, nz, nx * voxel, ny * voxel, nz * voxel, 90.0, 90.0, 90.0)
    struct.pack_into("<3i3f", head, 64, 1, 2, 3, float(v.min()), float(v.max()), float(v.mean()))
    head[208:212], head[212:216] = b"MAP ", bytes([0x44, 0x44, 0, 0])
    return bytes(head) + v.tobytes()


def read_mrc(spark: SparkSession, path: str) -> DataFrame:
    """Volumes as map, z, y, x, v (S14); a file is parsed in one task, a slice a batch."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                v, _ = parse_mrc(bytes(c))
                for z in range(v.shape[0]):
                    y, x = np.indices(v.shape[1:])
                    yield pd.DataFrame({"map": p.rsplit("/", 1)[-1], "z": z, "y": y.ravel(), "x": x.ravel(), "v": v[z].ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "map string, z int, y int, x int, v double")


def training_log(lines: DataFrame) -> DataFrame:
    """epoch, generation loss, divergence, total loss from log lines."""
    n = r"([-+0-9.eE]+)"
    pattern = rf"[Ee]poch:?\s*(\d+)\s+Average gen loss\s*=\s*{n},\s*KLD\s*=\s*{n},\s*total loss\s*=\s*{n}"
    g = lambda i: F.regexp_extract("value", pattern, i)
    t = lines.select(g(1).alias("epoch"), g(2).alias("gen_loss"), g(3).alias("kld"), g(4).alias("total_loss")).where("epoch <> ''")
    return t.select(F.col("epoch").cast("int"), *[F.col(c).cast("double") for c in ("gen_loss", "kld", "total_loss")])


def epoch_files(names: DataFrame, keep: int = 12) -> DataFrame:
    """Latent files by epoch, at most ``keep`` evenly spaced, the last always among them."""
    from pyspark.sql import Window

    t = names.select("name", F.regexp_extract("name", r"z\.(\d+)\.pkl$", 1).alias("e")).where("e <> ''").select("name", F.col("e").cast("int").alias("epoch"))
    w = Window.orderBy("epoch")  # a file a training epoch
    t = t.withColumn("i", F.row_number().over(w) - 1).crossJoin(t.agg((F.count("*") - 1).alias("last")))
    pick = F.exists(F.sequence(F.lit(0), F.lit(keep - 1)), lambda j: F.rint(j * F.col("last") / (keep - 1)) == F.col("i"))
    return t.where((F.col("last") < keep) | pick | (F.col("i") == F.col("last"))).select("name", "epoch")


def class_index(spark: SparkSession, path: str) -> DataFrame:
    """uid, class, weight."""
    t = spark.read.schema("uid decimal(20,0), class string, weight double").option("header", True).csv(path)
    from simplexa.functions import simplex as sx

    return t.select(sx.bit_pattern(F.col("uid")).alias("uid"), "class", "weight")


def named_indices(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated index and name."""
    return spark.read.schema("index int, name string").option("sep", "\t").csv(path)


def labels_or_default(labels: list[str], n: int) -> list[str]:
    """Given labels if their number fits, else C0, C1, ...."""
    return labels if len(labels) == n else [f"C{i}" for i in range(n)]


def corrected_kinds(columns: list[str]) -> list[str]:
    """Matrix kinds of a summary, by the prefix of its columns."""
    return [c.removeprefix("corrected_") for c in columns if c.startswith("corrected_")]


def first_metadata(df: DataFrame, *fields: str) -> dict:
    """Fields of the first row."""
    return df.select(*[F.col(f"`{f}`") for f in fields]).limit(1).first().asDict()


def references(**tables: DataFrame | None) -> DataFrame | None:
    """All given labellings (uid, label) under their names."""
    parts = [t.select("uid", F.col("label").cast("int").alias("label"), F.lit(n).alias("ref")) for n, t in tables.items() if t is not None]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def npz_bytes(**arrays: np.ndarray) -> bytes:
    """Named arrays of class-sized results (K7)."""
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()

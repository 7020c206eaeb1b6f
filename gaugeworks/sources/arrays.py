"""Array folders as a Spark data source: .npy files are cut into ranges of rows, each a task's, so that one large file is read by many tasks.

A file's header tells its shape and type, and where a row begins; a task reads its own bytes alone. Files are opened by pyarrow's file systems (local, hdfs, s3, gs, abfs) on the executors.
Files in column order have no rows to cut by, and are one task each. Arrays of Python objects are refused, as reading them would run what they hold.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gaugeworks import session

PARTS = "member string, kind string, fold string, row long, num array<double>, cat array<string>"
#: Stores that tasks can open by themselves.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


@dataclass
class Rows(InputPartition):
    """Rows start to stop of a file whose data begin at `offset`."""

    path: str
    offset: int
    kind: str
    shape: tuple
    columns_first: bool
    start: int
    stop: int


def _store(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path.replace("s3a://", "s3://", 1))


def _header(f) -> tuple[int, str, tuple, bool]:
    """Where data begin, their type, shape, and whether columns come first."""
    import numpy as np

    head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if kind.hasobject:
        raise ValueError("an array of Python objects")
    return head.tell(), kind.str, shape, columns_first


def values(a, kind: str) -> tuple[list, list]:
    """A file's rows as numbers and as text, either null where the part has none: C is text alone, N numbers alone, y both, whole numbers without a point."""
    a = a.reshape(len(a), -1)
    text = [[str(x) for x in row] for row in a.tolist()] if kind != "N" else [None] * len(a)
    if kind == "y":
        text = [[t.removesuffix(".0") for t in row] for row in text]
    try:
        num = a.astype(float).tolist() if kind != "C" else [None] * len(a)
    except ValueError:  # labels that are no numbers
        num = [None] * len(a)
    return num, text


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.rows = options["path"], int(options.get("rows", 1 << 16))

    def partitions(self) -> list[Rows]:
        from pyarrow import fs

        store, top = _store(self.root)
        out = []
        for x in sorted(store.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda x: x.path):
            if not x.is_file or not x.path.endswith(".npy"):
                continue
            with store.open_input_file(x.path) as f:
                offset, kind, shape, columns_first = _header(f)
            n = shape[0] if shape else 0
            step = n if columns_first and len(shape) > 1 else self.rows
            out += [Rows(x.path, offset, kind, shape, columns_first, a, min(n, a + step)) for a in range(0, n, max(1, step))]
        return out or [Rows("", 0, "<f8", (0,), False, 0, 0)]

    def read(self, p: Rows) -> Iterator[tuple]:
        import numpy as np

        if not p.path:
            return
        store, _ = _store(self.root)
        kind, wide = np.dtype(p.kind), int(np.prod(p.shape[1:], dtype=np.int64))
        with store.open_input_file(p.path) as f:
            f.seek(p.offset + p.start * wide * kind.itemsize)
            data = f.read((p.stop - p.start) * wide * kind.itemsize)
        whole = p.columns_first and len(p.shape) > 1
        a = np.frombuffer(data, kind).reshape(p.shape if whole else (p.stop - p.start, *p.shape[1:]), order="F" if whole else "C")
        part, _, fold = PurePosixPath(p.path).stem.partition("_")
        member = PurePosixPath(p.path).parent.name
        for at in range(0, len(a), 4096):
            num, text = values(a[at : at + 4096], part)
            yield from ((member, part, fold, p.start + at + k, x, t) for k, (x, t) in enumerate(zip(num, text, strict=True)))


class ArrayFolders(DataSource):
    """spark.read.format("array_folders").option("rows", n).load(root): PARTS of every .npy file below root, n rows a task."""

    @classmethod
    def name(cls) -> str:
        return "array_folders"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, root: str, rows: int = 1 << 16):
    session.ship(spark)
    spark.dataSource.register(ArrayFolders)
    return spark.read.format("array_folders").option("rows", rows).load(root)

"""Data sources that Spark does not have: NPY matrices and XLSX sheets, over the Python DataSource API."""

from __future__ import annotations

import re
import warnings
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class NpySource(DataSource):
    """``row_idx``, ``embedding`` of a two-dimensional .npy file; option ``rows`` per partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_idx bigint, embedding array<float>"

    def reader(self, schema):
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.rows = int(options.get("rows", 50_000))

    def partitions(self):
        import numpy as np

        m = np.load(self.path, mmap_mode="r", allow_pickle=False)
        if m.ndim != 2:
            raise ValueError("the matrix must have two dimensions")
        return [_Rows(i, min(i + self.rows, len(m))) for i in range(0, len(m), self.rows)] or [_Rows(0, 0)]

    def read(self, partition):
        import numpy as np

        m = np.load(self.path, mmap_mode="r", allow_pickle=False)
        for i in range(partition.lo, partition.hi):
            yield i, m[i].astype(np.float32).tolist()


class XlsxSource(DataSource):
    """Sheet of a workbook with a header row, all texts; option ``sheet`` (number from 1)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        head = next(iter(_cells(self.options["path"], int(self.options.get("sheet", 1)))), [])
        return ", ".join(f"`{(h or f'column_{i}').replace('`', '')}` string" for i, h in enumerate(head)) + (", " if head else "") + "seq bigint"

    def reader(self, schema):
        return _XlsxReader(self.options, len(schema.fields) - 1)


class _XlsxReader(DataSourceReader):
    def __init__(self, options, width: int):
        self.path, self.sheet, self.width = options["path"], int(options.get("sheet", 1)), width

    def read(self, partition):
        rows = _cells(self.path, self.sheet)
        next(rows, None)
        for n, row in enumerate(rows):
            yield (*(row + [None] * self.width)[: self.width], n)


def _cells(path: str, sheet: int):
    """Rows of cell texts, streamed."""
    with zipfile.ZipFile(path.removeprefix("file://")) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ET.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag == f"{_MAIN}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                    item.clear()
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for _, row in ET.iterparse(book.open(names[sheet - 1])):
            if row.tag != f"{_MAIN}row":
                continue
            out: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", "")).group():
                    at = at * 26 + ord(letter) - 64
                while len(out) < (at or len(out) + 1):
                    out.append(None)
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "s" and value is not None:
                    out[-1] = shared[int(value.text)]
                elif cell.get("t") == "inlineStr":
                    out[-1] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None:
                    out[-1] = value.text
            row.clear()
            yield out


def with_vectors(texts: DataFrame, vectors: DataFrame, index: str = "row_idx") -> DataFrame:
    """Texts and the vectors of their row numbers; unequal row counts only warn, as surplus rows find no partner."""
    a, b = texts.count(), vectors.count()
    if a != b:
        warnings.warn(f"{a} texts but {b} vectors", stacklevel=2)
    return texts.join(vectors, index)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("npy")`` and ``("xlsx")`` known."""
    from shirabe.session import ship

    ship(spark)
    spark.dataSource.register(NpySource)
    spark.dataSource.register(XlsxSource)

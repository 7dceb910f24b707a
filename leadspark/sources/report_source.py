"""A Python data source for ad-report exports: one partition for each file.

The files of a folder differ in their headings, their order and their extra columns. The
source gives all of them the same columns (``HEADINGS``), as text, beside level, account and file
name, which come from the name of the file. Filters on these three are pushed into the planning
of partitions: files that cannot match are never opened. File contents are read in tasks only,
in batches.

    spark.dataSource.register(ReportSource)
    spark.read.format("ad_reports").load(folder).filter("kind = 'adset'")
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .reports import HEADINGS, normalise_report

#: Columns that come from the name of a file; filters on them choose files.
OF_FILE = ("kind", "_account_name", "_source_file")
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ACCOUNT = re.compile("^[^-]*(?:-[^-]+)*---(.+?)(?:-Campanhas-|-Conjuntos-|-Anúncios-|---|$)")


def kind_of(file_name: str) -> str | None:
    """``campaign``, ``adset`` or ``ad`` (composed Unicode, any case)."""
    plain = unicodedata.normalize("NFC", file_name).replace("ú", "u").lower()
    if "anuncios" in plain:
        return "adset" if "conjuntos" in plain else "ad"
    return "campaign" if "campanhas" in plain and "conjuntos" not in plain else None


def account_of(file_name: str) -> str:
    found = _ACCOUNT.search(unicodedata.normalize("NFC", file_name))
    return found[1].replace("-", " ") if found and found[1] else "Unknown"


@dataclass
class ReportFile(InputPartition):
    path: str
    kind: str
    account: str
    name: str


class ReportReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and IN on columns of the file are taken; the rest stays with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in OF_FILE:
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[ReportFile]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            kind = kind_of(info.base_name)
            if info.type != fs.FileType.File or info.extension.lower() != "csv" or info.size == 0 or kind is None:
                continue
            account = account_of(info.base_name)
            values = dict(zip(OF_FILE, (kind, account, info.base_name), strict=True))
            if all(values[c] in allowed for c, allowed in self.wanted.items()):
                out.append(ReportFile(info.path, kind, account, info.base_name))
        # a scan has one partition at least
        return sorted(out, key=lambda f: f.path) or [ReportFile("", "", "", "")]

    def read(self, partition: ReportFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv, fs

        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), None)
        with system.open_input_stream(partition.path) as head:
            names = csv.open_csv(head, parse_options=csv.ParseOptions(newlines_in_values=True)).schema.names
        text = csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])
        with system.open_input_stream(partition.path) as stream:
            for batch in csv.open_csv(stream, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=text):
                yield self._common(batch, names, partition)

    def _common(self, batch: pa.RecordBatch, names: list[str], file: ReportFile) -> pa.RecordBatch:
        """The batch under the common headings: of several that mean the same the first with a value."""
        of_file = dict(zip(OF_FILE, (file.kind, file.account, file.name), strict=True))
        columns = []
        for field in self.schema.fields:
            if field.name in of_file:
                columns.append(pa.array([of_file[field.name]] * batch.num_rows, pa.string()))
                continue
            present = [batch.column(names.index(h)) for h in (*HEADINGS[field.name], field.name) if h in names]
            column = present[0] if present else pa.nulls(batch.num_rows, pa.string())
            for other in present[1:]:
                column = pa.compute.coalesce(column, other)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class ReportSource(DataSource):
    """``spark.read.format("ad_reports").load(path)``; option ``path`` is a folder, searched in depth."""

    @classmethod
    def name(cls) -> str:
        return "ad_reports"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in (*OF_FILE, *HEADINGS)])

    def reader(self, schema: T.StructType) -> ReportReader:
        return ReportReader(self.options["path"], schema)


def read_reports(spark: SparkSession, path: str, kind: str, accounts: list[str] | None = None) -> DataFrame:
    """The normalised rows of all files of one level (and of some accounts) under a folder.

    Levels without a file give no rows. Files are chosen by name before any is opened.
    """
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(ReportSource)
    raw = spark.read.format("ad_reports").load(path).filter(f"kind = '{kind}'")
    if accounts:
        raw = raw.filter(raw["_account_name"].isin(accounts))
    return normalise_report(raw, kind)

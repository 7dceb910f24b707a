"""Multi-file tables with provenance, table selection and consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FORMATS = {"csv": {"header": "true", "multiLine": "true", "escape": '"'}, "json": {}, "parquet": {}}


def format_of(path: str) -> str:
    """File format by extension; anything unknown is read as CSV."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return ending if ending in FORMATS else "csv"


def decoded(c: Column) -> Column:
    """File metadata text with its percent escapes undone."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def list_files(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``path, file_name`` of the files under a folder; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{fmt}")
    return reader.load(path).select("path", F.substring_index("path", "/", -1).alias("file_name"))


def _csv_groups(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files with equal headings together; a CSV read takes the headings of one file only."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(spark.read.options(**FORMATS["csv"]).csv(path).columns), []).append(path)
    return list(groups.values())


def read_table(spark: SparkSession, paths: str | list[str], fmt: str | None = None, schema: T.StructType | str | None = None, provenance: bool = True) -> DataFrame:
    """Read files of one format; text stays text unless ``schema`` says otherwise.

    A list of CSV files may have differing headings; columns a file lacks are null in its
    rows. Adds ``arquivo_origem`` (file) and ``aba_origem`` (its folder). An empty list or
    a missing file is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files given")
    fmt = fmt or format_of(paths[0])
    reader = spark.read.format(fmt).options(**FORMATS[fmt])
    reader = reader.schema(schema) if schema is not None else reader
    mixed = fmt == "csv" and schema is None and len(paths) > 1
    frames = [reader.load(group) for group in (_csv_groups(spark, paths) if mixed else [paths])]
    if provenance:
        folder = F.element_at(F.split(decoded(F.col("_metadata.file_path")), "/"), -2)
        name = decoded(F.col("_metadata.file_name"))
        frames = [f.select("*", name.alias("arquivo_origem"), folder.alias("aba_origem")) for f in frames]
    return union_all(frames)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Outer-column union; a column unknown to a frame is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_report(
    df: DataFrame, keep_terms: list[str], remove_terms: list[str], min_rows: int, vendor_terms: list[str] = (),
    launch: str = "LF", launch_kept: str = "LF06", file: str = "arquivo_origem", sheet: str = "aba_origem",
) -> DataFrame:
    """Row count and keep/drop decision per (file, sheet).

    Kept: no *remove* term in the sheet name, not a vendor sheet of a launch file (except
    one launch), and a *keep* term or enough rows.
    """
    name, source = F.lower(F.col(sheet)), F.col(file)
    has = lambda c, terms: reduce(lambda a, b: a | b, [c.contains(t.lower()) for t in terms], F.lit(False))
    vendor = has(name, vendor_terms) & source.contains(launch) & ~source.contains(launch_kept)
    counts = df.groupBy(file, sheet).agg(F.count("*").alias("rows"))
    kept = (F.col("rows") > 0) & ~has(name, remove_terms) & ~vendor & (has(name, keep_terms) | (F.col("rows") >= min_rows))
    return counts.withColumn("kept", kept)


def select_tables(df: DataFrame, report: DataFrame, file: str = "arquivo_origem", sheet: str = "aba_origem") -> DataFrame:
    return df.join(report.filter("kept").select(file, sheet), [file, sheet], "left_semi")


def consolidate(tables: dict[tuple[str, str], DataFrame], survey_terms: list[str], sales_terms: list[str]) -> dict[str, DataFrame]:
    """Stack sheets into ``survey`` and ``sales`` by keyword (survey wins), with provenance."""
    routed: dict[str, list[DataFrame]] = {"survey": [], "sales": []}
    for (file, sheet), df in tables.items():
        name = sheet.lower()
        kind = next((k for k, terms in (("survey", survey_terms), ("sales", sales_terms)) if any(t.lower() in name for t in terms)), None)
        if kind:
            routed[kind].append(df.withColumn("arquivo_origem", F.lit(file)).withColumn("aba_origem", F.lit(sheet)))
    return {k: union_all(v) for k, v in routed.items() if v}


def training_files(names: list[str], only: tuple[str, ...] = ()) -> list[str]:
    """File order for training: ``[`` sorts as ``!``; with ``only``, names holding one of
    these words."""
    kept = [n for n in names if not only or any(w.lower() in n.lower() for w in only)]
    return sorted(kept, key=lambda n: n.lower().replace("[", "!"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def duplicate_report(df: DataFrame, file: str = "arquivo_origem", sheet: str = "aba_origem") -> DataFrame:
    """Rows before and after de-duplication per table."""
    before = df.groupBy(file, sheet).agg(F.count("*").alias("rows_before"))
    after = df.distinct().groupBy(file, sheet).agg(F.count("*").alias("rows_after"))
    return before.join(after, [file, sheet]).withColumn("removed", F.col("rows_before") - F.col("rows_after"))

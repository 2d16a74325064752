"""Sinks. All write directories of part files; a reader never sees half a result."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A report is collected to be formatted; more rows than this are refused.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, columns: list[str], by: list[str] | None = None) -> None:
    """CSV with a header and a fixed column order, NULL as empty text; one
    folder per value of the ``by`` columns."""
    writer = df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_flat_parquet(df: DataFrame, path: str) -> None:
    """Parquet of typed flat columns, zstd; nested columns are refused."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    if nested:
        raise ValueError(f"nested columns {nested}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _small(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report takes at most {REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file, written aside and renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, aside = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(aside, target)


def write_json_document(df: DataFrame, path: str, **summary: object) -> None:
    """Indented JSON document of a small result and its summary fields."""
    _write_text(df.sparkSession, path, json.dumps(summary | {"rows": _small(df)}, indent=2, default=str, ensure_ascii=False))


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table, NULL as blank."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in _small(df.select(*columns))], ""])


def write_markdown(df: DataFrame, path: str, columns: list[str]) -> None:
    _write_text(df.sparkSession, path, markdown_table(df, columns))


def write_tsv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    rows = _small(df.select(*columns))
    _write_text(df.sparkSession, path, "\n".join(["\t".join(columns), *["\t".join("" if r[c] is None else str(r[c]) for c in columns) for r in rows], ""]))


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, folder, whole) of the versions below a snapshot's folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [(f.getPath().getName(), str(f.getPath())) for f in fs.listStatus(root)]
    listed = [(int(n[2:]), p) for n, p in names if n.startswith("v-") and n[2:].isdigit()]
    return sorted((no, p, fs.exists(hadoop.Path(p + "/_SUCCESS"))) for no, p in listed)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version that was written as a whole; None if there is none."""
    whole = [p for _, p, done in _versions(spark, path) if done]
    return spark.read.parquet(whole[-1]) if whole else None


def swap_snapshot(df: DataFrame, path: str) -> None:
    """Replace a Parquet snapshot that ``df`` may itself read.

    Each version is a folder of its own, which counts once it is whole, so a
    crash at any moment leaves the version before. That one is kept for readers
    that hold it; older and broken ones are removed.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    last = versions[-1][0] if versions else 0
    df.write.parquet(f"{path}/v-{last + 1:09d}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [p for _, p, done in versions if done]
    for _, p, _ in versions:
        if p not in whole[-1:]:
            fs.delete(hadoop.Path(p), True)


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    """Snapshot of a result under the version of the schema it was made with."""
    swap_snapshot(df, f"{path}/schema-{version}")


def reuse_or_build(spark: SparkSession, path: str, version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The written result of this schema version, else ``build()``, written."""
    held = read_snapshot(spark, f"{path}/schema-{version}")
    if held is None:
        write_versioned(build(), path, version)
        held = read_snapshot(spark, f"{path}/schema-{version}")
    return held


def partition_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per partition of a written result."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))

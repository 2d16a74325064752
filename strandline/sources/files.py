"""Scans of irregular files: documents, tables, listings, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.documents import children


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, doc VARIANT, error): one row per file.

    A file that is no JSON is a row with a NULL document and its error; it
    never fails the scan.
    """
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    rows = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_text"))
    doc = F.try_parse_json("_text")
    return rows.select("path", doc.alias("doc"), F.when(doc.isNull(), F.concat(F.lit("not JSON: "), F.substring("_text", 1, 80))).alias("error"))


def csv_table(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column text; rows of the wrong shape are skipped
    (``csv_rejects`` lists them).

    Raises ``ValueError`` if a required column is missing.
    """
    rows = _csv_rows(spark, path, required)
    return rows.where(F.col("_broken").isNull() & _all_cells(rows)).drop("_broken")


def csv_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of the rows that ``csv_table`` skips."""
    rows = _csv_rows(spark, path)
    return rows.where(F.col("_broken").isNotNull() & _all_cells(rows)).select(F.col("_metadata.file_path").alias("path"), F.col("_broken").alias("line"))


def _all_cells(rows: DataFrame) -> Column:
    """Always true, but asks for every column: the reader judges a row by those it is asked for."""
    return F.length(F.concat_ws("", *[F.col(c) for c in rows.columns if c != "_broken"])) >= 0


def _csv_rows(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    head = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).limit(0)
    lacking = set(required or []) - set(head.columns)
    if lacking:
        raise ValueError(f"{path} lacks the columns {sorted(lacking)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*head.columns, "_broken"]])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("columnPruning", False)
    return reader.option("columnNameOfCorruptRecord", "_broken").csv(path)


def csv_without_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", False).schema(schema).csv(path)


def gaze_table(spark: SparkSession, path: str) -> DataFrame:
    """Gaze CSV under its contract: off-surface and un-castable rows are
    dropped, a missing or unreadable confidence is 1."""
    rows = csv_table(spark, path, ["world_timestamp", "x_norm", "y_norm"])
    for c in ("on_surf", "confidence"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    on = ~F.coalesce(F.lower(F.trim("on_surf")), F.lit("")).isin("0", "false", "no")
    cast = {c: F.trim(c).try_cast("double") for c in ("world_timestamp", "x_norm", "y_norm")}
    typed = rows.where(on).select(*[v.alias(k) for k, v in cast.items()], F.coalesce(F.trim("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"))
    return typed.where("world_timestamp IS NOT NULL AND x_norm IS NOT NULL AND y_norm IS NOT NULL")


def file_listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, name, stem, extension, bytes) of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    rows = reader.load(path).select("path", F.col("length").alias("bytes"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    listed = rows.select("path", name.alias("name"), "bytes")
    listed = listed.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", ""))
    return listed.where(F.col("extension").isin(*[e.lstrip(".").lower() for e in extensions])) if extensions else listed


def named_files(listing: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Files whose whole name matches ``pattern``; its groups become columns."""
    hit = listing.where(F.col("name").rlike(f"^(?:{pattern})$"))
    return hit.select("*", *[F.regexp_extract("name", f"^(?:{pattern})$", i + 1).alias(c) for i, c in enumerate(columns)])


def latest_export(listing: DataFrame, owner: Column, version: str = r"/(\d{3})/[^/]*$") -> DataFrame:
    """(owner, path): the file of the highest export number, then of the last name."""
    number = F.regexp_extract("path", version, 1)
    rows = listing.where(number != "").select(owner.alias("owner"), "path", F.struct(number.cast("int"), F.col("name")).alias("rank"))
    return rows.groupBy("owner").agg(F.max_by("path", "rank").alias("path"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def manifest(docs: DataFrame, doc: str = "doc", roots: tuple[str, ...] = ("records", "entries", "items", "data")) -> DataFrame:
    """(path, pos, record VARIANT) of documents that are a list, or an object
    that holds one under the first of ``roots`` it has."""
    listed = docs.select("path", F.coalesce(*[F.try_variant_get(doc, f"$.{r}", "variant") for r in roots], F.col(doc)).alias("list"))
    return children(listed, "list", "_key", "pos", "record").where("_key IS NULL").select("path", "pos", "record")


def transcript_words(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, segment, start, end, word, word_start, word_end) of transcripts
    whose segments list words under ``metadata:transcript``."""
    shape = "array<struct<start:double,end:double,transcript:string,words:array<struct<word:string,start:double,end:double>>>>"
    segments = F.try_variant_get(doc, '$["metadata:transcript"]', shape)
    each = docs.select("path", F.posexplode(segments).alias("segment", "s"))
    return each.select("path", "segment", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode_outer("s.words").alias("w")).select(
        "path", "segment", "start", "end", F.col("w.word").alias("word"), F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end")
    )


def voice_segments(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, pos, start, end) of voice activity written as objects or as pairs."""
    listed = docs.select("path", F.try_variant_get(doc, '$["metadata:vad"]', "variant").alias("_list"))
    rows = children(listed, "_list")
    pick = lambda name, i: F.coalesce(F.try_variant_get("value", f"$.{name}", "double"), F.try_variant_get("value", f"$[{i}]", "double"))
    return rows.select("path", "pos", pick("start", 0).alias("start"), pick("end", 1).alias("end")).where("start IS NOT NULL AND end IS NOT NULL")


def skeleton_tracks(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, person, frame, keypoints, occluded) of skeleton documents: a list
    of frames, each an object of persons."""
    listed = docs.select("path", F.try_variant_get(doc, "$.annotations.skeletons", "variant").alias("_list"))
    frames = children(listed, "_list", "_none", "frame", "persons").drop("_none")
    rows = children(frames, "persons", "person", "_at")
    return rows.select(
        "path", "person", "frame",
        F.try_variant_get("value", "$.keypoints", "array<double>").alias("keypoints"),
        F.try_variant_get("value", "$.occluded", "array<double>").alias("occluded"),
    )


def checked_parquet(spark: SparkSession, path: str, required: list[str], rows: int | None = None) -> DataFrame:
    """Parquet that has the columns, no nested type and, if given, so many rows."""
    df = spark.read.parquet(path)
    lacking = set(required) - set(df.columns)
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    if lacking or nested:
        raise ValueError(f"{path}: missing {sorted(lacking)}, nested {nested}")
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{path} has {found} rows, not {rows}")
    return df

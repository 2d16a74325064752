"""Nested annotation documents as flat rows, and request documents from rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.casts import created_wall_us, submitted_wide
from strandline.functions.documents import children, first_text


def response_rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, node_id, response_index, created, submitted, annotations) of
    documents whose ``nodes`` hold lists of ``responses``."""
    nodes = docs.select("path", F.try_variant_get(doc, "$.nodes", "variant").alias("nodes"))
    each = children(nodes, "nodes", "node_key", "node_pos", "node").withColumn("node_id", F.coalesce("node_key", F.col("node_pos").cast("string")))
    each = each.select("path", "node_id", F.try_variant_get("node", "$.responses", "variant").alias("responses"))
    rows = children(each, "responses", "_key", "_pos", "response")
    # a list, or an object whose keys are numbers
    rows = rows.select("path", "node_id", F.coalesce(F.col("_key").try_cast("int"), F.col("_pos")).alias("response_index"), "response")
    created = F.coalesce(F.try_variant_get("response", "$.created", "string"), F.try_variant_get("response", "$.annotations.created", "string"))
    return rows.select(
        "path", "node_id", "response_index", created.alias("created"),
        submitted_wide(F.try_variant_get("response", "$.submitted", "string")).alias("submitted"),
        F.try_variant_get("response", "$.annotations", "variant").alias("annotations"),
    )


def latest_submitted(responses: DataFrame) -> DataFrame:
    """The submitted response of each node that was created last (see
    ``casts.created_wall_us``), then of the highest index."""
    rank = F.struct(created_wall_us(F.col("created")), "response_index")
    best = responses.where("submitted").groupBy("path", "node_id").agg(F.max_by(F.struct("*"), rank).alias("_best"))
    return best.select("_best.*")


def annotation_rows(responses: DataFrame) -> DataFrame:
    """(path, node_id, annotation_key, participant, category, press VARIANT):
    one row per annotation with the last element of its last data list."""
    rows = children(responses.select("path", "node_id", "annotations"), "annotations", "_key", "_pos", "annotation")
    rows = rows.withColumn("annotation_key", F.coalesce("_key", F.col("_pos").cast("string")))
    lists = F.try_variant_get("annotation", "$.data", "array<array<variant>>")
    last = F.try_element_at(F.filter(lists, lambda x: F.size(x) > 0), F.lit(-1))
    press = F.try_variant_get(F.try_element_at(last, F.lit(-1)), "$.press_data", "variant")
    return rows.withColumn("press", press).select(
        "path", "node_id", "annotation_key",
        F.try_variant_get("annotation", "$.participant", "string").alias("participant"),
        F.try_variant_get("annotation", "$.category", "string").alias("category"),
        "press",
    )


def press_columns(annotations: DataFrame) -> DataFrame:
    """Typed columns of the press data."""
    texts = ("speaker_intention", "response", "video_path", "audio_path", "video_start_time", "video_end_time", "annotation_type")
    numbers = ("current_video_time", "time_annot")
    return annotations.select(
        "path", "node_id", "annotation_key", "participant", "category",
        *[first_text(F.col("press"), f"$.{c}").alias(c) for c in texts],
        *[F.try_variant_get("press", f"$.{c}", "double").alias(c) for c in numbers],
    )


def conform(df: DataFrame, schema: T.StructType, id_column: str | None = None) -> DataFrame:
    """Columns of ``schema`` in its order, cast without failing, NULL where missing."""
    have = set(df.columns)
    columns = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return df.select(*([F.col(id_column)] if id_column and id_column not in schema.names else []), *columns)


def floor_speakers(participant: Column, floor: Column) -> Column:
    """The participant and the distinct others in order; NULL if an id is not a positive number."""
    ids = F.array_distinct(F.concat(F.array(participant), floor))
    return F.when(~F.exists(ids, lambda x: x.isNull() | (x <= 0)), ids)


def request_json(key: Column, system: Column, user: Column, media: Column) -> Column:
    """One request line: key, optional system instruction, user text and media references."""
    parts = F.concat(
        F.array(F.struct(user.alias("text"), F.lit(None).cast("string").alias("uri"))),
        F.transform(media, lambda m: F.struct(F.lit(None).cast("string").alias("text"), m.alias("uri"))),
    )
    return F.to_json(F.struct(key.alias("key"), F.nullif(F.trim(system), F.lit("")).alias("system"), parts.alias("parts")))


def conversation(df: DataFrame, keys: list[str], turn: str, text: str, reply: Callable[[list[str], str], str | None], schema: str) -> DataFrame:
    """Turn by turn replies with the history of the turns before; a turn
    without reply is taken out of the history. ``reply(history, text)`` is
    called in order within a group; ``schema`` types keys, turn, text and
    ``reply``."""

    def talk(group: pd.DataFrame) -> pd.DataFrame:
        history: list[str] = []
        rows = []
        for row in group.sort_values(turn, kind="stable").to_dict("records"):
            said = reply(list(history), row[text])
            if said is not None:
                history += [row[text], said]
            rows.append({**{k: row[k] for k in keys}, turn: row[turn], text: row[text], "reply": said})
        return pd.DataFrame(rows)

    return df.select(*keys, turn, text).groupBy(*keys).applyInPandas(talk, schema)


def embed(df: DataFrame, text: str, out: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Add vectors of texts; the model is loaded once per Python worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model([t or "" for t in texts]))

    return df.withColumn(out, encode(F.col(text)))

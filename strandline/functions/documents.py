"""Irregular JSON documents (VARIANT) as rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import stage


def first_text(doc: Column, *paths: str) -> Column:
    """First of the paths that holds non-blank text, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(doc, p, "string")), F.lit("")) for p in paths])


def indexed(doc: Column, index: int | str) -> Column:
    """Member of a list or of an object whose keys are numbers."""
    listed = F.try_variant_get(doc, f"$[{int(index)}]", "variant") if str(index).isdigit() else F.lit(None).cast("variant")
    return F.coalesce(listed, F.try_variant_get(doc, f'$["{index}"]', "variant"))


def children(df: DataFrame, value: str, key: str = "key", pos: str = "pos", out: str = "value") -> DataFrame:
    """``df`` without ``value`` and with one row per member of that VARIANT: its
    key (NULL in a list), position and value. Scalars and NULLs have none."""
    rows = df.withColumnRenamed(value, "_parent")
    # only lists and objects are opened; the others would be an error
    kind = F.schema_of_variant("_parent")
    rows = rows.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    opened = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_parent").outer()))
    taken = [c for c in rows.columns if c != "_parent"]
    return opened.select(*[rows[c] for c in taken], F.col("key").alias(key), F.col("pos").alias(pos), F.col("value").alias(out))


def walk(df: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """(keys, path, key, value) of every node of a VARIANT, however deep.

    Level by level: each is written, so that the next is derived from it and
    not from the root, and the walk ends with the first level that is empty.
    Lists and objects alike, in order of position within a parent.
    """
    level = df.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.col(doc).alias("value"))
    out = level
    while True:
        named = children(level.withColumnRenamed("key", "_key"), "value", "_name", "_pos", "_value")
        path = F.concat("path", F.lit("."), F.coalesce("_name", F.col("_pos").cast("string")))
        below = named.select(*keys, path.alias("path"), F.col("_name").alias("key"), F.to_json("_value").alias("value"))
        below = stage(below, "walk").withColumn("value", F.parse_json("value"))
        if below.isEmpty():
            return out
        out, level = out.unionByName(below), below


def find_keys(df: DataFrame, doc: str, keys: list[str], pattern: str) -> DataFrame:
    """Nodes at any depth whose key matches ``pattern``."""
    return walk(df, doc, keys).where(F.col("key").rlike(pattern))


# Keys of dialogues, and file names of their clips.
DIALOGUE_KEY = r"^d\d+u\d+$"
CLIP_NAME = r"^(.+)_clip_?(\d+)$"


def dialogue_clips(df: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """(keys, dialogue, clip_index, text) of the clips of result documents.

    A dialogue is a list at any depth under a key like ``d1u2``, or, in any
    other list, the items whose file names share a prefix. An item's index is
    that of its file name if its prefix is the dialogue, else its position from
    1; of several items of one index the last with text holds.
    """
    nodes = walk(df, doc, keys)
    lists = nodes.where(F.schema_of_variant("value").startswith("ARRAY"))
    items = children(lists.withColumnRenamed("key", "parent"), "value", "_none", "pos", "item")
    file = F.try_variant_get("item", "$.file", "string")
    items = items.select(
        *keys, "path", "parent", "pos", first_text(F.col("item"), "$.assistant", "$.response", "$.response_text").alias("text"),
        F.nullif(F.regexp_extract(file, CLIP_NAME, 1), F.lit("")).alias("prefix"), F.nullif(F.regexp_extract(file, CLIP_NAME, 2), F.lit("")).try_cast("int").alias("number"),
    )
    is_dialogue = F.coalesce(F.col("parent").rlike(DIALOGUE_KEY), F.lit(False))
    named = items.withColumn("dialogue", F.when(is_dialogue, F.col("parent")).otherwise(F.col("prefix"))).where("dialogue IS NOT NULL AND text IS NOT NULL")
    index = F.when(F.col("prefix") == F.col("dialogue"), F.col("number")).otherwise(F.col("pos") + 1)
    return named.withColumn("clip_index", index).groupBy(*keys, "path", "dialogue", "clip_index").agg(F.max_by("text", "pos").alias("text")).drop("path")


def press_entries(df: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """(keys, path, press): every ``press_data`` object at any depth as a map,
    with the scalar members beside it, which win over its own."""
    nodes = walk(df, doc, keys).where(F.schema_of_variant("value").startswith("OBJECT"))
    press = F.try_variant_get("value", "$.press_data", "map<string,variant>")
    beside = F.map_filter(F.try_variant_get("value", "$", "map<string,variant>"), lambda k, v: (k != "press_data") & is_scalar(v))
    return nodes.where(press.isNotNull()).select(*keys, "path", merge_maps(press, beside).alias("press"))


def is_scalar(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.lit(True))


def merge_maps(left: Column, right: Column) -> Column:
    """Entries of both maps; the right one wins."""
    kept = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(right, F.map_filter(left, lambda k, v: F.lit(False))))


def pairs_of(values: Column) -> Column:
    """[a, b, c, d] -> [(a, b), (c, d)]; an odd number of values gives NULL."""
    half = F.floor(F.size(values) / 2).cast("int")
    steps = F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>"))
    built = F.transform(steps, lambda i: F.struct(F.get(values, i * 2).alias("a"), F.get(values, i * 2 + 1).alias("b")))
    return F.when(F.size(values) % 2 == 0, built)


def content_parts(content: Column) -> Column:
    """Message content as typed parts: a text alone is one text part; texts in
    a list are text parts, objects keep their type and text."""
    one = F.try_variant_get(content, "$", "string")
    many = F.try_variant_get(content, "$", "array<variant>")

    def part(item: Column) -> Column:
        text = F.try_variant_get(item, "$", "string")
        object_type = F.coalesce(F.try_variant_get(item, "$.type", "string"), F.lit("text"))
        own = F.try_variant_get(item, "$.text", "string")
        is_object = F.schema_of_variant(item).startswith("OBJECT")
        return F.struct(F.when(is_object, object_type).otherwise("text").alias("type"), F.when(is_object, own).otherwise(text).alias("text"))

    is_list = F.schema_of_variant(content).startswith("ARRAY")
    return F.when(is_list, F.transform(many, part)).when(content.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), one.alias("text"))))


def nested_least(values: Column) -> Column:
    """Least number of an array of arrays; NULL if there is none."""
    return F.array_min(F.flatten(F.filter(values, lambda x: x.isNotNull())))

"""Problem 9: combine sources so that each has its target share of all tokens.

The documents of a source, shuffled anew for every repetition, form one stream
that is cut into blocks of equally many tokens. A schedule of as many slots as
there are blocks to fill gives slot ``i`` to the source in whose part of the
cumulative target weights the point ``frac(i * golden ratio)`` falls: after any
number of slots every source is within a few slots of its share. The k-th slot
of a source takes the k-th block of its stream.

Ranks and running sums are taken in two levels (within chunks, then over
chunks), so no task orders a whole source.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import stage

#: Default of the parameter ``tokenizer``; only the driver reads the file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LARGEST = 64 << 20
#: Tokens of a block: a thousandth of the mix, within these bounds.
SHORTEST, BLOCK = 32, 4_096
SLOT_CHUNK = 1 << 14
#: Documents of a source that one ordering chunk of its stream has about.
SHUFFLE_CHUNK = 50_000
GOLDEN = 0.6180339887498949


def source_name(source: Column) -> Column:
    """Canonical spelling: lower case, underscores for blanks and hyphens."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(source)), r"[\s-]+", "_"), F.lit(""))


class TokenCounter:
    """Tokens of texts by the text of a tokenizer file (byte-level BPE).

    The tokenizer splits a text into words with the blank before them and never
    merges over such a border, so the count of a text is the sum of the counts
    of its stretches between blanks; each distinct stretch is counted once as
    long as it is held. Texts with two blanks in a row, or other tokenizers,
    are counted as a whole.
    """

    HELD = 1_000_000

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        state = json.loads(text)
        split = state.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", False) and not split.get("add_prefix_space") and not state.get("normalizer")
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.known) > self.HELD:
            self.known.clear()
        known, rows, new, odd = self.known, [], {}, []
        for i, text in enumerate(texts):
            if "  " in text:
                odd.append(i)
                rows.append(None)
                continue
            first, *rest = text.split(" ")
            # a stretch at the start has no blank before it
            row = [" " + w for w in rest]
            if first:
                row.append(first)
            new.update((w, None) for w in row if w not in known)
            rows.append(row)
        fresh = list(new)
        known.update(zip(fresh, self.whole(fresh), strict=True))
        out = [0 if row is None else sum(map(known.__getitem__, row)) for row in rows]
        for i, n in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out


def count_tokens(path: str = TOKENIZER):
    """Pandas UDF: tokens of each text (0 for null) by the tokenizer file at
    ``path``, which the driver reads and sends to the workers (at most LARGEST bytes)."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > LARGEST:
        raise ValueError(f"{path} is larger than a tokenizer file may be")
    sent = SparkSession.active().sparkContext.broadcast(text)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(sent.value)
        for texts in batches:
            out: list[int] = []
            for low in range(0, len(texts), 256):
                out += counter.count([t if isinstance(t, str) else "" for t in texts.iloc[low : low + 256]])
            yield pd.Series(out, dtype="int64")

    return tokens


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents that have any tokens and a source."""
    # counted behind a generator: a filter on the counts would otherwise count twice
    counts = F.explode(F.array(count_tokens(tokenizer)("text"))).alias("tokens")
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), counts)
    return rows.where("tokens > 0 AND source IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def plan_needs(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: share, cap, tokens at hand, tokens needed, its part
    of the cumulative weights, and repetitions needed.

    Without ``total`` the mix is the largest in which every source that has
    documents reaches its share within its cap. Sources without documents get
    nothing; the shares of the others keep their proportions.
    """
    # the target table states a handful of sources; each source has one row here
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("held"), F.count("*").alias("docs"))
    plan = wanted.join(held, "source", "left").na.fill({"held": 0, "docs": 0})
    live = (F.col("held") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(0))
    plan = plan.withColumn("weight", F.when(live, F.col("target_share")).otherwise(0.0))
    plan = plan.withColumn("weight", F.coalesce(F.try_divide("weight", F.sum("weight").over(every)), F.lit(0.0)))
    most = F.min(F.when(live, F.col("held") * F.col("max_repeats") / F.col("weight"))).over(every)
    plan = plan.withColumn("total", F.least(F.floor(most), F.lit(total)) if total is not None else F.floor(most))
    plan = plan.withColumn("block", F.greatest(F.lit(SHORTEST), F.least(F.lit(BLOCK), F.floor(F.col("total") / 1000))))
    plan = plan.withColumn("need", F.floor(F.col("weight") * F.col("total")))
    upper = F.sum("weight").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("weight"))
    # one block more than needed may be scheduled, but never beyond the cap
    return plan.withColumn("repeats", F.when(live, F.least(F.ceil((F.col("need") + F.col("block")) / F.col("held")), F.col("max_repeats"))).otherwise(0))


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, source, k): the source of every slot and its rank for that source."""
    spark = plan.sparkSession
    slots = int(plan.agg(F.max(F.floor(F.col("total") / F.col("block")))).first()[0] or 0)
    parts = plan.where("weight > 0").select("source", "lower", "upper")
    point = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0))
    # the few target sources as one array, so that each slot finds its own without a join
    edges = [(r["source"], r["lower"], r["upper"]) for r in parts.orderBy("upper").collect()]
    source = None
    for name, _, upper in edges:
        source = (source.when if source is not None else F.when)(F.col("point") < upper, name)
    source = F.lit(None).cast("string") if source is None else source.otherwise(edges[-1][0])
    rows = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("source", source)
    rows = rows.select("slot", "source", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    per_chunk = rows.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")
    per_chunk = per_chunk.select("source", "chunk", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot"))
    ranked = rows.withColumn("inside", inside).join(per_chunk, ["source", "chunk"])
    return ranked.select("slot", "source", (F.col("before") + F.col("inside") - 1).alias("k"))


def streams(sizes: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """(source, k, doc_id, repetition, tokens): documents of the k-th block of each source's stream."""
    chosen = sizes.join(plan.where("repeats > 0").select("source", "block", "repeats"), "source")
    again = chosen.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    mixed = again.withColumn("order", F.xxhash64("doc_id", "repetition", F.lit(seed)))
    bits = max(1, min(30, math.ceil(math.log2(max(2, sizes.count() / SHUFFLE_CHUNK)))))
    mixed = mixed.withColumn("chunk", F.shiftrightunsigned("order", 64 - bits).cast("int"))
    sums = mixed.groupBy("source", "repetition", "chunk").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("repetition", "chunk")) - F.col("n")
    sums = sums.select("source", "repetition", "chunk", before.alias("before"))
    inside = F.sum("tokens").over(
        Window.partitionBy("source", "repetition", "chunk").orderBy(F.shiftrightunsigned("order", 1), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = mixed.withColumn("inside", inside).join(sums, ["source", "repetition", "chunk"])
    middle = F.col("before") + F.col("inside") - F.col("tokens") / 2
    return placed.select("source", F.floor(middle / F.col("block")).alias("k"), "doc_id", "repetition", "tokens")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 1) -> DataFrame:
    """(slot, source, doc_id, repetition, tokens): the combined records in order of ``slot``.

    Documents without text, id or target source take no part; ids count once.
    No document comes more often than its source's ``max_repeats``.
    """
    sizes = stage(token_sizes(documents, tokenizer), "token-sizes")
    plan = stage(plan_needs(sizes, targets, total), "mix-plan")
    mixed = schedule(plan).join(streams(sizes, plan, seed), ["source", "k"])
    return mixed.select("slot", "source", "doc_id", F.col("repetition").cast("int").alias("repetition"), "tokens")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share, tokens, records, documents and most repetitions."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("times"))
    got = per_doc.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.sum("times").alias("records"), F.count("*").alias("documents"), F.max("times").alias("most_repeats")
    )
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    rows = wanted.join(got, "source", "left").na.fill(0, ["tokens", "records", "documents", "most_repeats"])
    share = F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    return rows.withColumn("reached_share", F.round(share, 6))

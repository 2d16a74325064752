"""Sequence-similarity queries: progress bins, turnover, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import clip_index, clip_prefix, is_blank, is_error_text, mean_with_error
from strandline.functions.vectors import cosine
from strandline.operators import dedupe, matching, sequences, summaries
from strandline.plans.registry import Catalog, Tables

catalog = Catalog()

THRESHOLDS = [-0.2, 0.0, 0.2, 0.3, 0.5, 0.7, 0.9]

METRICS_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
o AS (
  SELECT vec_id, label, v, row_number() OVER w AS position, count(*) OVER (PARTITION BY label) AS length,
    last_value(v) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin,
    lead(v) OVER w AS nxt
  FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
m AS (
  SELECT vec_id, label, position, length, list_cosine_similarity(v, fin) AS to_final,
    CASE WHEN nxt IS NOT NULL THEN list_cosine_similarity(v, nxt) END AS to_next,
    CAST(greatest(1, least(20, round_even(position / length * 20, 0))) AS INTEGER) AS bin_index
  FROM o WHERE length >= 2)
"""


def metrics(t: Tables) -> DataFrame:
    return sequences.sequence_metrics(t.embeddings, ["label"], ["vec_id"], "embedding")


def _bin_aggregates() -> list:
    quarters = F.percentile("to_final", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count("*").alias("sample_count"),
        F.round(F.avg("to_final"), 6).alias("mean_similarity"),
        F.round(quarters[0], 6).alias("p25"),
        F.round(quarters[1], 6).alias("p50"),
        F.round(quarters[2], 6).alias("p75"),
    ]


_BIN_SQL = """count(*) AS sample_count, round(avg(to_final), 6) AS mean_similarity, round(quantile_cont(to_final, 0.25), 6) AS p25,
  round(quantile_cont(to_final, 0.5), 6) AS p50, round(quantile_cont(to_final, 0.75), 6) AS p75"""


@catalog.add(f"{METRICS_SQL} SELECT bin_index, bin_index / 20 AS progress_ratio, {_BIN_SQL} FROM m GROUP BY bin_index")
def progress_bins(t: Tables) -> DataFrame:
    """Similarity to the sequence's end by progress through it."""
    return metrics(t).groupBy("bin_index").agg(*_bin_aggregates()).withColumn("progress_ratio", F.col("bin_index") / 20)


@catalog.add(
    f"{METRICS_SQL}, g AS (SELECT *, label % 2 AS half, label % 3 AS third FROM m) "
    f"SELECT half, third, bin_index, {_BIN_SQL} FROM g GROUP BY GROUPING SETS ((half, third, bin_index), (half, bin_index), (bin_index))"
)
def progress_bins_levels(t: Tables) -> DataFrame:
    """The same on three levels of grouping in one pass."""
    rows = metrics(t).withColumn("half", F.col("label") % 2).withColumn("third", F.col("label") % 3)
    return summaries.grouping_sets(rows, [["half", "third", "bin_index"], ["half", "bin_index"], ["bin_index"]], _bin_aggregates())


@catalog.add(
    f"{METRICS_SQL} SELECT label, vec_id, position, length, position / length AS raw_ratio, bin_index / 20 AS binned_ratio, "
    "round(to_final, 6) AS similarity, round(to_next, 6) AS to_next FROM m"
)
def sequence_points(t: Tables) -> DataFrame:
    """One row per member with raw and binned progress."""
    return metrics(t).select(
        "label", "vec_id", F.col("position").cast("bigint").alias("position"), "length",
        (F.col("position") / F.col("length")).alias("raw_ratio"), (F.col("bin_index") / 20).alias("binned_ratio"),
        F.round("to_final", 6).alias("similarity"), F.round("to_next", 6).alias("to_next"),
    )


@catalog.add(
    """SELECT o_custkey, o_orderkey, CASE WHEN abs(fin) > 1e-12 THEN round(o_totalprice / fin, 6) END AS relative FROM (
    SELECT *, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM orders)"""
)
def relative_to_final(t: Tables) -> DataFrame:
    rows = sequences.relative_to_final(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return rows.select("o_custkey", "o_orderkey", F.round("relative", 6).alias("relative"))


@catalog.add(
    f"{METRICS_SQL}, th AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold) "
    "SELECT label, threshold, CAST(coalesce(sum(CASE WHEN to_next < threshold THEN 1 ELSE 0 END), 0) AS BIGINT) AS turnover, "
    "round(coalesce(sum(CASE WHEN to_next < threshold THEN 1 ELSE 0 END), 0) / max(length), 6) AS turnover_ratio FROM m, th GROUP BY label, threshold"
)
def turnover_ratio(t: Tables) -> DataFrame:
    """Neighbours below a threshold, over the sequence's length."""
    rows = sequences.turnover(metrics(t), ["label"], THRESHOLDS)
    return rows.select("label", "threshold", "turnover", F.round("turnover_ratio", 6).alias("turnover_ratio"))


@catalog.add(
    f"{METRICS_SQL}, w AS (SELECT label, position / length AS place, greatest(0, 1 - to_next) AS weight FROM m WHERE to_next IS NOT NULL) "
    "SELECT label, round(sum(weight * place) / nullif(sum(weight), 0), 6) AS weighted_position FROM w GROUP BY label"
)
def wastp(t: Tables) -> DataFrame:
    rows = sequences.weighted_turnover_position(metrics(t), ["label"])
    return rows.select("label", F.round("weighted_position", 6).alias("weighted_position"))


@catalog.add(
    f"{METRICS_SQL}, w AS (SELECT label, position / length AS place, greatest(0, 1 - to_next) AS weight FROM m WHERE to_next IS NOT NULL), "
    "s AS (SELECT label % 2 AS half, label % 3 AS third, sum(weight * place) / nullif(sum(weight), 0) AS p FROM w GROUP BY label) "
    "SELECT half, round(avg(p) FILTER (WHERE third = 0), 4) AS third_0, round(avg(p) FILTER (WHERE third = 1), 4) AS third_1, "
    "round(avg(p) FILTER (WHERE third = 2), 4) AS third_2 FROM s GROUP BY half"
)
def wastp_pivot(t: Tables) -> DataFrame:
    """Mean weighted position as a table of two label properties."""
    rows = sequences.weighted_turnover_position(metrics(t), ["label"]).select(
        (F.col("label") % 2).alias("half"), F.concat(F.lit("third_"), F.col("label") % 3).alias("third"), "weighted_position"
    )
    return rows.groupBy("half").pivot("third", ["third_0", "third_1", "third_2"]).agg(F.round(F.avg("weighted_position"), 4))


@catalog.add(
    f"{METRICS_SQL} SELECT length, count(*) AS n, round(min(to_next), 6) AS lowest, round(quantile_cont(to_next, 0.25), 6) AS p25, "
    "round(quantile_cont(to_next, 0.5), 6) AS p50, round(quantile_cont(to_next, 0.75), 6) AS p75, round(max(to_next), 6) AS highest "
    "FROM m WHERE to_next IS NOT NULL GROUP BY length"
)
def neighbor_by_clip_count(t: Tables) -> DataFrame:
    spread = F.percentile("to_next", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("lowest", "p25", "p50", "p75", "highest")
    return metrics(t).where("to_next IS NOT NULL").groupBy("length").agg(
        F.count("*").alias("n"), *[F.round(spread[i], 6).alias(x) for i, x in enumerate(names)]
    )


_PAIR_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
o AS (SELECT label, vec_id, v, lead(v, 1) OVER w AS n1, lead(v, 2) OVER w AS n2 FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
p AS (SELECT label, vec_id, list_cosine_similarity(v, n1) AS hcs, list_cosine_similarity(v, n2) AS nhcs FROM o WHERE n1 IS NOT NULL AND n2 IS NOT NULL)
"""


def _pairs(t: Tables) -> DataFrame:
    """Near and far similarity of each member, as two modes of one metric stream."""
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = t.embeddings.withColumn("n1", F.lead("embedding", 1).over(by)).withColumn("n2", F.lead("embedding", 2).over(by))
    rows = rows.where("n1 IS NOT NULL AND n2 IS NOT NULL")
    return rows.select("label", "vec_id", cosine(F.col("embedding"), F.col("n1")).alias("hcs"), cosine(F.col("embedding"), F.col("n2")).alias("nhcs"))


@catalog.add(
    f"{_PAIR_SQL}, l AS (SELECT label, vec_id, 'HCS' AS metric, hcs AS similarity FROM p UNION ALL SELECT label, vec_id, 'NHCS', nhcs FROM p) "
    "SELECT metric, label, count(*) AS n, round(avg(similarity), 6) AS mean_similarity, round(coalesce(stddev_samp(similarity), 0), 6) AS std_similarity, "
    "round(coalesce(stddev_samp(similarity), 0) / sqrt(count(*)), 6) AS std_error FROM l GROUP BY GROUPING SETS ((metric, label), (metric))"
)
def pair_sensitivity(t: Tables) -> DataFrame:
    """Mean, sample deviation and standard error on two levels."""
    long = _pairs(t).unpivot(["label", "vec_id"], ["hcs", "nhcs"], "metric", "similarity").withColumn("metric", F.upper("metric"))
    s = F.col("similarity")
    return summaries.grouping_sets(
        long,
        [["metric", "label"], ["metric"]],
        [
            F.count("*").alias("n"),
            F.round(F.avg(s), 6).alias("mean_similarity"),
            F.round(summaries.sample_std(s), 6).alias("std_similarity"),
            F.round(summaries.standard_error(s), 6).alias("std_error"),
        ],
    )


@catalog.add(f"{_PAIR_SQL} SELECT label, vec_id, round(hcs, 6) AS hcs, round(nhcs, 6) AS nhcs, round(hcs / nhcs, 4) AS ratio FROM p WHERE abs(nhcs) > 1e-12")
def ratio_points(t: Tables) -> DataFrame:
    """Ratio of two modes of one stream; near-zero denominators are left out."""
    rows = _pairs(t).where(F.abs("nhcs") > 1e-12)
    return rows.select("label", "vec_id", F.round("hcs", 6).alias("hcs"), F.round("nhcs", 6).alias("nhcs"), F.round(F.col("hcs") / F.col("nhcs"), 4).alias("ratio"))


@catalog.add(
    """WITH c AS (SELECT DISTINCT ON (comparison_id) * FROM clip_comparisons)
    SELECT audio_condition, metric_name, round(avg(similarity) FILTER (WHERE comparison_mode), 6) AS mean_paired,
      round(avg(similarity) FILTER (WHERE NOT comparison_mode), 6) AS mean_unpaired,
      round(avg(similarity) FILTER (WHERE comparison_mode) / avg(similarity) FILTER (WHERE NOT comparison_mode), 6) AS ratio_of_means
    FROM c WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY audio_condition, metric_name"""
)
def ratio_table(t: Tables) -> DataFrame:
    """Ratio of means per condition, over comparisons counted once."""
    rows = t.clip_comparisons.select("comparison_id", "audio_condition", "metric_name", "comparison_mode", "similarity").dropDuplicates(["comparison_id"])
    rows = rows.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    mode = F.col("comparison_mode")
    paired, unpaired = F.avg(F.when(mode, F.col("similarity"))), F.avg(F.when(~mode, F.col("similarity")))
    return rows.groupBy("audio_condition", "metric_name").agg(
        F.round(paired, 6).alias("mean_paired"), F.round(unpaired, 6).alias("mean_unpaired"), F.round(F.try_divide(paired, unpaired), 6).alias("ratio_of_means")
    )


_CLIPS_SQL = r"""
WITH r AS (SELECT DISTINCT ON (result_id) * FROM clip_results),
c AS (SELECT result_id, model_label, prompt_name, dataset_name, utt_count, text,
  regexp_extract(clip_identifier, '^(.*?)_clip_?\d+$', 1) AS prefix, CAST(nullif(regexp_extract(clip_identifier, '_clip_?(\d+)$', 1), '') AS INTEGER) AS idx FROM r)
"""


def clips(t: Tables) -> DataFrame:
    rows = t.clip_results.select("result_id", "model_label", "prompt_name", "dataset_name", "utt_count", "clip_identifier", "text")
    rows = rows.dropDuplicates(["result_id"])
    return rows.withColumn("prefix", clip_prefix(F.col("clip_identifier"))).withColumn("idx", clip_index(F.col("clip_identifier"))).drop("clip_identifier")


SEQUENCE = ["model_label", "prompt_name", "dataset_name", "utt_count", "prefix"]
#: The model whose sequences all others are aligned with.
REFERENCE_MODEL = "vidlm-base"


@catalog.add(
    f"""{_CLIPS_SQL}, s AS (SELECT *, dense_rank() OVER (PARTITION BY model_label, prompt_name, dataset_name, utt_count, prefix ORDER BY idx) AS pos FROM c),
    n AS (SELECT *, max(pos) OVER (PARTITION BY model_label, prompt_name, dataset_name, utt_count, prefix) AS cnt FROM s)
    SELECT result_id, CAST(pos AS INTEGER) AS clip_position, CAST(cnt AS INTEGER) AS clip_count, round(pos / cnt, 6) AS progress_ratio, pos = cnt AS is_final,
      concat_ws('|', model_label, prompt_name, dataset_name, utt_count, prefix) AS sequence_id FROM n"""
)
def finalised_sequences(t: Tables) -> DataFrame:
    """Position, count and id of every clip in its sequence."""
    rows = sequences.finalise_sequences(clips(t), SEQUENCE, "idx")
    return rows.select("result_id", "clip_position", "clip_count", F.round("progress_ratio", 6).alias("progress_ratio"), "is_final", "sequence_id")


@catalog.add(
    f"""{_CLIPS_SQL}, f AS (SELECT *, (starts_with(trim(text), '[ERROR]') OR regexp_matches(text, '(?i)(cuda.*out of memory|outofmemoryerror|torch\\.cuda\\..*outofmemory|cuda out of memory)')) IS TRUE AS bad FROM c),
    g AS (SELECT *, bool_or(bad) OVER (PARTITION BY model_label, prompt_name, dataset_name, utt_count, prefix) AS any_bad FROM f),
    k AS (SELECT * FROM g WHERE NOT any_bad AND trim(coalesce(text, '')) <> '')
    SELECT result_id, CAST(row_number() OVER (PARTITION BY model_label, prompt_name, dataset_name, utt_count, prefix ORDER BY idx, result_id) AS INTEGER) AS position,
      count(*) OVER (PARTITION BY model_label, prompt_name, dataset_name, utt_count, prefix) AS length FROM k"""
)
def valid_sequences(t: Tables) -> DataFrame:
    """Sequences without any error, renumbered after blanks are gone."""
    rows = sequences.reject_sequences(clips(t), SEQUENCE, is_error_text(F.col("text"))).where(~is_blank(F.col("text")))
    return sequences.number_positions(rows, SEQUENCE, ["idx", "result_id"]).select("result_id", "position", "length")


@catalog.add(
    f"""{_CLIPS_SQL}, d AS (SELECT model_label, prompt_name, dataset_name, utt_count, prefix, idx, min(result_id) AS id FROM c WHERE idx IS NOT NULL GROUP BY ALL),
    s AS (SELECT model_label, prompt_name, dataset_name, utt_count, prefix, list(idx ORDER BY idx) AS ids, list(id ORDER BY idx) AS vals FROM d GROUP BY ALL),
    j AS (SELECT a.prompt_name, a.dataset_name, a.utt_count, a.prefix, unnest(a.ids) AS idx, unnest(a.vals) AS left_value, unnest(b.vals) AS right_value
      FROM s a JOIN s b USING (prompt_name, dataset_name, utt_count, prefix)
      WHERE a.model_label = 'vidlm-base' AND b.model_label = 'vidlm-small' AND a.ids = b.ids)
    SELECT * FROM j"""
)
def aligned_sequences(t: Tables) -> DataFrame:
    """Clips of two models' sequences with identical index lists, element by element."""
    keys = ["prompt_name", "dataset_name", "utt_count", "prefix"]
    once = clips(t).groupBy(*SEQUENCE, "idx").agg(F.min("result_id").alias("id"))
    a, b = (once.where(F.col("model_label") == m).drop("model_label") for m in ("vidlm-base", "vidlm-small"))
    return matching.aligned_sequences(a, b, keys, "idx", "id")


@catalog.add(
    f"""{_CLIPS_SQL}, d AS (SELECT model_label, prompt_name, dataset_name, utt_count, prefix, idx, min(result_id) AS id FROM c WHERE idx IS NOT NULL GROUP BY ALL),
    s AS (SELECT model_label, prompt_name, dataset_name, utt_count, prefix, list(idx ORDER BY idx) AS ids, list(id ORDER BY idx) AS vals FROM d GROUP BY ALL)
    SELECT b.model_label, b.prompt_name, b.dataset_name, b.utt_count, b.prefix, unnest(a.ids) AS idx, unnest(a.vals) AS left_value, unnest(b.vals) AS right_value
    FROM s a JOIN s b ON a.prompt_name = b.prompt_name AND a.dataset_name = b.dataset_name AND a.utt_count = b.utt_count AND a.prefix = b.prefix
    WHERE a.model_label = 'vidlm-base' AND b.model_label <> 'vidlm-base' AND a.ids = b.ids"""
)
def aligned_models(t: Tables) -> DataFrame:
    """Clips of the reference model's sequences and of every other model's with
    identical index lists, element by element."""
    once = clips(t).groupBy(*SEQUENCE, "idx").agg(F.min("result_id").alias("id"))
    a = once.where(F.col("model_label") == REFERENCE_MODEL).drop("model_label")
    b = once.where(F.col("model_label") != REFERENCE_MODEL)
    return matching.aligned_sequences(a, b, SEQUENCE[1:], "idx", "id", kept=("model_label",))


@catalog.add(
    f"""{_CLIPS_SQL}, h AS (SELECT DISTINCT prompt_name, dataset_name, utt_count, prefix FROM c WHERE prefix <> ''),
    l AS (SELECT DISTINCT model_label FROM c),
    p AS (SELECT DISTINCT model_label, prompt_name, dataset_name, utt_count, prefix FROM c)
    SELECT l.model_label, count(*) AS pairs, count(p.prefix) AS present, count(*) - count(p.prefix) AS missing
    FROM h CROSS JOIN l LEFT JOIN p ON p.model_label = l.model_label AND p.prompt_name = h.prompt_name AND p.dataset_name = h.dataset_name
      AND p.utt_count = h.utt_count AND p.prefix = h.prefix GROUP BY l.model_label"""
)
def model_coverage(t: Tables) -> DataFrame:
    """Sequences each model answered and those it lacks: a sequence is present
    for as many models as answered it, so no pairs have to be formed."""
    rows = clips(t).where("prefix IS NOT NULL").select(*SEQUENCE).distinct()
    every = rows.drop("model_label").distinct().agg(F.count("*").alias("pairs"))
    present = rows.groupBy("model_label").agg(F.count("*").alias("present"))
    labels = t.clip_results.select("model_label").distinct().join(present, "model_label", "left").na.fill(0, ["present"])
    with_all = labels.withColumn("pairs", every.scalar())
    return with_all.select("model_label", "pairs", "present", (F.col("pairs") - F.col("present")).alias("missing"))


@catalog.add(
    f"""{_CLIPS_SQL}, p AS (SELECT DISTINCT model_label, prompt_name, dataset_name, utt_count, prefix FROM c WHERE prefix <> ''),
    h AS (SELECT DISTINCT prompt_name, dataset_name, utt_count, prefix FROM p),
    l AS (SELECT DISTINCT model_label FROM c WHERE model_label IS NOT NULL)
    SELECT l.model_label, h.* FROM h CROSS JOIN l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.model_label = l.model_label
      AND p.prompt_name IS NOT DISTINCT FROM h.prompt_name AND p.dataset_name IS NOT DISTINCT FROM h.dataset_name
      AND p.utt_count IS NOT DISTINCT FROM h.utt_count AND p.prefix = h.prefix)"""
)
def missing_sequences(t: Tables) -> DataFrame:
    """Each sequence some model answered with every model that lacks it."""
    rows = clips(t).where("prefix IS NOT NULL").select(*SEQUENCE).distinct()
    labels = t.clip_results.agg(F.collect_set("model_label").alias("labels"))
    wanted = rows.drop("model_label").distinct().withColumn("model_label", F.explode(labels.scalar())).alias("w")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"p.{k}")) for k in SEQUENCE]
    return wanted.join(rows.alias("p"), same, "left_anti").select(*SEQUENCE)


@catalog.add(
    """WITH c AS (SELECT DISTINCT ON (comparison_id) * FROM clip_comparisons), r AS (SELECT DISTINCT ON (result_id) * FROM clip_results)
    SELECT c.comparison_id, r.result_id, c.model_label = r.model_label AS same_model, c.text_equal FROM (
      SELECT *, source_text = reference_text AS text_equal FROM c) c JOIN r ON c.reference_result_id = r.result_id
      AND c.prompt_name = r.prompt_name AND c.dataset_name = r.dataset_name AND c.utt_count = r.utt_count"""
)
def clip_pairs(t: Tables) -> DataFrame:
    """Comparisons joined to the results they refer to on a composite key."""
    keys = ["result_id", "prompt_name", "dataset_name", "utt_count"]
    c = t.clip_comparisons.dropDuplicates(["comparison_id"]).select(
        "comparison_id", F.col("reference_result_id").alias("result_id"), "prompt_name", "dataset_name", "utt_count",
        F.col("model_label").alias("compared"), (F.col("source_text") == F.col("reference_text")).alias("text_equal"),
    )
    r = t.clip_results.dropDuplicates(["result_id"]).select(*keys, "model_label")
    return c.join(r, keys).select("comparison_id", "result_id", (F.col("compared") == F.col("model_label")).alias("same_model"), "text_equal")


@catalog.add(
    """WITH c AS (SELECT DISTINCT ON (comparison_id) * FROM clip_comparisons), r AS (SELECT DISTINCT ON (result_id) * FROM clip_results)
    SELECT comparison_id FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.clip_identifier = c.clip_identifier AND r.model_label = c.model_label)"""
)
def unmatched_comparisons(t: Tables) -> DataFrame:
    c = t.clip_comparisons.select("comparison_id", "clip_identifier", "model_label").dropDuplicates(["comparison_id"])
    return c.join(t.clip_results.select("clip_identifier", "model_label"), ["clip_identifier", "model_label"], "left_anti").select("comparison_id")


@catalog.add(
    """WITH b AS (SELECT label, count(*) AS n, avg(vec_id) AS a FROM embeddings GROUP BY label)
    SELECT label, 'n' AS stat, CAST(n AS DOUBLE) AS value FROM b UNION ALL SELECT label, 'a', round(a, 6) FROM b"""
)
def unpivot_summary(t: Tables) -> DataFrame:
    wide = t.embeddings.groupBy("label").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("vec_id"), 6).alias("a"))
    return summaries.unpivot(wide, ["label"], ["n", "a"])


@catalog.add(
    """WITH r AS (SELECT DISTINCT ON (result_id) * FROM clip_results),
    s AS (SELECT DISTINCT ON (comparison_id) * FROM clip_comparisons),
    u AS (SELECT 0 AS src, clip_identifier AS k, length(text) AS n FROM r WHERE text IS NOT NULL
      UNION ALL SELECT 1, clip_identifier, length(source_text) FROM s WHERE source_text IS NOT NULL)
    SELECT k AS clip_identifier, CAST(min(src) AS INTEGER) AS source, round(avg(n), 4) AS mean_length FROM (
      SELECT *, min(src) OVER (PARTITION BY k) AS lead FROM u) WHERE src = lead GROUP BY k"""
)
def preferred_source(t: Tables) -> DataFrame:
    """Per clip the results where there are any, otherwise the comparisons."""
    r = t.clip_results.dropDuplicates(["result_id"]).where("text IS NOT NULL").select("clip_identifier", F.length("text").alias("n"), F.lit(0).alias("source"))
    s = t.clip_comparisons.dropDuplicates(["comparison_id"]).where("source_text IS NOT NULL")
    s = s.select("clip_identifier", F.length("source_text").alias("n"), F.lit(1).alias("source"))
    both = dedupe.union_first_wins([r, s], ["clip_identifier"])
    return both.groupBy("clip_identifier").agg(F.min("source").alias("source"), F.round(F.avg("n"), 4).alias("mean_length"))


@catalog.add(
    """SELECT l_returnflag, count(*) AS n, CASE WHEN avg(l_discount) IS NULL THEN '' ELSE
      printf('%.3f', avg(l_discount)) || ' ± ' || printf('%.3f', coalesce(stddev_samp(l_discount), 0) / sqrt(count(*))) END AS shown
    FROM lineitem GROUP BY l_returnflag"""
)
def formatted_means(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(d).alias("m"), summaries.standard_error(d).alias("e")).select(
        "l_returnflag", "n", mean_with_error(F.col("m"), F.col("e")).alias("shown")
    )

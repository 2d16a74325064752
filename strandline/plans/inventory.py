"""Queries on labels, documents, joins with reports, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import casts, documents, geometry, text
from strandline.functions.speech import canonical_speaker
from strandline.operators import matching, state, summaries, windows
from strandline.operators.intervals import label_sql
from strandline.plans.registry import Catalog, Tables
from strandline.plans.similarity import METRICS_SQL, clips, metrics
from strandline.session import run_dir
from strandline.sources import files, sinks

catalog = Catalog()


# ------------------------------------------------------------------ filters


@catalog.add(
    f"""{METRICS_SQL} SELECT label % 4 AS part, bin_index, count(*) AS n, round(avg(to_final), 6) AS mean_similarity FROM m GROUP BY 1, 2 HAVING count(*) >= 5"""
)
def shown_bins(t: Tables) -> DataFrame:
    """Bins of at least five samples, as plots show them."""
    aggregates = [F.count("*").alias("n"), F.round(F.avg("to_final"), 6).alias("mean_similarity")]
    return summaries.frequent(metrics(t).withColumn("part", F.col("label") % 4), ["part", "bin_index"], aggregates, 5)


@catalog.add(
    """SELECT CAST(o_orderkey // 100 + 1 AS BIGINT) AS block, count(*) AS n, count(*) FILTER (WHERE o_orderkey >= 200 AND o_orderkey < 300) AS in_third FROM orders GROUP BY 1"""
)
def order_blocks(t: Tables) -> DataFrame:
    """Orders per block of a hundred ids, and those of the third block."""
    key = F.col("o_orderkey")
    return t.orders.groupBy((F.floor(key / 100) + 1).alias("block")).agg(F.count("*").alias("n"), F.count_if(windows.in_hundred(key, 3)).alias("in_third"))


_OPTIONS_SQL = "string_agg(CAST(l_suppkey % 5 AS VARCHAR), ', ' ORDER BY l_linenumber, l_suppkey, l_partkey) || CASE WHEN l_orderkey % 7 = 0 THEN ',x' ELSE '' END"


@catalog.add(
    f"""WITH o AS (SELECT l_orderkey, {_OPTIONS_SQL} AS listed FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN array_to_string(list_sort(list_distinct(list_transform(string_split(listed, ','), lambda x: CAST(trim(x) AS INTEGER)))), ',') END AS options FROM o"""
)
def option_lists(t: Tables) -> DataFrame:
    """Written lists of numbers as distinct ordered options; NULL where one is no number."""
    item = F.struct("l_linenumber", "l_suppkey", "l_partkey", (F.col("l_suppkey") % 5).cast("string").alias("o"))
    listed = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(item))["o"], ", ").alias("listed"))
    written = F.concat("listed", F.when(F.col("l_orderkey") % 7 == 0, ",x").otherwise(""))
    return listed.select("l_orderkey", F.array_join(casts.option_list(written).cast("array<string>"), ",").alias("options"))


@catalog.add(
    """WITH r AS (SELECT DISTINCT ON (response_id) * FROM selected_responses)
    SELECT response_id, TRY_CAST(trim(submitted) AS INTEGER) AS flag, coalesce(nullif(trim(node_id), ''), 'unknown') AS label FROM r
    WHERE regexp_matches(trim(submitted), '^[0-9]+$') AND TRY_CAST(trim(submitted) AS INTEGER) IN (0, 1)"""
)
def castable_flags(t: Tables) -> DataFrame:
    """Rows whose flag is written as a number of a given set, others dropped; a default label."""
    rows = t.selected_responses.select("response_id", "submitted", "node_id").dropDuplicates(["response_id"])
    flag = F.when(F.trim("submitted").rlike("^[0-9]+$"), casts.to_int(F.col("submitted"))).cast("int")
    label = F.coalesce(F.nullif(F.trim("node_id"), F.lit("")), F.lit("unknown"))
    return rows.where(flag.isin(0, 1)).select("response_id", flag.alias("flag"), label.alias("label"))


@catalog.add(
    """WITH r AS (SELECT DISTINCT ON (recording_id) * FROM recordings), g AS (SELECT DISTINCT recording_id FROM gaze_samples)
    SELECT r.recording_id, g.recording_id IS NULL AS skipped, CASE WHEN g.recording_id IS NULL THEN 'no_gaze_points' END AS skip_reason,
      g.recording_id IS NOT NULL AND r.has_pupil_recording AS reused FROM r LEFT JOIN g USING (recording_id)"""
)
def gaze_skips(t: Tables) -> DataFrame:
    """Recordings that are skipped, with the reason, which is looked for before what can be reused."""
    held = t.gaze_samples.select("recording_id").distinct().withColumn("_has", F.lit(True))
    rows = t.recordings.select("recording_id", "has_pupil_recording").dropDuplicates(["recording_id"]).join(held, "recording_id", "left")
    none = F.col("_has").isNull()
    return rows.select("recording_id", none.alias("skipped"), F.when(none, "no_gaze_points").alias("skip_reason"), (~none & F.col("has_pupil_recording")).alias("reused"))


# -------------------------------------------------------------------- joins


@catalog.add(
    """WITH c AS (SELECT DISTINCT ON (comparison_id) * FROM clip_comparisons), r AS (SELECT DISTINCT ON (result_id) * FROM clip_results)
    SELECT c.comparison_id, coalesce(r.text, '') AS response, coalesce(r.text, '') = '' OR starts_with(trim(r.text), '[ERROR]') AS is_error
    FROM c LEFT JOIN r ON r.result_id = c.reference_result_id"""
)
def response_errors(t: Tables) -> DataFrame:
    """Keys with their response, '' without one; an empty response counts as an error."""
    c = t.clip_comparisons.select("comparison_id", F.col("reference_result_id").alias("result_id")).dropDuplicates(["comparison_id"])
    r = t.clip_results.select("result_id", "text").dropDuplicates(["result_id"])
    response = F.coalesce("text", F.lit(""))
    return c.join(r, "result_id", "left").select("comparison_id", response.alias("response"), ((response == "") | F.trim(response).startswith(text.ERROR_PREFIX)).alias("is_error"))


@catalog.add(
    """WITH c AS (SELECT DISTINCT ON (comparison_id) * FROM clip_comparisons),
    v AS (SELECT metric_name, model_label, prompt_name, dataset_name, utt_count, clip_identifier, audio_condition, arg_max(similarity, comparison_id) AS s FROM c WHERE similarity IS NOT NULL GROUP BY ALL),
    a AS (SELECT * FROM v WHERE metric_name = 'token_overlap'), b AS (SELECT * FROM v WHERE metric_name = 'embed_cos')
    SELECT a.model_label, a.prompt_name, a.dataset_name, a.utt_count, a.clip_identifier, a.audio_condition,
      CASE WHEN b.s IS NULL THEN 'missing' WHEN abs(b.s) <= 1e-12 THEN 'near_zero' ELSE 'ratio' END AS status,
      round(CASE WHEN abs(b.s) > 1e-12 THEN a.s / b.s END, 6) AS ratio
    FROM a LEFT JOIN b ON a.model_label IS NOT DISTINCT FROM b.model_label AND a.prompt_name IS NOT DISTINCT FROM b.prompt_name AND a.dataset_name IS NOT DISTINCT FROM b.dataset_name
      AND a.utt_count IS NOT DISTINCT FROM b.utt_count AND a.clip_identifier IS NOT DISTINCT FROM b.clip_identifier AND a.audio_condition IS NOT DISTINCT FROM b.audio_condition"""
)
def metric_ratios(t: Tables) -> DataFrame:
    """One metric over another of the same clip and condition, with what has no ratio."""
    keys = ["model_label", "prompt_name", "dataset_name", "utt_count", "clip_identifier", "audio_condition"]
    rows = t.clip_comparisons.select("comparison_id", "metric_name", "similarity", *keys).dropDuplicates(["comparison_id"]).where("similarity IS NOT NULL")
    found = matching.ratio_join(rows, keys, "metric_name", ("token_overlap", "embed_cos"), "similarity", "comparison_id")
    return found.select(*keys, "status", F.round("ratio", 6).alias("ratio"))


@catalog.add(
    r"""WITH v AS (SELECT DISTINCT regexp_extract(video_path, '([^/]+)\.[^.]+$', 1) AS stem FROM video_timings WHERE video_path IS NOT NULL),
    a AS (SELECT DISTINCT regexp_extract(audio_path, '([^/]+)\.[^.]+$', 1) AS stem FROM video_timings WHERE audio_path IS NOT NULL)
    SELECT coalesce(v.stem, a.stem) AS stem, CASE WHEN a.stem IS NULL THEN 'left_only' WHEN v.stem IS NULL THEN 'right_only' ELSE 'both' END AS status
    FROM v FULL JOIN a ON v.stem = a.stem"""
)
def stem_status(t: Tables) -> DataFrame:
    """Stems with a video, a sound file, or both."""
    stem = lambda c: t.video_timings.where(F.col(c).isNotNull()).select(F.regexp_extract(c, r"([^/]+)\.[^.]+$", 1).alias("stem"))
    return matching.stem_report(stem("video_path"), stem("audio_path"), "stem")


# --------------------------------------------------------------- aggregates

_STATUS_SQL = """WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS success,
  count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'click') AS retry FROM events WHERE event_id % 1 = 0 GROUP BY 1),
s AS (SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN success = total THEN 'success' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial_failed'
  WHEN retry > 0 THEN 'retry_pending' ELSE 'pending' END AS status FROM g)
""".replace(" WHERE event_id % 1 = 0", "")


def _user_status(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    counts = {"success": "purchase", "failed": "error", "retry": "click"}
    g = t.events.groupBy("user_id").agg(F.count("*").alias("total"), *[F.count_if(kind == v).alias(k) for k, v in counts.items()])
    return g.withColumn("status", state.status_of({k: k for k in ("total", *counts)}))


@catalog.add(f"{_STATUS_SQL} SELECT user_id, total, failed, status FROM s")
def group_status(t: Tables) -> DataFrame:
    """Status of each group by precedence over the counts of its members."""
    return _user_status(t).select("user_id", "total", "failed", "status")


@catalog.add(f"{_STATUS_SQL} SELECT status, count(*) AS groups, CAST(sum(total) AS BIGINT) AS members FROM s GROUP BY status")
def status_summary(t: Tables) -> DataFrame:
    """The second level: groups and members per status."""
    return _user_status(t).groupBy("status").agg(F.count("*").alias("groups"), F.sum("total").alias("members"))


@catalog.add(
    r"""WITH p AS (SELECT lower(video_path) AS p FROM video_timings WHERE video_path IS NOT NULL UNION ALL SELECT lower(audio_path) FROM video_timings WHERE audio_path IS NOT NULL)
    SELECT CASE WHEN regexp_matches(p, '\.(mp4|mov|m4v|avi|mkv|webm)$') THEN 'video' WHEN regexp_matches(p, '\.(wav|mp3|flac)$') THEN 'audio' ELSE 'other' END AS category, count(*) AS n FROM p GROUP BY 1"""
)
def file_categories(t: Tables) -> DataFrame:
    """Files by the first category that matches."""
    kinds = [("video", r"\.(mp4|mov|m4v|avi|mkv|webm)$"), ("audio", r"\.(wav|mp3|flac)$")]
    paths = t.video_timings.select(F.explode(F.array_compact(F.array("video_path", "audio_path"))).alias("p"))
    return paths.groupBy(summaries.first_category(F.lower("p"), kinds).alias("category")).agg(F.count("*").alias("n"))


@catalog.add(
    f"""WITH u AS (SELECT DISTINCT ON (utterance_id) * FROM utterances), x AS (SELECT interaction_id, unnest(words) AS w FROM u),
    w AS (SELECT interaction_id, {label_sql("w.speaker")} AS speaker, CAST(round(w.start_s * 1000) AS BIGINT) AS s, CAST(round(w.end_s * 1000) AS BIGINT) AS e FROM x
      WHERE isfinite(w.start_s) AND isfinite(w.end_s)),
    g AS (SELECT interaction_id, max(greatest(s, e)) AS length_ms, count(*) FILTER (WHERE e - s > 4000) AS flagged,
      coalesce(sum(e - s) FILTER (WHERE e - s <= 4000 AND speaker = 'p1'), 0) AS a, coalesce(sum(e - s) FILTER (WHERE e - s <= 4000 AND speaker = 'p2'), 0) AS b FROM w GROUP BY 1)
    SELECT interaction_id, CAST(length_ms AS BIGINT) AS length_ms, flagged, CAST(a AS BIGINT) AS p1_ms, CAST(b AS BIGINT) AS p2_ms,
      CASE WHEN a > 0 AND b > 0 THEN round(greatest(a, b) / least(a, b), 3) ELSE -1 END AS speech_ratio,
      CASE WHEN length_ms > 0 THEN round((a + b) / length_ms, 5) ELSE 0 END AS talk_fraction FROM g"""
)
def speech_balance(t: Tables) -> DataFrame:
    """Speech of two speakers against each other and the whole length; the
    ratio is -1 (infinite) where one is silent, overlong words are left out."""
    words = t.utterances.select("utterance_id", "interaction_id", "words").dropDuplicates(["utterance_id"])
    ms = lambda c: F.when(F.abs(c) < 1e12, F.round(F.col(c) * 1000).cast("long"))
    w = words.select("interaction_id", F.explode("words").alias("w")).select("interaction_id", canonical_speaker(F.col("w.speaker")).alias("speaker"), ms("w.start_s").alias("s"), ms("w.end_s").alias("e"))
    long = F.col("e") - F.col("s")
    own = lambda who: F.coalesce(F.sum(F.when((long <= 4000) & (F.col("speaker") == who), long)), F.lit(0))
    g = w.where("s IS NOT NULL AND e IS NOT NULL").groupBy("interaction_id").agg(
        F.max(F.greatest("s", "e")).alias("length_ms"), F.count_if(long > 4000).alias("flagged"), own("p1").alias("p1_ms"), own("p2").alias("p2_ms")
    )
    ratio = F.when((F.col("p1_ms") > 0) & (F.col("p2_ms") > 0), F.round(F.try_divide(F.greatest("p1_ms", "p2_ms"), F.least("p1_ms", "p2_ms")), 3)).otherwise(-1.0)
    talk = F.when(F.col("length_ms") > 0, F.round(F.try_divide(F.col("p1_ms") + F.col("p2_ms"), F.col("length_ms")), 5)).otherwise(0.0)
    return g.select("interaction_id", "length_ms", "flagged", "p1_ms", "p2_ms", ratio.alias("speech_ratio"), talk.alias("talk_fraction"))


# ------------------------------------------------------ labels and documents


@catalog.add(
    """WITH r AS (SELECT DISTINCT ON (result_id) * FROM clip_results)
    SELECT result_id, utt_count AS group_size, prompt_name AS task,
      CASE WHEN result_id % 3 = 0 THEN 'Gemini-fast_' || model_label WHEN regexp_matches(model_label, '^.*-[0-9]+$')
        THEN 'base-' || regexp_extract(model_label, '([0-9]+)$', 1) || 'B' ELSE 'base' END AS label FROM r"""
)
def result_labels(t: Tables) -> DataFrame:
    """Group size, task and model label from the names of result folders."""
    rows = t.clip_results.select("result_id", "utt_count", "prompt_name", "model_label").dropDuplicates(["result_id"])
    served = F.col("result_id") % 3 == 0
    size = F.regexp_replace("model_label", r"-([0-9]+)$", "-$1b")
    leaf = F.when(served, F.concat(F.lit("fast_"), "model_label", F.lit("_"), "prompt_name", F.lit("_single-turn"))).otherwise(F.concat(size, F.lit("_"), F.upper("prompt_name")))
    folder = F.concat(F.lit("results/x/"), F.col("utt_count").cast("string"), F.lit("-utt_group/"), leaf)
    model = F.when(served, "Gemini").otherwise("base")
    return rows.select("result_id", text.group_size(folder).alias("group_size"), text.task_name(folder).alias("task"), text.model_label(model, folder).alias("label"))


@catalog.add(
    r"""WITH r AS (SELECT DISTINCT ON (result_id) * FROM clip_results)
    SELECT result_id, utt_count, dataset_name, dataset_name || '_u' || utt_count || 'b' || (result_id % 7) AS batch_name,
      CASE WHEN result_id % 5 <> 0 THEN 'g' || (result_id % 3) END AS group_name, CAST(regexp_extract(clip_identifier, '(\d+)$', 1) AS INTEGER) AS clip_index,
      CASE WHEN result_id % 5 <> 0 THEN 'g' || (result_id % 3) || '/' ELSE '' END || regexp_extract(clip_identifier, '^(.*)_clip', 1) AS group_identifier FROM r"""
)
def group_layouts(t: Tables) -> DataFrame:
    """Dataset, size, batch, group and clip from the paths of annotated clips."""
    rows = t.clip_results.select("result_id", "utt_count", "dataset_name", "clip_identifier").dropDuplicates(["result_id"])
    n = F.col("utt_count").cast("string")
    batch = F.concat("dataset_name", F.lit("_u"), n, F.lit("b"), (F.col("result_id") % 7).cast("string"))
    inner = F.when(F.col("result_id") % 5 != 0, F.concat(F.lit("g"), (F.col("result_id") % 3).cast("string"), F.lit("/"))).otherwise("")
    path = F.concat(F.lit("https://media.example/annotated/u"), n, F.lit("/"), batch, F.lit("/"), inner, "clip_identifier", F.lit(".mp4"))
    names = ("utt_count", "dataset_name", "batch_name", "group_name", "clip_index", "group_identifier")
    layout = text.group_layout(F.col("path"))
    return rows.select("result_id", path.alias("path")).select("result_id", *[layout[c].alias(c) for c in names])


@catalog.add(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey END AS dialogue, CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderkey END AS utterance,
      CASE WHEN o_orderkey % 4 = 2 THEN 'V' || o_custkey || '_S7_I' || o_orderkey END AS interaction_id, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey END AS segment FROM orders"""
)
def identifiers(t: Tables) -> DataFrame:
    """Four forms of identifiers taken apart."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    forms = [F.concat(F.lit("dia"), c, F.lit("_utt"), k), F.concat(F.lit("d"), c, F.lit("u"), k), F.concat(F.lit("V"), c, F.lit("_S7_I"), k, F.lit("_P0092A"))]
    which = F.col("o_orderkey") % 4
    stem = F.when(which == 0, forms[0]).when(which == 1, forms[1]).when(which == 2, forms[2]).otherwise(F.concat(F.lit("cam2_vid1_seg"), c))
    rows = t.orders.select("o_orderkey", stem.alias("stem"))
    place = text.dialogue_and_utterance(F.col("stem"))
    return rows.select(
        "o_orderkey",
        place["dialogue"].cast("bigint").alias("dialogue"),
        place["utterance"].cast("bigint").alias("utterance"),
        text.file_id_parts(F.col("stem"))["interaction_id"].alias("interaction_id"),
        text.camera_segment(F.col("stem"))["segment"].cast("bigint").alias("segment"),
    )


@catalog.add(
    """SELECT p_partkey, regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g') AS label, regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name,
      CASE p_size WHEN 1 THEN 'One' WHEN 2 THEN 'Two' ELSE CAST(p_size AS VARCHAR) END AS shown FROM (SELECT *, ' ' || p_name || '/' || p_type || '?' AS x FROM part)"""
)
def safe_labels(t: Tables) -> DataFrame:
    """Names made safe in two ways, and display labels."""
    x = F.concat(F.lit(" "), "p_name", F.lit("/"), "p_type", F.lit("?"))
    shown = text.display_label(F.col("p_size").cast("string"), {"1": "One", "2": "Two"})
    return t.part.select("p_partkey", text.sanitise_label(x).alias("label"), text.safe_name(x).alias("name"), shown.alias("shown"))


@catalog.add(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'About ' || n_name WHEN c_custkey % 3 = 1 THEN 'More of ' || r_name END AS prompt
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
)
def turn_prompts(t: Tables) -> DataFrame:
    """Templates looked up by key; the first turn has another than later ones, a blank one is none."""
    templates = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit(" About "), "n_name").alias("first"), F.concat(F.lit("More of "), "r_name").alias("later")
    )
    turn = F.col("c_custkey") % 3
    later = F.when(turn == 1, F.col("later")).otherwise(" ")
    return t.customer.join(templates, "c_nationkey").select("c_custkey", text.turn_prompt(turn, F.col("first"), later).alias("prompt"))


_RESULT_DOCS_SQL = r"""WITH r AS (SELECT DISTINCT ON (result_id) * FROM clip_results),
c AS (SELECT model_label, prompt_name, dataset_name, utt_count, regexp_extract(clip_identifier, '^(d\d+)u', 1) AS file, result_id, trim(text) AS text, regexp_extract(clip_identifier, '^(.+)_clip_?\d+$', 1) AS dialogue,
  CAST(regexp_extract(clip_identifier, '(\d+)$', 1) AS INTEGER) AS clip_index FROM r WHERE trim(text) <> '')
"""


@catalog.add(f"{_RESULT_DOCS_SQL} SELECT model_label, prompt_name, dataset_name, utt_count, file, dialogue, clip_index, arg_max(text, result_id) AS text FROM c GROUP BY ALL")
def dialogue_entries(t: Tables) -> DataFrame:
    """Clips found in result documents (one a dialogue of several utterances);
    of several clips of one index the last holds."""
    keys = ["model_label", "prompt_name", "dataset_name", "utt_count", "file"]
    rows = t.clip_results.select("result_id", *keys[:-1], "clip_identifier", "text").dropDuplicates(["result_id"])
    rows = rows.withColumn("file", F.regexp_extract("clip_identifier", r"^(d\d+)u", 1))
    item = F.struct(F.col("result_id").alias("n"), F.col("clip_identifier").alias("file"), F.col("text").alias("assistant"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    doc = F.parse_json(F.to_json(F.struct(F.lit("s").alias("__summary__"), F.struct(F.col("items").alias("folder")).alias("inner"))))
    return documents.dialogue_clips(listed.select(*keys, doc.alias("doc")), "doc", keys)


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (timing_id) * FROM video_timings)
    SELECT timing_id, video_path, round(coalesce(time_annot, video_length), 6) AS time_annot, round(current_video_time, 6) AS current_video_time FROM d"""
)
def press_data(t: Tables) -> DataFrame:
    """Press data in nested documents, with the scalar members beside it, which win."""
    rows = t.video_timings.select("timing_id", "video_path", "video_length", "time_annot", "current_video_time").dropDuplicates(["timing_id"])
    inner = F.struct("video_path", F.col("video_length").alias("time_annot"))
    member = F.struct(inner.alias("press_data"), "time_annot", "current_video_time", F.array(F.lit(1)).alias("list"))
    doc = F.parse_json(F.to_json(F.struct(F.array(F.array(member)).alias("data"))))
    found = documents.press_entries(rows.select("timing_id", doc.alias("doc")), "doc", ["timing_id"])
    read = lambda name, kind: F.try_variant_get(F.try_element_at("press", F.lit(name)), "$", kind)
    return found.select(
        "timing_id", read("video_path", "string").alias("video_path"), F.round(read("time_annot", "double"), 6).alias("time_annot"), F.round(read("current_video_time", "double"), 6).alias("current_video_time")
    )


@catalog.add(
    """WITH p AS (SELECT vec_id, [CAST(embedding[2 * i + 1] AS DOUBLE) FOR i IN range(32) IF embedding[2 * i + 1] > 0] AS xs, [CAST(embedding[2 * i + 2] AS DOUBLE) FOR i IN range(32) IF embedding[2 * i + 1] > 0] AS ys FROM embeddings)
    SELECT vec_id, round(list_min(xs), 6) AS x, round(list_min(ys), 6) AS y, round(list_max(xs) - list_min(xs) + 1, 6) AS w, round(list_max(ys) - list_min(ys) + 1, 6) AS h FROM p WHERE len(xs) > 0"""
)
def point_boxes(t: Tables) -> DataFrame:
    """Boxes of the visible points of interleaved coordinate lists."""
    at = lambda i: F.get("embedding", i).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"), F.when(at(2 * i) > 0, 2).otherwise(0).alias("v")))
    box = geometry.points_box(points)
    return t.embeddings.select("vec_id", box.alias("b")).where("b IS NOT NULL").select("vec_id", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in "xywh"])


@catalog.add(
    """SELECT event_id, CASE WHEN event_id % 30 < 25 THEN round((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + (event_id % 30) / 25.0, 6) END AS seconds FROM events"""
)
def timecodes(t: Tables) -> DataFrame:
    """Seconds of frame timecodes; NULL where the frame is beyond the rate."""
    e = F.col("event_id")
    parts = [F.lpad(x.cast("string"), 2, "0") for x in (e % 24, e % 60, (e * 7) % 60, e % 30)]
    return t.events.select("event_id", F.round(casts.seconds_of_timecode(F.concat_ws(":", *parts), 25.0), 6).alias("seconds"))


# --------------------------------------------- sources and sinks, there and back


def _place(t: Tables, name: str) -> str:
    return f"{run_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@catalog.add("SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def csv_there_and_back(t: Tables) -> DataFrame:
    """A table written as CSV in a fixed column order and read as text, typed leniently."""
    path = _place(t, "csv")
    sinks.write_csv(t.customer, path, ["c_nationkey", "c_custkey", "c_name", "c_acctbal"])
    rows = files.csv_table(t.spark, path, ["c_custkey", "c_acctbal"])
    return rows.select(casts.to_int(F.col("c_custkey")).alias("c_custkey"), "c_name", casts.to_int(F.col("c_nationkey")).cast("int").alias("c_nationkey"), F.round(casts.to_double(F.col("c_acctbal")), 4).alias("c_acctbal"))


@catalog.add("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def lines_there_and_back(t: Tables) -> DataFrame:
    """A table written as JSON lines and read under a schema."""
    path = _place(t, "lines")
    sinks.write_json_lines(t.events.select("event_id", "user_id", "event_type", "value"), path)
    return files.json_lines(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double").withColumn("value", F.round("value", 6))


@catalog.add("SELECT p_partkey, p_name, p_size FROM part")
def parquet_there_and_back(t: Tables) -> DataFrame:
    """Flat Parquet, checked for columns, types and rows when read."""
    path = _place(t, "flat")
    sinks.write_flat_parquet(t.part, path)
    return files.checked_parquet(t.spark, path, ["p_partkey", "p_name"], t.part.count()).select("p_partkey", "p_name", "p_size")


@catalog.add(
    """WITH l AS (SELECT o_custkey, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT c_custkey AS key, coalesce(l.status, 'new') AS status, l.last_order FROM customer LEFT JOIN l ON l.o_custkey = c_custkey
    UNION ALL SELECT l.o_custkey, l.status, l.last_order FROM l WHERE l.o_custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def registry_upsert(t: Tables) -> DataFrame:
    """A registry kept as a snapshot: changes replace, new keys are added."""
    path = _place(t, "registry")
    sinks.swap_snapshot(t.customer.select(F.col("c_custkey").alias("key"), F.lit("new").alias("status"), F.lit(None).cast("bigint").alias("last_order")), path)
    changes = t.orders.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max("o_orderkey").alias("last_order"))
    sinks.swap_snapshot(state.upsert(sinks.read_snapshot(t.spark, path), changes, ["key"]), path)
    return sinks.read_snapshot(t.spark, path)


@catalog.add(
    """WITH r AS (SELECT DISTINCT ON (result_id) * FROM clip_results) SELECT result_id, clip_identifier, length(text) AS size FROM r WHERE text IS NOT NULL"""
)
def manifest_records(t: Tables) -> DataFrame:
    """Records listed under one of several roots of manifest documents."""
    rows = t.clip_results.select("result_id", "clip_identifier", F.length("text").alias("size")).dropDuplicates(["result_id"]).where("size IS NOT NULL")
    # a document of at most 500 records
    part = F.floor(F.col("result_id") / 500)
    listed = rows.groupBy(part.alias("path")).agg(F.collect_list(F.struct("result_id", "clip_identifier", "size")).alias("entries"))
    docs = listed.select("path", F.parse_json(F.to_json(F.struct("entries"))).alias("doc"))
    read = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return files.manifest(docs).select(read("result_id", "bigint"), read("clip_identifier", "string"), read("size", "bigint"))

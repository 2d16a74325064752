"""Time, window, de-duplication and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import casts, geometry, text
from strandline.operators import dedupe, matching, sampling, sequences, summaries, windows
from strandline.plans.registry import Catalog, Tables

catalog = Catalog()


def _seconds(name: str):
    """Seconds since 1970 of a zone-less timestamp."""
    return F.unix_micros(F.col(name).cast("timestamp")) / 1e6


@catalog.add(
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE event_type = 'purchase') WHERE rn = 1"""
)
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'purchase'")
    return dedupe.best_per_key(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@catalog.add(
    """SELECT user_id, day, event_id, event_type FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
      ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def priority_dedupe(t: Tables) -> DataFrame:
    """One event per user and day: the type of greatest priority, then the latest id."""
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", 3).when(kind == "click", 2).when(kind == "view", 1).otherwise(0)
    rows = t.events.withColumn("day", F.to_date("ts"))
    return dedupe.best_per_key(rows, ["user_id", "day"], [priority, F.col("event_id")]).select("user_id", "day", "event_id", "event_type")


@catalog.add(
    """WITH u AS (SELECT 0 AS src, user_id, event_id FROM events WHERE event_type = 'purchase' UNION ALL
      SELECT 1, user_id, event_id FROM events WHERE event_type = 'click')
    SELECT user_id, event_id FROM (SELECT *, min(src) OVER (PARTITION BY user_id) AS lead FROM u) WHERE src = lead"""
)
def union_first_wins(t: Tables) -> DataFrame:
    parts = [t.events.where(F.col("event_type") == k).select("user_id", "event_id") for k in ("purchase", "click")]
    return dedupe.union_first_wins(parts, ["user_id"])


@catalog.add(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1"""
)
def keep_largest(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    return dedupe.best_per_key(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


_FIRST_SIGNUP_SQL = "SELECT user_id, min(epoch_us(ts)) AS s FROM events WHERE event_type = 'signup' GROUP BY user_id"


@catalog.add(
    f"""WITH i AS ({_FIRST_SIGNUP_SQL}), e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'signup' AND value >= 1.0)
    SELECT e.user_id, e.event_id, e.t - i.s AS offset_us FROM i JOIN e ON e.user_id = i.user_id AND e.t BETWEEN i.s AND i.s + 86400000000"""
)
def interval_join(t: Tables) -> DataFrame:
    """Events of a user within a day from the first sign-up, both ends included."""
    day = 86_400_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min(at).alias("s")).withColumn("e", F.col("s") + day)
    others = t.events.where("event_type <> 'signup' AND value >= 1.0").select("user_id", "event_id", at.alias("t"))
    rows = matching.interval_join(first, others, ["user_id"], "s", "e", "t", float(day))
    return rows.select("user_id", "event_id", (F.col("t") - F.col("s")).alias("offset_us"))


@catalog.add(
    """WITH i AS (SELECT user_id, event_id AS signup_id, epoch_us(ts) AS s FROM events WHERE event_type = 'signup'),
    e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'signup' AND value >= 1.0)
    SELECT i.user_id, i.signup_id, e.event_id, e.t - i.s AS offset_us FROM i JOIN e ON e.user_id = i.user_id AND e.t BETWEEN i.s AND i.s + 86400000000"""
)
def signup_intervals(t: Tables) -> DataFrame:
    """Events of a user within a day from each sign-up, both ends included;
    an event in several intervals comes out with each."""
    day = 86_400_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    signups = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), at.alias("s")).withColumn("e", F.col("s") + day)
    others = t.events.where("event_type <> 'signup' AND value >= 1.0").select("user_id", "event_id", at.alias("t"))
    rows = matching.interval_join(signups, others, ["user_id"], "s", "e", "t", float(day))
    return rows.select("user_id", "signup_id", "event_id", (F.col("t") - F.col("s")).alias("offset_us"))


@catalog.add(
    """WITH f AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
    p AS (SELECT user_id, epoch_us(ts) AS t, min(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
    b AS (SELECT f.event_id, f.user_id, f.t, p.t AS bt, p.v AS bv FROM f ASOF LEFT JOIN p ON f.user_id = p.user_id AND f.t > p.t),
    a AS (SELECT b.*, p.t AS nt, p.v AS nv FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.t)
    SELECT event_id, CASE WHEN nt IS NOT NULL AND (bt IS NULL OR nt - t <= t - bt) THEN CASE WHEN nt - t <= 1800000000 THEN nv END
      WHEN t - bt <= 1800000000 THEN bv END AS match_value FROM a"""
)
def nearest_asof(t: Tables) -> DataFrame:
    """The click nearest to each view of a user, at most half an hour away."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    views = t.events.where("event_type = 'view'").select("user_id", "event_id", at)
    clicks = t.events.where("event_type = 'click'").groupBy("user_id", at).agg(F.min("event_id").alias("v"))
    return matching.nearest_asof(views, clicks, ["user_id"], "t", "t", "v", 1_800_000_000).select("event_id", "match_value")


_LINES_SQL = """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), s AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM d GROUP BY 1),
w AS (SELECT l_orderkey, CAST(unnest(generate_series(lo, hi, 5)) AS INTEGER) AS window_start FROM s),
x AS (SELECT w.l_orderkey, w.window_start, w.window_start + k AS id, d.l_linenumber FROM w CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
  LEFT JOIN d ON d.l_orderkey = w.l_orderkey AND d.l_linenumber = w.window_start + k)
"""


@catalog.add(
    f"""{_LINES_SQL}, g AS (SELECT l_orderkey, window_start, list(id ORDER BY id) AS ids FROM x GROUP BY ALL HAVING count(l_linenumber) = 3),
    z AS (SELECT *, CAST(unnest([1, 2, 3]) AS INTEGER) AS group_size FROM g)
    SELECT l_orderkey, window_start, group_size, array_to_string(ids[-group_size:], ',') AS members FROM z"""
)
def hopping_triplets(t: Tables) -> DataFrame:
    """Complete windows of three consecutive lines, with their suffix groups."""
    groups = windows.suffix_groups(windows.hopping_groups(t.lineitem, "l_orderkey", "l_linenumber"), "l_orderkey")
    return groups.select("l_orderkey", "window_start", "group_size", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@catalog.add(
    f"""{_LINES_SQL} SELECT l_orderkey, window_start, string_agg(CASE WHEN l_linenumber IS NULL THEN id END, ',' ORDER BY id) AS missing
    FROM x GROUP BY ALL HAVING count(l_linenumber) < 3"""
)
def skipped_windows(t: Tables) -> DataFrame:
    rows = windows.hopping_groups(t.lineitem, "l_orderkey", "l_linenumber").where(F.size("missing") > 0)
    return rows.select("l_orderkey", "window_start", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@catalog.add(
    """WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, count(*) AS unique_ids,
      sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS duplicated, max(l_linenumber) AS hi FROM d GROUP BY 1)
    SELECT l_orderkey, unique_ids, CAST(duplicated AS BIGINT) AS duplicated, CAST(hi - unique_ids AS BIGINT) AS missing FROM s"""
)
def gap_summary(t: Tables) -> DataFrame:
    """Unique, duplicated and missing line numbers (from 1) per order."""
    each = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return each.groupBy("l_orderkey").agg(
        F.count("*").alias("unique_ids"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
        (F.max("l_linenumber") - F.count("*")).cast("bigint").alias("missing"),
    )


@catalog.add(
    """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), s AS (SELECT l_orderkey, unnest(generate_series(1, max(l_linenumber))) AS id FROM d GROUP BY 1)
    SELECT s.l_orderkey, CAST(s.id AS INTEGER) AS missing_id FROM s ANTI JOIN d ON d.l_orderkey = s.l_orderkey AND d.l_linenumber = s.id"""
)
def missing_lines(t: Tables) -> DataFrame:
    """Expected minus observed ids."""
    return summaries.missing_ids(t.lineitem, "l_orderkey", "l_linenumber", 1)


@catalog.add(
    """WITH o AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT user_id, CAST(island AS BIGINT) AS island, event_type, min(event_id) AS first_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, count(*) AS members
    FROM i GROUP BY ALL"""
)
def merge_contiguous(t: Tables) -> DataFrame:
    """Runs of one event type per user, fused."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = sequences.merge_islands(
        t.events, ["user_id"], ["ts", "event_id"], ["event_type"],
        [F.min("event_id").alias("first_id"), (F.max(at) - F.min(at)).alias("span_us"), F.count("*").alias("members")],
    )
    return rows.withColumn("island", F.col("island").cast("bigint"))


@catalog.add("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS position FROM events")
def global_order(t: Tables) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_type", "event_id")
    return t.events.select("event_id", "user_id", F.row_number().over(by).cast("bigint").alias("position"))


@catalog.add(
    """SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS rank,
      count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 2 AND rank <= 2"""
)
def top2_per_group(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = dedupe.top_per_group(t.events, ["user_id"], [kind, F.col("event_id")], 2, strict=True)
    return rows.select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@catalog.add(
    """WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CAST(unnest(generate_series(1, n)) AS INTEGER) AS clip_no, unnest(generate_series(1, n)) * 2.5::DOUBLE AS covers_until FROM o"""
)
def prefix_windows(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return windows.prefix_windows(counts, "n", 2.5).select("l_orderkey", "clip_no", "covers_until")


@catalog.add(
    """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
    i AS (SELECT o_custkey, unnest(CASE WHEN n <= 4 THEN generate_series(0, n - 1) ELSE list_transform([0, 1, 2, 3], lambda k: CAST(round_even(k * (n - 1) / 3, 0) AS BIGINT)) END) AS pick FROM o)
    SELECT o_custkey, CAST(pick AS INTEGER) AS pick FROM i"""
)
def even_spaced(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.select("o_custkey", F.explode(windows.even_indexes(F.col("n"), 4)).alias("pick"))


@catalog.add(
    """SELECT user_id, CAST(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 3600) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL"""
)
def fixed_buckets(t: Tables) -> DataFrame:
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1e6
    return t.events.groupBy("user_id", windows.time_bucket(at, 3600.0).alias("bucket")).agg(F.count("*").alias("n"))


@catalog.add("SELECT p_partkey, p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10 AS BIGINT) AS batch FROM part")
def batch_split(t: Tables) -> DataFrame:
    return windows.equal_batches(t.part, ["p_brand"], ["p_partkey"], 10).select("p_partkey", "p_brand", "batch")


@catalog.add(
    """SELECT p_partkey, CAST(unnest(generate_series(0, p_size - 1)) AS INTEGER) AS frame_index, round(unnest(generate_series(0, p_size - 1)) / 25.0, 6) AS frame_time FROM part WHERE p_size > 0"""
)
def frame_table(t: Tables) -> DataFrame:
    rows = windows.frame_table(t.part, "p_size", 25.0)
    return rows.select("p_partkey", "frame_index", F.round("frame_time", 6).alias("frame_time"))


@catalog.add("SELECT o_orderkey, printf('order-%09d', row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS record_id FROM orders")
def row_id(t: Tables) -> DataFrame:
    """Gapless ids over a total order."""
    return windows.global_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "record_id", "order-%09d").select("o_orderkey", "record_id")


@catalog.add("SELECT event_id FROM events ORDER BY md5(concat('7:', event_id)), event_id LIMIT 200")
def seeded_sample(t: Tables) -> DataFrame:
    return sampling.seeded_sample(t.events, "event_id", 200, 7).select("event_id")


@catalog.add(
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('7:', event_id)), event_id) AS n FROM events) WHERE n <= 3"
)
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.events, ["user_id"], "event_id", 3, 7).select("user_id", "event_id")


@catalog.add(
    """SELECT CASE WHEN grouping(user_id) = 1 THEN NULL ELSE user_id END AS user_id, count(*) AS files, count(*) FILTER (WHERE event_type = 'error') AS errors,
      round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_ratio FROM events GROUP BY ROLLUP (user_id)"""
)
def error_rollup(t: Tables) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    return t.events.rollup("user_id").agg(F.count("*").alias("files"), bad.alias("errors"), F.round(summaries.share(bad, F.count("*")), 6).alias("error_ratio"))


@catalog.add(
    """SELECT event_type, count(value) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value,
      round(stddev_pop(value), 6) AS std_value, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(sum(value), 4) AS total
    FROM events GROUP BY event_type"""
)
def numeric_summary(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*summaries.nine_numbers("value"))


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (record_id) * FROM duration_records), v AS (SELECT * FROM d WHERE isfinite(duration_seconds) AND duration_seconds >= 0)
    SELECT dataset, utt_count, count(*) AS n, round(avg(duration_seconds), 6) AS mean_value, round(quantile_cont(duration_seconds, 0.5), 6) AS median_value,
      min(duration_seconds) AS min_value, max(duration_seconds) AS max_value FROM v GROUP BY GROUPING SETS ((dataset, utt_count), (utt_count), ())"""
)
def duration_levels(t: Tables) -> DataFrame:
    """Durations by dataset and size, by size, and over all."""
    d = F.col("duration_seconds")
    rows = t.duration_records.select("record_id", "dataset", "utt_count", "duration_seconds").dropDuplicates(["record_id"]).where((F.abs(d) < float("inf")) & (d >= 0))
    return summaries.grouping_sets(
        rows,
        [["dataset", "utt_count"], ["utt_count"], []],
        [F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_value"), F.round(F.percentile(d, 0.5), 6).alias("median_value"), F.min(d).alias("min_value"), F.max(d).alias("max_value")],
    )


@catalog.add(
    r"""WITH u AS (SELECT DISTINCT ON (utterance_id) * FROM utterances), w AS (SELECT interaction_id, unnest(words) AS w FROM u),
    d AS (SELECT interaction_id, w.end_s - w.start_s AS d, w.end_s AS e FROM w WHERE w.end_s > w.start_s)
    SELECT interaction_id, round(max(e), 3) AS length_s, count(*) FILTER (WHERE round(d, 6) > 4.0) AS flagged,
      round(coalesce(sum(d) FILTER (WHERE round(d, 6) <= 4.0), 0), 3) AS speech_s FROM d GROUP BY 1"""
)
def overlap_stats(t: Tables) -> DataFrame:
    """Length, overlong words and speech time of interactions."""
    words = t.utterances.select("utterance_id", "interaction_id", "words").dropDuplicates(["utterance_id"])
    w = words.select("interaction_id", F.explode("words").alias("w")).select(
        "interaction_id", (F.col("w.end_s") - F.col("w.start_s")).alias("d"), F.col("w.end_s").alias("e")
    )
    long = F.round("d", 6) > 4.0
    return w.where("d > 0").groupBy("interaction_id").agg(
        F.round(F.max("e"), 3).alias("length_s"),
        F.count_if(long).alias("flagged"),
        F.round(F.coalesce(F.sum(F.when(~long, F.col("d"))), F.lit(0.0)), 3).alias("speech_s"),
    )


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (doc_id) * FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL THEN 'missing_text' WHEN trim(text) = '' THEN 'blank_text' WHEN lang IS NULL THEN 'missing_lang'
      WHEN n_chars IS NULL OR n_chars <> length(text) THEN 'wrong_length' END AS reject_reason FROM d"""
)
def waterfall_filter(t: Tables) -> DataFrame:
    """The first check that a document fails."""
    checks = [
        ("missing_text", F.col("text").isNull()),
        ("blank_text", F.trim("text") == ""),
        ("missing_lang", F.col("lang").isNull()),
        ("wrong_length", F.col("n_chars").isNull() | (F.col("n_chars") != F.length("text"))),
    ]
    return matching.waterfall(t.documents, checks).select("doc_id", "reject_reason")


@catalog.add(
    """WITH g AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1)
    SELECT o_custkey, total, CASE WHEN ok = total THEN 'all' WHEN ok > 0 THEN 'some' WHEN open = total THEN 'none' ELSE 'mixed' END AS state FROM g"""
)
def status_rollup(t: Tables) -> DataFrame:
    """Group status by precedence over counts."""
    g = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.count_if(F.col("o_orderstatus") == "O").alias("open")
    )
    state = F.when(F.col("ok") == F.col("total"), "all").when(F.col("ok") > 0, "some").when(F.col("open") == F.col("total"), "none").otherwise("mixed")
    return g.select("o_custkey", "total", state.alias("state"))


@catalog.add("SELECT user_id FROM events WHERE event_type IN ('signup', 'error', 'click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def required_set(t: Tables) -> DataFrame:
    return matching.all_siblings(t.events, "user_id", "event_type", ["signup", "error", "click", "view", "purchase"])


@catalog.add(
    "SELECT l_orderkey, count(*) AS lines, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1 HAVING count(*) = max(l_linenumber) AND count(DISTINCT l_linenumber) = count(*)"
)
def completeness_filter(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_linenumber").alias("last_line"), F.countDistinct("l_linenumber").alias("ids"))
    return g.where("lines = last_line AND ids = lines").select("l_orderkey", "lines", "last_line")


@catalog.add(
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, round(avg(c_acctbal), 4) AS mean_c FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
    SELECT k AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, mean_c FROM c FULL JOIN s USING (k)"""
)
def full_outer_bins(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_c"))
    s = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").na.fill(0, ["customers", "suppliers"]).select("nation", "customers", "suppliers", "mean_c")


@catalog.add("SELECT s_nationkey, s_name FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n = 1")
def exactly_one_lookup(t: Tables) -> DataFrame:
    return matching.exactly_one(t.supplier, "s_nationkey", "s_name")


@catalog.add(
    """WITH s AS (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1), p AS (SELECT s_suppkey AS k, min(s_name) AS v FROM supplier GROUP BY 1)
    SELECT c_custkey, coalesce(p.v, s.v) AS hit FROM customer LEFT JOIN p ON p.k = c_custkey LEFT JOIN s ON s.k = c_nationkey"""
)
def fallback_join(t: Tables) -> DataFrame:
    """The supplier of the same number, else one of the same nation."""
    c = t.customer.withColumn("wide", F.col("c_nationkey").cast("bigint"))
    s = t.supplier.withColumn("nation", F.col("s_nationkey").cast("bigint"))
    return matching.first_hit(c, s, [("c_custkey", "s_suppkey"), ("wide", "nation")], "s_name", "hit").select("c_custkey", "hit")


@catalog.add(
    r"""WITH v AS (SELECT DISTINCT regexp_extract(video_path, '([^/]+)\.[^.]+$', 1) AS stem FROM video_timings WHERE video_path IS NOT NULL),
    a AS (SELECT DISTINCT regexp_extract(audio_path, '([^/]+)\.[^.]+$', 1) AS stem FROM video_timings WHERE audio_path IS NOT NULL)
    SELECT stem, a.stem IS NOT NULL AS has_audio FROM v LEFT JOIN a USING (stem)""".replace("SELECT stem, a.stem", "SELECT v.stem AS stem, a.stem")
)
def same_stem(t: Tables) -> DataFrame:
    """Videos with and without a sound file of the same stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^.]+$", 1).alias("stem")
    v = t.video_timings.where("video_path IS NOT NULL").select(stem("video_path")).distinct()
    a = t.video_timings.where("audio_path IS NOT NULL").select(stem("audio_path")).distinct().withColumn("has_audio", F.lit(True))
    return v.join(a, "stem", "left").na.fill(False, ["has_audio"])


@catalog.add(
    """SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL
    SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def semi_anti(t: Tables) -> DataFrame:
    held = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    kinds = (("left_semi", "with"), ("left_anti", "without"))
    a, b = (t.customer.select("c_custkey").join(held, "c_custkey", how).withColumn("kind", F.lit(k)) for how, k in kinds)
    return a.unionByName(b)


@catalog.add(
    """SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL
    SELECT 'all', k FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region)"""
)
def set_ops(t: Tables) -> DataFrame:
    c, s = t.customer.select(F.col("c_nationkey").alias("k"), "c_acctbal"), t.supplier.select(F.col("s_nationkey").alias("k"), "s_acctbal")
    parts = {
        "both": c.where("c_acctbal > 5000").select("k").intersect(s.select("k")),
        "left": c.select("k").subtract(s.where("s_acctbal > 5000").select("k")),
        "all": t.nation.select(F.col("n_regionkey").alias("k")).unionAll(t.region.select("r_regionkey")),
    }
    both, left, every = (df.select(F.lit(name).alias("part"), "k") for name, df in parts.items())
    return both.unionByName(left).unionByName(every)


@catalog.add("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1")
def distinct_first(t: Tables) -> DataFrame:
    rows = dedupe.first_per_key(t.events.select("event_type", "event_id"), ["event_type"], [F.col("event_id")])
    return rows.select("event_type", F.col("event_id").alias("first_id"))


@catalog.add(
    r"""SELECT c_custkey, row_number() OVER (ORDER BY coalesce(CAST(nullif(regexp_extract(c_name, '(\d+)$', 1), '') AS BIGINT), 1000000000), c_name) AS place FROM customer"""
)
def natural_sort(t: Tables) -> DataFrame:
    """Place in the order of trailing numbers, then text."""
    rows = t.customer.select("c_custkey", "c_name", text.trailing_number(F.col("c_name"), 10**9).alias("n"))
    placed = windows.global_ids(rows, ["n", "c_name"], "place", "%d")
    return placed.select("c_custkey", (F.col("place").cast("bigint") + 1).alias("place"))


@catalog.add(
    r"""WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS key FROM part)
    SELECT p_partkey, dense_rank() OVER (ORDER BY TRY_CAST(key AS BIGINT) IS NULL, TRY_CAST(key AS BIGINT), key) AS place FROM k"""
)
def mixed_key_sort(t: Tables) -> DataFrame:
    """Numeric keys first by value, then the others as text: ranks of distinct keys."""
    key = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    rows = t.part.select("p_partkey", key.alias("key"))
    number = F.col("key").try_cast("bigint")
    keys = rows.select("key").distinct().withColumn("place", F.dense_rank().over(Window.orderBy(number.isNull(), number, "key")).cast("bigint"))
    return rows.join(keys, "key").select("p_partkey", "place")


@catalog.add(
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 9 END AS place FROM events"""
)
def domain_rank(t: Tables) -> DataFrame:
    order = ["signup", "view", "click", "purchase"]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("event_type")).cast("int") - 1
    return t.events.select("event_id", F.when(rank < 0, 9).otherwise(rank).alias("place"))


@catalog.add("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50")
def offset_limit(t: Tables) -> DataFrame:
    """The first retained rows of an index range."""
    return t.orders.where("o_orderkey BETWEEN 100 AND 5000 AND o_orderstatus = 'O'").orderBy("o_orderkey").limit(50).select("o_orderkey")


@catalog.add("SELECT n_regionkey, n_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name LIKE 'I%', lower(n_name)) AS rank FROM nation) WHERE rank <= 3")
def topn_children(t: Tables) -> DataFrame:
    rows = dedupe.top_per_group(t.nation, ["n_regionkey"], [F.col("n_name").like("I%"), F.lower("n_name")], 3)
    return rows.select("n_regionkey", "n_name", F.col("rank").cast("bigint").alias("rank"))


@catalog.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS first_text FROM events")
def json_fields(t: Tables) -> DataFrame:
    from strandline.functions.documents import first_text

    doc = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(doc, "$.k", "bigint").alias("k"), first_text(doc, "$.missing", "$.k").alias("first_text"))


@catalog.add(
    """WITH r AS (SELECT DISTINCT ON (response_id) * FROM selected_responses)
    SELECT response_id, CASE WHEN lower(trim(submitted)) IN ('1', 'true', 'yes', 'y') THEN TRUE WHEN lower(trim(submitted)) IN ('0', 'false', 'no', 'n') THEN FALSE
      WHEN isfinite(TRY_CAST(trim(submitted) AS DOUBLE)) THEN TRY_CAST(trim(submitted) AS DOUBLE) <> 0 END AS flag,
      coalesce(lower(trim(submitted)) = 'true', FALSE) AS narrow FROM r"""
)
def submitted_flags(t: Tables) -> DataFrame:
    """Two readings of a loosely spelled flag."""
    rows = t.selected_responses.select("response_id", "submitted").dropDuplicates(["response_id"])
    return rows.select("response_id", casts.to_bool(F.col("submitted")).alias("flag"), casts.submitted_narrow(F.col("submitted")).alias("narrow"))


@catalog.add(
    rf"""WITH r AS (SELECT DISTINCT ON (response_id) * FROM selected_responses WHERE lower(trim(submitted)) IN ('1', 'true', 'yes', 'y')
      OR (isfinite(TRY_CAST(trim(submitted) AS DOUBLE)) AND TRY_CAST(trim(submitted) AS DOUBLE) <> 0)),
    p AS (SELECT *, regexp_extract(created, '{casts.CREATED}', ['d', 'c', 's', 'f']) AS m FROM r),
    t AS (SELECT *, coalesce(epoch_us(TRY_CAST(m.d || ' ' || coalesce(nullif(m.c, ''), '00:00') || ':' || coalesce(nullif(m.s, ''), '00') AS TIMESTAMP))
      + CAST(rpad(substr(m.f, 1, 6), 6, '0') AS BIGINT), {casts.NEVER_US}) AS made FROM p)
    SELECT recording_id, node_id, arg_max(response_id, struct_pack(a := made, b := response_index, c := response_id)) AS response_id FROM t GROUP BY ALL"""
)
def latest_response(t: Tables) -> DataFrame:
    """The submitted response of each node that was created last, then of the highest index."""
    rows = t.selected_responses.where(casts.submitted_wide(F.col("submitted"))).dropDuplicates(["response_id"])
    rank = [casts.created_wall_us(F.col("created")), F.col("response_index"), F.col("response_id")]
    return dedupe.best_per_key(rows, ["recording_id", "node_id"], rank).select("recording_id", "node_id", "response_id")


@catalog.add(
    r"""WITH d AS (SELECT DISTINCT ON (timing_id) * FROM video_timings)
    SELECT timing_id, nullif(regexp_extract(video_path, '(task\d+)/', 1), '') AS task, CAST(nullif(regexp_extract(video_path, '/b(\d+)/', 1), '') AS INTEGER) AS batch,
      CAST(nullif(regexp_extract(video_path, '/d(\d+)u\d+[^/]*$', 1), '') AS INTEGER) AS dialogue, CAST(nullif(regexp_extract(video_path, '_clip_?(\d+)\.[^.]+$', 1), '') AS INTEGER) AS clip_index,
      lower(nullif(regexp_extract(video_path, '\.([^./]+)$', 1), '')) AS extension FROM d"""
)
def path_parse(t: Tables) -> DataFrame:
    """Parts of media paths as columns."""
    rows = t.video_timings.select("timing_id", "video_path").dropDuplicates(["timing_id"])
    layout = text.media_layout(F.col("video_path"))
    return rows.select("timing_id", *[layout[c].alias(c) for c in ("task", "batch", "dialogue", "clip_index", "extension")])


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (timing_id) * FROM video_timings)
    SELECT timing_id, CASE WHEN starts_with(video_path, 'media/task1/') THEN '/data/one/' || substr(video_path, 13)
      WHEN starts_with(video_path, 'media/') THEN '/data/' || substr(video_path, 7) ELSE video_path END AS local_path FROM d"""
)
def url_rebase(t: Tables) -> DataFrame:
    rows = t.video_timings.select("timing_id", "video_path").dropDuplicates(["timing_id"])
    return rows.select("timing_id", text.rebase(F.col("video_path"), {"media/task1/": "/data/one/", "media/": "/data/"}).alias("local_path"))


@catalog.add(
    r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'record') AS safe,
      p_brand || '/' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS label FROM part"""
)
def label_compose(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.sanitise(F.col("p_name")).alias("safe"), F.concat("p_brand", F.lit("/"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("label"))


@catalog.add(
    """WITH p AS (SELECT event_id, value / 100 AS x, (event_id % 100) / 100 AS y FROM events)
    SELECT event_id, round(x + 0.5 - floor(x + 0.5), 6) AS shifted, CASE WHEN abs(x - 0.5) > 0.1 AND abs(y - 0.5) > 0.1 THEN
      (CASE WHEN y < 0.5 THEN 'top' ELSE 'bottom' END) || '-' || (CASE WHEN x < 0.5 THEN 'left' ELSE 'right' END) END AS quadrant,
      CASE WHEN (y - 0.125) / 0.75 BETWEEN -1e-9 AND 1 + 1e-9 AND x BETWEEN -1e-9 AND 1 + 1e-9 THEN round(greatest(0, least(1, (y - 0.125) / 0.75)), 6) END AS video_y FROM p"""
)
def coordinates(t: Tables) -> DataFrame:
    """Half-screen shift, quadrant and letterbox mapping of points."""
    x, y = F.col("value") / 100, (F.col("event_id") % 100) / 100
    mapped = geometry.screen_to_video(x, y, 4 / 3, 16 / 9)
    return t.events.select(
        "event_id",
        F.round(geometry.control_shift(x), 6).alias("shifted"),
        F.when((F.abs(x - 0.5) > 0.1) & (F.abs(y - 0.5) > 0.1), geometry.quadrant(x, y)).alias("quadrant"),
        F.round(mapped["y"], 6).alias("video_y"),
    )


@catalog.add(
    """WITH u AS (SELECT DISTINCT ON (utterance_id) * FROM utterances WHERE isfinite(start_s) AND isfinite(end_s))
    SELECT utterance_id, greatest(0, least(start_s, 60.0)) AS s, greatest(greatest(0, least(start_s, 60.0)), least(end_s, 60.0)) AS e,
      CASE WHEN greatest(greatest(0, least(start_s, 60.0)), least(end_s, 60.0)) - greatest(0, least(start_s, 60.0)) < 1.5 THEN 'too_short' ELSE 'written' END AS status FROM u"""
)
def clamp_intervals(t: Tables) -> DataFrame:
    rows = t.utterances.select("utterance_id", "start_s", "end_s").dropDuplicates(["utterance_id"])
    rows = rows.where((F.abs("start_s") < float("inf")) & (F.abs("end_s") < float("inf")))
    cut = rows.withColumn("c", geometry.clamp_interval(F.col("start_s"), F.col("end_s"), F.lit(60.0)))
    status = F.when(F.col("c.end") - F.col("c.start") < 1.5, "too_short").otherwise("written")
    return cut.select("utterance_id", F.col("c.start").alias("s"), F.col("c.end").alias("e"), status.alias("status"))


@catalog.add(
    """WITH u AS (SELECT DISTINCT ON (utterance_id) * FROM utterances WHERE words IS NOT NULL)
    SELECT utterance_id, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words).word AS word FROM u"""
)
def unnest_ordinality(t: Tables) -> DataFrame:
    """Elements of nested lists with their position."""
    rows = t.utterances.select("utterance_id", "words").dropDuplicates(["utterance_id"])
    return rows.select("utterance_id", F.posexplode("words.word").alias("pos", "word"))


@catalog.add(
    """WITH g AS (SELECT user_id, string_agg(event_type || ':' || event_id, ',' ORDER BY ts, event_id) AS trail FROM events GROUP BY 1) SELECT * FROM g"""
)
def nested_collect(t: Tables) -> DataFrame:
    """Ordered members of each group as one text."""
    item = F.struct("ts", "event_id", F.concat("event_type", F.lit(":"), "event_id").alias("s"))
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return g.select("user_id", F.array_join("items.s", ",").alias("trail"))


@catalog.add("SELECT CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def bin_stats(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy(F.floor(v / 10).alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean_value"), F.round(F.stddev_pop(v), 6).alias("std_value"), F.round(F.median(v), 6).alias("median_value")
    )


@catalog.add(
    """WITH g AS (SELECT DISTINCT ON (sample_id) * FROM gaze_samples), v AS (SELECT *, isfinite(x_norm) AND isfinite(y_norm) AND x_norm BETWEEN 0 AND 1 AND y_norm BETWEEN 0 AND 1 AS ok FROM g)
    SELECT recording_id, count(*) AS raw_n, count(*) FILTER (WHERE ok) AS on_screen, round(avg(x_norm) FILTER (WHERE ok), 6) AS mean_x, round(avg(y_norm) FILTER (WHERE ok), 6) AS mean_y FROM v GROUP BY 1"""
)
def centroid(t: Tables) -> DataFrame:
    """Gaze samples on screen and their centroid, per recording."""
    ok = F.col("x_norm").between(0, 1) & F.col("y_norm").between(0, 1) & ~F.isnan("x_norm") & ~F.isnan("y_norm")
    rows = t.gaze_samples.select("sample_id", "recording_id", "x_norm", "y_norm").dropDuplicates(["sample_id"])
    return rows.groupBy("recording_id").agg(
        F.count("*").alias("raw_n"), F.count_if(ok).alias("on_screen"),
        F.round(F.avg(F.when(ok, F.col("x_norm"))), 6).alias("mean_x"), F.round(F.avg(F.when(ok, F.col("y_norm"))), 6).alias("mean_y"),
    )


@catalog.add(
    """WITH g AS (SELECT DISTINCT ON (sample_id) * FROM gaze_samples)
    SELECT sample_id, coalesce(TRY_CAST(trim(confidence) AS DOUBLE), 1.0) AS confidence FROM g
    WHERE coalesce(lower(trim(on_surf)), '') NOT IN ('0', 'false', 'no') AND x_norm BETWEEN 0 AND 1 AND y_norm BETWEEN 0 AND 1
      AND coalesce(TRY_CAST(trim(confidence) AS DOUBLE), 1.0) >= 0.6 AND NOT isnan(coalesce(TRY_CAST(trim(confidence) AS DOUBLE), 1.0))
      AND NOT isnan(x_norm) AND NOT isnan(y_norm)"""
)
def gaze_filter(t: Tables) -> DataFrame:
    """Samples on the surface and screen with enough confidence; a missing one counts as 1."""
    conf = F.coalesce(F.trim("confidence").try_cast("double"), F.lit(1.0))
    on = ~F.coalesce(F.lower(F.trim("on_surf")), F.lit("")).isin("0", "false", "no")
    inside = F.col("x_norm").between(0, 1) & F.col("y_norm").between(0, 1) & ~F.isnan("x_norm") & ~F.isnan("y_norm")
    rows = t.gaze_samples.where(on & inside & (conf >= 0.6) & ~F.isnan(conf))
    return rows.select("sample_id", conf.alias("confidence")).dropDuplicates(["sample_id"])


@catalog.add("SELECT doc_kind, count(*) AS n FROM documents GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy("doc_kind").agg(F.count("*").alias("n"))


@catalog.add("SELECT l_returnflag, l_linestatus, count(*) AS n, bool_and(l_quantity >= 1) AS all_valid FROM lineitem GROUP BY ALL")
def partition_counts(t: Tables) -> DataFrame:
    """Members per part and whether all of them are valid."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.bool_and(F.col("l_quantity") >= 1).alias("all_valid"))


@catalog.add(
    """SELECT o.o_orderkey, c.c_name, c.c_custkey IS NOT NULL AS has_customer, coalesce(n.n_name, '') AS nation FROM orders o
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""
)
def left_lookups(t: Tables) -> DataFrame:
    """Dimension lookups with a flag and a default."""
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    rows = t.orders.join(c, "o_custkey", "left").join(t.nation, "n_nationkey", "left")
    return rows.select("o_orderkey", "c_name", F.col("c_name").isNotNull().alias("has_customer"), F.coalesce("n_name", F.lit("")).alias("nation"))


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (doc_id) * FROM documents)
    SELECT doc_id, CASE WHEN starts_with(lower(source), 'annot') THEN 'test' WHEN starts_with(lower(source), 'f') OR starts_with(lower(source), 'g') THEN 'train' END AS split FROM d"""
)
def prefix_split(t: Tables) -> DataFrame:
    """Split by prefixes; the first list wins, neither gives NULL."""
    s = F.lower("source")
    split = F.when(s.startswith("annot"), "test").when(s.startswith("f") | s.startswith("g"), "train")
    return t.documents.select("doc_id", split.alias("split"))


@catalog.add(
    """SELECT r.recording_id, count(g.sample_id) AS samples, count(g.sample_id) > 0 AS has_gaze FROM (SELECT DISTINCT ON (recording_id) * FROM recordings) r
    LEFT JOIN (SELECT DISTINCT ON (sample_id) * FROM gaze_samples) g USING (recording_id) GROUP BY 1"""
)
def recordings_with_gaze(t: Tables) -> DataFrame:
    """Left outer join with a presence flag; samples are counted before the join."""
    n = t.gaze_samples.select("sample_id", "recording_id").dropDuplicates(["sample_id"]).groupBy("recording_id").agg(F.count("*").alias("samples"))
    r = t.recordings.select("recording_id").distinct()
    return r.join(n, "recording_id", "left").na.fill(0, ["samples"]).withColumn("has_gaze", F.col("samples") > 0)


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (timing_id) * FROM video_timings), r AS (SELECT DISTINCT ON (response_id) * FROM selected_responses)
    SELECT d.timing_id, r.node_id, abs(d.video_length - d.current_video_time) > 0.5 AS duration_mismatch,
      d.video_start_time <> '' AND d.video_end_time <> '' AS has_timing FROM d JOIN r USING (response_id)"""
)
def timing_checks(t: Tables) -> DataFrame:
    """Timings with their response, a tolerance check that drops nothing and a validity flag."""
    d = t.video_timings.select("timing_id", "response_id", "video_length", "current_video_time", "video_start_time", "video_end_time").dropDuplicates(["timing_id"])
    r = t.selected_responses.select("response_id", "node_id").dropDuplicates(["response_id"])
    return d.join(r, "response_id").select(
        "timing_id", "node_id", (F.abs(F.col("video_length") - F.col("current_video_time")) > 0.5).alias("duration_mismatch"),
        ((F.col("video_start_time") != "") & (F.col("video_end_time") != "")).alias("has_timing"),
    )


@catalog.add(
    """SELECT event_id, epoch_us(ts) / 1e6 + 12.5 AS shifted_s, CAST(ts AS DATE) AS day, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS second_of_day FROM events"""
)
def clock_align(t: Tables) -> DataFrame:
    """Epoch seconds on a shifted clock, and the second of the day."""
    part = lambda f: f("ts").cast("bigint")
    second = part(F.hour) * 3600 + part(F.minute) * 60 + part(F.second)
    return t.events.select("event_id", (_seconds("ts") + 12.5).alias("shifted_s"), F.to_date("ts").alias("day"), second.alias("second_of_day"))


@catalog.add(
    r"""SELECT n_nationkey, regexp_replace(regexp_replace(n_name || ' ' || n_nationkey || ' of 7', '(^|[^0-9])([0-9])($|[^0-9])', '\10\2\3', 'g'),
      '(^|[^0-9])([0-9])($|[^0-9])', '\10\2\3', 'g') AS padded,
      'Nation ' || n_name || ' in {region}' AS rendered FROM nation"""
)
def templates(t: Tables) -> DataFrame:
    """Padded numbers, and a template with a place that stays open."""
    label = F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string"), F.lit("of 7"))
    return t.nation.select("n_nationkey", text.pad_single_digits(label).alias("padded"), text.render("Nation {name} in {region}", {"name": F.col("n_name")}).alias("rendered"))


@catalog.add(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS left_item, round(unnest(list_reverse(v)), 6) AS right_item FROM e"""
)
def zip_join(t: Tables) -> DataFrame:
    """The i-th element of one list with the i-th of another of equal length."""
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = t.embeddings.select("vec_id", F.reverse(F.col("embedding").cast("array<double>")).alias("b"))
    rows = matching.positional_join(a, b, ["vec_id"], "a", "b")
    return rows.select("vec_id", "pos", F.round("left_item", 6).alias("left_item"), F.round("right_item", 6).alias("right_item"))


@catalog.add(
    """WITH v AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type IN ('view', 'click'))
    SELECT user_id, count(*) AS points, string_agg(event_id, ',' ORDER BY t, event_id) AS merged FROM v GROUP BY 1"""
)
def grouped_array_merge(t: Tables) -> DataFrame:
    """Ordered arrays of two sources concatenated and sorted again by time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    one = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.collect_list(F.struct(at.alias("t"), "event_id")).alias("p"))
    both = one("view").unionByName(one("click")).groupBy("user_id").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    return both.select("user_id", F.size("p").cast("bigint").alias("points"), F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ",").alias("merged"))


@catalog.add(
    """SELECT l.l_orderkey, l.l_linenumber, CAST(e.embedding[(l.l_partkey % 64) + 1] AS DOUBLE) AS value FROM lineitem l JOIN embeddings e ON e.vec_id = l.l_suppkey"""
)
def time_index_lookup(t: Tables) -> DataFrame:
    """An array element looked up by a position computed from the row."""
    e = t.embeddings.select(F.col("vec_id").alias("l_suppkey"), "embedding")
    at = F.get("embedding", (F.col("l_partkey") % 64).cast("int")).cast("double")
    return t.lineitem.join(e, "l_suppkey").select("l_orderkey", "l_linenumber", at.alias("value"))


@catalog.add(
    """WITH d AS (SELECT DISTINCT ON (timing_id) * FROM video_timings)
    SELECT recording_id, arg_max(timing_id, struct_pack(a := coalesce(time_annot, -1), b := -timing_id)) AS timing_id, round(max(coalesce(time_annot, -1)), 6) AS time_annot FROM d GROUP BY 1"""
)
def latest_nested(t: Tables) -> DataFrame:
    """The entry of the greatest annotation time; a missing one counts as -1, the first of equals wins."""
    rows = t.video_timings.select("timing_id", "recording_id", F.coalesce("time_annot", F.lit(-1.0)).alias("time_annot")).dropDuplicates(["timing_id"])
    best = dedupe.best_per_key(rows, ["recording_id"], [F.col("time_annot"), -F.col("timing_id")])
    return best.select("recording_id", "timing_id", F.round("time_annot", 6).alias("time_annot"))


@catalog.add(
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS customer, CAST(o_totalprice AS BIGINT) AS price, CAST(NULL AS VARCHAR) AS note FROM (
      SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders
      WHERE o_orderkey >= 200 AND o_orderkey < 3000 AND o_orderstatus IN ('F', 'O') AND NOT contains(o_orderpriority, 'LOW'))"""
)
def basic_filters(t: Tables) -> DataFrame:
    """Block range, value list and excluded substring, then a typed projection."""
    from pyspark.sql import types as T

    from strandline.operators.annotations import conform

    rows = t.orders.where("o_orderkey >= 200 AND o_orderkey < 3000").where(F.col("o_orderstatus").isin("F", "O"))
    rows = rows.where(~matching.any_of([F.col("o_orderpriority").contains("LOW")])).withColumnsRenamed({"o_custkey": "customer"})
    schema = T.StructType([T.StructField("customer", T.IntegerType()), T.StructField("price", T.LongType()), T.StructField("note", T.StringType())])
    return conform(rows.withColumn("price", F.floor("o_totalprice")), schema, "o_orderkey")


@catalog.add(
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS customer, CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(NULL AS VARCHAR) AS note
    FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT contains(o_orderpriority, 'LOW')"""
)
def order_filters(t: Tables) -> DataFrame:
    """Value list and excluded substring over all orders, then a typed projection."""
    from pyspark.sql import types as T

    from strandline.operators.annotations import conform

    rows = t.orders.where(F.col("o_orderstatus").isin("F", "O"))
    rows = rows.where(~matching.any_of([F.col("o_orderpriority").contains("LOW")])).withColumnsRenamed({"o_custkey": "customer"})
    schema = T.StructType([T.StructField("customer", T.IntegerType()), T.StructField("price", T.LongType()), T.StructField("note", T.StringType())])
    return conform(rows.withColumn("price", F.floor("o_totalprice")), schema, "o_orderkey")


@catalog.add(
    """WITH g AS (SELECT interaction_id, utterance_id, speaker_role, start_s FROM (SELECT DISTINCT ON (utterance_id) * FROM utterances) WHERE start_s IS NOT NULL)
    SELECT utterance_id, CAST(ceil(start_s / 120) AS BIGINT) AS segment, row_number() OVER (PARTITION BY interaction_id, CAST(ceil(start_s / 120) AS BIGINT) ORDER BY start_s, utterance_id) AS place FROM g"""
)
def segments(t: Tables) -> DataFrame:
    """Right-closed time segments of an interaction and the order within them."""
    rows = t.utterances.where("start_s IS NOT NULL").select("utterance_id", "interaction_id", "start_s").dropDuplicates(["utterance_id"])
    rows = rows.withColumn("segment", windows.time_bucket(F.col("start_s")))
    by = Window.partitionBy("interaction_id", "segment").orderBy("start_s", "utterance_id")
    return rows.select("utterance_id", "segment", F.row_number().over(by).cast("bigint").alias("place"))


@catalog.add(
    """WITH p AS (SELECT doc_id, lang, n_chars, length(text) AS n FROM (SELECT DISTINCT ON (doc_id) * FROM documents))
    SELECT lang, count(*) AS documents, count(n) AS valid, count(*) - count(n) AS empty, round(count(n) / (count(*) + 1e-6), 6) AS valid_share FROM p GROUP BY ROLLUP (lang)"""
)
def annotation_stats(t: Tables) -> DataFrame:
    """Valid and null members per group and over all, with a guarded ratio."""
    n = F.length("text")
    return t.documents.select("lang", "text").rollup("lang").agg(
        F.count("*").alias("documents"), F.count(n).alias("valid"), (F.count("*") - F.count(n)).alias("empty"), F.round(F.count(n) / (F.count("*") + 1e-6), 6).alias("valid_share")
    )

"""Queries over frame rows and manifests: voice activity, temporal features, splits, joins by path, set checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import nearest_index, portable_hash
from ..operators import frames as fr
from ..sources import tables as src
from .registry import query, rounded
from .statistics import FR, MAN

SEC = "160 / 16000"
RUNS = f"{FR}, g AS (SELECT rec_id, frame, speech, row_number() OVER (PARTITION BY rec_id ORDER BY frame) - row_number() OVER (PARTITION BY rec_id, speech ORDER BY frame) AS g FROM fr), runs AS (SELECT rec_id, speech, min(frame) AS first, count(*) AS length FROM g GROUP BY rec_id, speech, g)"


@query(f"WITH {FR}, d AS (SELECT *, 20 * log10(greatest(value / 500, 1e-10)) AS db FROM fr) SELECT rec_id, frame, db > greatest(max(db) OVER (PARTITION BY rec_id) - 40, -60) AS speech FROM d")
def v2_energy_gate(spark, folder):
    """V2: energy gate of each frame."""
    f = src.frames(spark, folder).withColumn("rms", F.col("value") / 500)
    return fr.energy_gate(f.select("rec_id", "frame", "rms"), "rms").select("rec_id", "frame", "speech")


@query(f"WITH {FR}, n AS (SELECT rec_id, count(*) AS n FROM fr GROUP BY rec_id), o AS (SELECT f.rec_id, f.frame, unnest(range(f.frame - 5, f.frame + 6)) AS p, n FROM fr f JOIN n USING (rec_id)), m AS (SELECT rec_id, frame, CASE WHEN p < 0 THEN -1 - p WHEN p >= n THEN 2 * n - 1 - p ELSE p END AS p FROM o) SELECT m.rec_id, m.frame, sum(fr.speech::INT) >= 6 AS smooth FROM m JOIN fr ON fr.rec_id = m.rec_id AND fr.frame = m.p GROUP BY ALL")
def v3_median_mask(spark, folder):
    """Median of 11 with mirrored edges."""
    return fr.median_mask(src.frames(spark, folder).select("rec_id", "frame", "speech")).select("rec_id", "frame", "smooth")


@query(f"WITH {FR} SELECT rec_id, round(count(*) * {SEC}, 6) AS total_duration_sec, round(sum(speech::INT) * {SEC}, 6) AS speech_duration_sec, round(avg(speech::INT), 6) AS speech_ratio, count(*)::INT AS n_frames, sum(speech::INT)::INT AS n_speech_frames FROM fr GROUP BY rec_id")
def v4_durations(spark, folder):
    """Durations of recordings."""
    return rounded(fr.durations(src.frames(spark, folder), "speech"))


@query(f"WITH {FR}, d AS (SELECT rec_id, count(*) * {SEC} - (rec_id % 3) AS t, sum(speech::INT) * {SEC} AS s, avg(speech::INT) + rec_id % 2 AS r FROM fr GROUP BY rec_id), p AS (SELECT rec_id, list_filter([CASE WHEN t < 0 OR s < 0 THEN 'negative' END, CASE WHEN r > 1.0001 THEN 'ratio' END, CASE WHEN s > t + 0.001 THEN 'longer' END], lambda x: x IS NOT NULL) AS p FROM d) SELECT rec_id, array_to_string(p, ',') AS problems FROM p WHERE len(p) > 0")
def v7_duration_problems(spark, folder):
    """V7: contradicting durations, on durations that are made to contradict."""
    d = fr.durations(src.frames(spark, folder), "speech")
    d = d.withColumn("total_duration_sec", F.col("total_duration_sec") - F.col("rec_id") % 3).withColumn("speech_ratio", F.col("speech_ratio") + F.col("rec_id") % 2)
    return fr.duration_problems(d).select("rec_id", F.concat_ws(",", "problems").alias("problems"))


@query(f"WITH {RUNS} SELECT rec_id, speech, first, length FROM runs")
def w8_run_lengths(spark, folder):
    """Runs of speech and silence."""
    return fr.runs(src.frames(spark, folder), "speech")


@query(f"WITH {RUNS}, x AS (SELECT *, NOT speech AND lag(length) OVER w IS NOT NULL AND lead(length) OVER w IS NOT NULL AS pause FROM runs WINDOW w AS (PARTITION BY rec_id ORDER BY first)) SELECT rec_id, round(coalesce(avg(length * {SEC}) FILTER (pause), 0), 6) AS pause_mean, round(coalesce(max(length * {SEC}) FILTER (pause), 0), 6) AS pause_longest, round(count(*) FILTER (pause) / sum(length * {SEC}), 6) AS pause_rate, round(coalesce(avg(length * {SEC}) FILTER (speech), 0), 6) AS segment_mean FROM x GROUP BY rec_id")
def gf_temporal_dynamics(spark, folder):
    """Temporal dynamics (§2.10): pauses and segments."""
    return rounded(fr.pauses(src.frames(spark, folder), "speech"))


@query(f"WITH {FR}, o AS (SELECT rec_id, (speech AND NOT coalesce(lag(speech) OVER (PARTITION BY rec_id ORDER BY frame), false))::INT AS o FROM fr) SELECT rec_id, round(CASE WHEN count(*) * {SEC} < 0.1 THEN 0 ELSE sum(o) / (count(*) * {SEC}) END, 6) AS onset_rate FROM o GROUP BY rec_id")
def gf_speech_rate(spark, folder):
    """Speech rate (§2.10), W9: onsets per second."""
    return rounded(fr.onset_rate(src.frames(spark, folder), "speech"))


@query(f"WITH {FR}, x AS (SELECT rec_id, value, (value > 3 * lag(value) OVER w AND value > 3 * lead(value) OVER w)::INT AS c FROM fr WINDOW w AS (PARTITION BY rec_id ORDER BY frame)), m AS (SELECT rec_id, median(value) AS m FROM fr GROUP BY rec_id) SELECT rec_id, round(coalesce(sum(c), 0) / (count(*) * {SEC}), 6) AS click_rate, round(sum((value < 0.01 * m)::INT) / (count(*) * {SEC}), 6) AS dropout_rate, count(DISTINCT floor(value)) AS levels FROM x JOIN m USING (rec_id) GROUP BY rec_id")
def gf_distortion(spark, folder):
    """Distortion (§2.10): clicks, dropouts and distinct whole levels."""
    f = src.frames(spark, folder)
    levels = f.groupBy("rec_id").agg(F.count_distinct(F.floor("value")).alias("levels"))
    return rounded(fr.clicks_and_dropouts(f, "value").drop("levels").join(levels, "rec_id"))


@query(f"WITH {RUNS}, x AS (SELECT rec_id, (NOT speech AND length BETWEEN 2 AND 50 AND coalesce(lag(speech) OVER w, false) AND coalesce(lead(speech) OVER w, false))::INT AS gap FROM runs WINDOW w AS (PARTITION BY rec_id ORDER BY first)) SELECT rec_id, sum(gap)::BIGINT AS gaps FROM x GROUP BY rec_id")
def gf_signal_integrity(spark, folder):
    """Signal integrity (§2.10): short gaps inside speech."""
    return fr.interruptions(src.frames(spark, folder), "speech", 2, 50)


@query(f"WITH {RUNS}, s AS (SELECT rec_id, length, lag(length) OVER (PARTITION BY rec_id ORDER BY first) AS p FROM runs WHERE speech) SELECT rec_id, round(coalesce(100 * avg(abs(length - p) / ((length + p) / 2)), 0), 6) AS npvi, count(*) AS segments FROM s GROUP BY rec_id")
def fv_rhythm(spark, folder):
    """Rhythm (§2.11): variability of successive speech runs."""
    return rounded(fr.rhythm(src.frames(spark, folder), "speech"))


@query(f"WITH {FR}, d AS (SELECT rec_id, 20 * log10(greatest(value, 1e-10)) AS db FROM fr) SELECT rec_id, round(avg(db), 6) AS mean_db, round(max(db) - min(db), 6) AS range_db, round(var_pop(db), 6) AS var_db, round(least(greatest(quantile_cont(db, 0.9) - quantile_cont(db, 0.1), -10), 60), 6) AS snr_db FROM d GROUP BY rec_id")
def gf_levels(spark, folder):
    """Energy dynamics and noise (§2.10)."""
    return rounded(fr.level_features(src.frames(spark, folder), "value"))


@query(f"WITH {FR}, d AS (SELECT rec_id, max(value) / 1e5 AS peak, avg((value > 200)::INT) AS c, count(*) * {SEC} AS t, avg((value > 150)::INT) AS r FROM fr GROUP BY rec_id) SELECT rec_id, array_to_string(list_filter([CASE WHEN peak < 0.001 THEN 'TooQuiet' END, CASE WHEN c > 0.1 THEN 'Clipped' END, CASE WHEN t < 1 THEN 'TooShort' END, CASE WHEN r < 0.05 THEN 'InsufficientSpeech' END], lambda x: x IS NOT NULL), ',') AS warnings FROM d")
def f5_warnings(spark, folder):
    """actionable checks; an empty list passes."""
    d = src.frames(spark, folder).groupBy("rec_id").agg((F.max("value") / 1e5).alias("peak"), F.avg((F.col("value") > 200).cast("int")).alias("clipped_share"), (F.count("*") * 160 / 16000).alias("total_duration_sec"), F.avg((F.col("value") > 150).cast("int")).alias("speech_ratio"))
    return fr.warnings(d).select("rec_id", F.concat_ws(",", "warnings").alias("warnings"))


@query("WITH n AS (SELECT doc_id AS row_idx, n_chars AS n FROM documents) SELECT row_idx, CASE WHEN n < 512 THEN 0 ELSE 1 + (n - 512) // 160 END::INT AS frames, round_even((row_idx % 50) * (99 / 49), 0)::INT AS mask_at FROM n")
def v1_framing(spark, folder):
    """V1, V6: number of frames, and the place in a mask of 100 frames for frame row_idx % 50 of 50."""
    d = src.table(spark, folder, "documents")
    at = nearest_index(F.lit(100), F.lit(50), F.col("doc_id") % 50)
    return d.select(F.col("doc_id").alias("row_idx"), fr.frame_count(F.col("n_chars")).alias("frames"), at.alias("mask_at"))


@query(f"WITH {MAN} SELECT row_idx, regexp_extract(filename, '(sp[0-9]{{4}})', 1) AS speaker, split_part(filename, '/', 1) AS dataset, split_part(filename, '/', -1) AS base FROM man")
def o3_path_parts(spark, folder):
    """O3: speaker, dataset and base name from paths."""
    parts = F.split("filename", "/")
    return src.manifest(spark, folder).select("row_idx", F.regexp_extract("filename", r"(sp\d{4})", 1).alias("speaker"), F.element_at(parts, 1).alias("dataset"), F.element_at(parts, -1).alias("base"))


@query(f"WITH {MAN}, h AS (SELECT *, row_number() OVER (PARTITION BY dataset_source ORDER BY md5(row_idx || '|' || 5), row_idx) AS r, count(*) OVER (PARTITION BY dataset_source) AS n FROM man) SELECT dataset_source, any_value(n) AS files, round(avg(duration), 6) AS mean_duration, round(avg(duration) * any_value(n) / 3600, 6) AS hours FROM h WHERE r <= 10 GROUP BY dataset_source")
def o5_sampled_properties(spark, folder):
    """Estimated hours from a hash sample of ten files of each dataset."""
    m = src.manifest(spark, folder).withColumn("h", portable_hash(F.col("row_idx"), F.lit(5)))
    n = m.groupBy("dataset_source").agg(F.count("*").alias("files"))
    s = m.withColumn("r", F.row_number().over(W.partitionBy("dataset_source").orderBy("h", "row_idx"))).where("r <= 10").groupBy("dataset_source").agg(F.avg("duration").alias("mean_duration"))
    return rounded(s.join(n, "dataset_source").select("dataset_source", "files", "mean_duration", (F.col("mean_duration") * F.col("files") / 3600).alias("hours")))


@query(f"WITH {MAN} SELECT row_idx, coalesce(r.new, speaker_id) AS speaker_id FROM man LEFT JOIN (SELECT * FROM (VALUES ('sp0001', 'id_a'), ('sp0002', 'id_b')) v(old, new)) r ON old = speaker_id")
def o14_renamed_ids(spark, folder):
    """Ids rewritten by a table."""
    names = spark.createDataFrame([("sp0001", "id_a"), ("sp0002", "id_b")], "old string, new string")
    m = src.manifest(spark, folder)
    return m.join(F.broadcast(names), F.col("speaker_id") == F.col("old"), "left").select("row_idx", F.coalesce("new", "speaker_id").alias("speaker_id"))


TEST = "ts AS (SELECT DISTINCT speaker_id FROM man WHERE substr(speaker_id, 6, 1) IN ('0', '5'))"


@query(f"WITH {MAN}, {TEST} SELECT row_idx, speaker_id, CASE WHEN speaker_id IN (FROM ts) THEN 'test' ELSE 'dev' END AS split FROM man")
def f1_test_speakers(spark, folder):
    """rows to dev or test by a set of speakers (semi and anti join)."""
    m = src.manifest(spark, folder)
    test = m.where(F.substring("speaker_id", 6, 1).isin("0", "5")).select("speaker_id").distinct()
    a = m.join(test, "speaker_id", "left_semi").withColumn("split", F.lit("test"))
    return a.unionByName(m.join(test, "speaker_id", "left_anti").withColumn("split", F.lit("dev"))).select("row_idx", "speaker_id", "split")


@query(f"WITH {MAN}, n AS (SELECT speaker_id FROM man GROUP BY speaker_id HAVING count(*) >= 5) SELECT row_idx, speaker_id FROM man WHERE speaker_id IN (FROM n)")
def f2_min_clips(spark, folder):
    """speakers of five recordings or more."""
    m = src.manifest(spark, folder)
    n = m.groupBy("speaker_id").agg(F.count("*").alias("n")).where("n >= 5").select("speaker_id")
    return m.join(n, "speaker_id", "left_semi").select("row_idx", "speaker_id")


@query(f"WITH {MAN} SELECT row_idx, lower(CASE WHEN row_idx % 4 = 0 THEN 'DF_' ELSE 'OK_' END || speaker_id) AS name FROM man WHERE NOT starts_with(CASE WHEN row_idx % 4 = 0 THEN 'DF_' ELSE 'OK_' END, 'DF_')")
def f3_genuine_files(spark, folder):
    """names without the spoof prefix, in lower case."""
    m = src.manifest(spark, folder).withColumn("name", F.concat(F.when(F.col("row_idx") % 4 == 0, "DF_").otherwise("OK_"), "speaker_id"))
    return m.where(~F.col("name").startswith("DF_")).select("row_idx", F.lower("name").alias("name"))


@query(f"WITH {MAN}, {TEST}, d AS (SELECT DISTINCT speaker_id FROM man WHERE speaker_id NOT IN (FROM ts)) SELECT (SELECT count(*) FROM (FROM ts INTERSECT FROM d)) AS shared_speakers, (SELECT count(*) FROM ts) AS test_speakers, (SELECT count(*) FROM d) AS dev_speakers")
def j12_leak_check(spark, folder):
    """Speakers that two splits share."""
    s = f1_test_speakers(spark, folder)
    t, d = (s.where(F.col("split") == k).select("speaker_id").distinct() for k in ("test", "dev"))
    return t.intersect(d).agg(F.count("*").alias("shared_speakers")).crossJoin(t.agg(F.count("*").alias("test_speakers"))).crossJoin(d.agg(F.count("*").alias("dev_speakers")))


@query(f"WITH {MAN}, v AS (SELECT row_idx FROM man ORDER BY md5(row_idx || '|' || 42), row_idx LIMIT 200) SELECT row_idx, CASE WHEN row_idx IN (FROM v) THEN 'validation' ELSE 'train' END AS part FROM man")
def x1_validation_split(spark, folder):
    """A fixed number of validation rows by hash, and the pool without them."""
    m = src.manifest(spark, folder).select("row_idx")
    v = m.withColumn("h", portable_hash(F.col("row_idx"), F.lit(42))).orderBy("h", "row_idx").limit(200).select("row_idx")
    return v.withColumn("part", F.lit("validation")).unionByName(m.join(v, "row_idx", "left_anti").withColumn("part", F.lit("train")))


@query(f"WITH {MAN}, p AS (SELECT row_idx, 'x/' || filename AS asked FROM man WHERE row_idx % 3 = 0 UNION ALL SELECT row_idx, filename FROM man WHERE row_idx % 3 = 1 UNION ALL SELECT row_idx, 'nowhere/' || row_idx FROM man WHERE row_idx % 3 = 2), k AS (SELECT p.*, m.row_idx AS exact, (SELECT min(s.row_idx) FROM man s WHERE array_to_string(string_split(s.filename, '/')[-3:], '/') = array_to_string(string_split(p.asked, '/')[-3:], '/')) AS by_suffix FROM p LEFT JOIN man m ON m.filename = asked) SELECT row_idx, coalesce(exact, by_suffix) AS found, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN by_suffix IS NOT NULL THEN 'suffix' END AS tier FROM k")
def j6_fuzzy_paths(spark, folder):
    """Paths found exactly, else by their last three parts; the first row wins."""
    m = src.manifest(spark, folder)
    suffix = lambda c: F.concat_ws("/", F.slice(F.reverse(F.split(c, "/")), 1, 3))
    asked = m.select("row_idx", F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit("x/"), "filename")).when(F.col("row_idx") % 3 == 1, F.col("filename")).otherwise(F.concat(F.lit("nowhere/"), F.col("row_idx").cast("string"))).alias("asked"))
    exact = m.groupBy(F.col("filename").alias("asked")).agg(F.min("row_idx").alias("exact"))
    near = m.groupBy(suffix("filename").alias("suffix")).agg(F.min("row_idx").alias("by_suffix"))
    j = asked.withColumn("suffix", suffix("asked")).join(exact, "asked", "left").join(near, "suffix", "left")
    return j.select("row_idx", F.coalesce("exact", "by_suffix").alias("found"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_suffix").isNotNull(), "suffix").alias("tier"))


@query("WITH d AS (SELECT l_partkey AS k, arg_max(l_quantity, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS q FROM lineitem GROUP BY l_partkey) SELECT p_partkey AS part, q::DOUBLE AS last_quantity FROM part LEFT JOIN d ON k = p_partkey")
def j4_last_wins(spark, folder):
    """A lookup in which the last of duplicate keys wins."""
    l = src.table(spark, folder, "lineitem")
    last = l.groupBy("l_partkey").agg(F.max_by("l_quantity", F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("last_quantity"))
    return src.table(spark, folder, "part").join(last, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("part"), F.col("last_quantity").cast("double").alias("last_quantity"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u4_distinct(spark, folder):
    """U4: distinct combinations."""
    return src.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query()
def x4_random_pairs(spark, folder):
    """Hash-sampled genuine and impostor pairs, one draw per speaker and slot, without materialising all pairs."""
    return random_pairs(src.manifest(spark, folder), 20, 1)


def random_pairs(manifest, draws: int, seed: int):
    """``genuine, slot, i, j``: for each speaker of two or more recordings ``draws`` genuine pairs of distinct recordings,
    and ``draws`` impostor pairs with a recording of another speaker. Places come from hashes of speaker and slot."""
    per = manifest.groupBy("speaker_id").agg(F.array_sort(F.collect_list("row_idx")).alias("recs")).withColumn("s", F.row_number().over(W.orderBy("speaker_id")) - 1)
    n = per.agg(F.count("*").alias("n"))
    slots = per.crossJoin(F.broadcast(n)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    h = lambda k, m: F.pmod(F.xxhash64("speaker_id", "slot", F.lit(seed * 10 + k)), m.cast("long"))
    size = F.size("recs")
    first = h(1, size)
    second = F.pmod(first + 1 + h(2, F.greatest(size - 1, F.lit(1))), size.cast("long"))
    genuine = slots.where(size >= 2).select(F.lit(1).alias("genuine"), "slot", F.col("recs")[first.cast("int")].alias("i"), F.col("recs")[second.cast("int")].alias("j"))
    other = F.pmod(F.col("s") + 1 + h(3, F.greatest(F.col("n") - 1, F.lit(1))), F.col("n"))
    ask = slots.where("n > 1").select("slot", F.col("recs")[first.cast("int")].alias("i"), other.alias("t"), h(4, F.lit(1 << 30)).alias("u"))
    recs = per.select(F.col("s").alias("t"), F.col("recs").alias("theirs"))
    impostor = ask.join(recs, "t").select(F.lit(0).alias("genuine"), "slot", "i", F.col("theirs")[F.pmod(F.col("u"), F.size("theirs").cast("long")).cast("int")].alias("j"))
    return genuine.unionByName(impostor)

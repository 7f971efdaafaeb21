"""Queries over recordings and frames: a recording is a user's event values in time order, framed and transformed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spectra as sp
from ..sources import tables as src
from .registry import query, rounded
from .statistics import FR

S = sp.Signal(rate=160, size=16, hop=4)
SIG = f"{FR}, sig AS (SELECT rec_id, frame AS t, (value - 50) / 500 AS x, speech FROM fr), nn AS (SELECT rec_id, count(*) AS n FROM sig GROUP BY rec_id)"
CF = f"{SIG}, ck AS (SELECT rec_id, unnest(range(n // 4 + 1)) AS frame FROM nn), cf AS (SELECT ck.rec_id, ck.frame, j, coalesce(x, 0) AS x FROM ck CROSS JOIN (SELECT unnest(range(16)) AS j) LEFT JOIN sig ON sig.rec_id = ck.rec_id AND t = 4 * ck.frame + j - 8)"
PF = f"{SIG}, pk AS (SELECT rec_id, unnest(range((n - 16) // 4 + 1)) AS frame FROM nn WHERE n >= 16), pf AS (SELECT pk.rec_id, pk.frame, t - 4 * pk.frame AS j, x FROM pk JOIN sig ON sig.rec_id = pk.rec_id AND t BETWEEN 4 * pk.frame AND 4 * pk.frame + 15)"
PW = f"{CF}, w AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS y FROM cf), pw AS (SELECT rec_id, frame, b, sum(y * cos(2 * pi() * b * j / 16)) ** 2 + sum(y * sin(2 * pi() * b * j / 16)) ** 2 AS p FROM w CROSS JOIN (SELECT unnest(range(9)) AS b) GROUP BY ALL)"
AT = "PARTITION BY rec_id, frame"


def recordings(spark, folder) -> DataFrame:
    """``rec_id, samples``: a user's event values, shifted and scaled."""
    rows = src.frames(spark, folder).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("x"))
    return rows.select("rec_id", F.transform("x", lambda v: (v["value"] - 50) / 500).alias("samples"))


def wav_files(spark, folder) -> DataFrame:
    """``rec_id, content``: two-channel 16-bit WAV files of 16 kHz made of a user's event values, the second channel 7 lower."""
    little = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 16, "0"), 15, 2), F.substring(F.lpad(F.hex(c), 16, "0"), 13, 2))
    wide = lambda c: F.concat(little(c), F.substring(F.lpad(F.hex(c), 16, "0"), 11, 2), F.substring(F.lpad(F.hex(c), 16, "0"), 9, 2))
    v = F.floor("value").cast("long")
    rows = src.frames(spark, folder).withColumn("pair", F.concat(little(v), little(v - 7)))
    files = rows.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "pair"))), lambda x: x["pair"]), "").alias("data"))
    size = (F.length("data") / 2).cast("long")
    head = lambda text: F.hex(F.lit(text))
    form = "10000000" + "0100" + "0200" + "803E0000" + "00FA0000" + "0400" + "1000"  # 16 bytes: PCM, 2 channels, 16 kHz, 64,000 bytes a second, 4 bytes, 16 bits
    content = F.unhex(F.concat(head("RIFF"), wide(size + 36), head("WAVE"), head("fmt "), F.lit(form), head("data"), wide(size), "data"))
    return files.select("rec_id", content.alias("content"))


def power(spark, folder) -> DataFrame:
    return sp.powered(sp.framed(recordings(spark, folder), S, "zero"), S).select("rec_id", "frame", "power")


@query(f"WITH {FR}, v AS (SELECT rec_id, frame, floor(value)::BIGINT AS v FROM fr) SELECT rec_id, count(*) AS n, round(sum((v * 2 - 7) / 2 / 32768), 9) AS mean_sum, round(sum(v / 32768), 9) AS first_sum, round(max((v * 2 - 7) / 2 / 32768), 9) AS peak FROM v GROUP BY rec_id")
def o1_decoded_recordings(spark, folder):
    """O1, O2: two-channel 16-bit WAV files made of event values, decoded with averaged and with first channels."""
    files = wav_files(spark, folder)
    mean = sp.decoded(files).select("rec_id", F.size("samples").cast("long").alias("n"), sp.total(F.col("samples")).alias("mean_sum"), F.array_max("samples").alias("peak"))
    first = sp.decoded(files, mono="first").select("rec_id", sp.total(F.col("samples")).alias("first_sum"))
    return rounded(mean.join(first, "rec_id"), 9)


@query(f"WITH {SIG}, c AS (SELECT rec_id, t, x - avg(x) OVER (PARTITION BY rec_id) AS x FROM sig) SELECT rec_id, t::INT AS t, round(x / (max(abs(x)) OVER (PARTITION BY rec_id) + 1e-8) * 0.95, 6) AS x FROM c")
def v0_normalised(spark, folder):
    """V0: samples without offset, with a peak of 0.95."""
    return rounded(recordings(spark, folder).select("rec_id", F.posexplode(sp.normalised(F.col("samples"))).alias("t", "x")))


@query(f"WITH {SIG}, s AS (SELECT rec_id, t, x, lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS b FROM sig WHERE speech), g AS (SELECT rec_id, t, unnest(CASE WHEN b IS NULL OR b = t - 1 THEN [x] ELSE [0.0, x] END) AS x FROM s) SELECT rec_id, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * (r - 1)), 6) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t, x <> 0) AS r FROM g) GROUP BY rec_id")
def v5_speech_only(spark, folder):
    """V5: the samples of speech, runs parted by silence."""
    f = src.frames(spark, folder).select("rec_id", "frame", F.array((F.col("value") - 50) / 500).alias("hop"), "speech")
    x = sp.speech_only(f)
    return rounded(x.select("rec_id", F.size("samples").cast("long").alias("n"), sp.total(F.col("samples")).alias("total"), sp.total(F.col("samples"), lambda v, i: v * i).alias("weighted")))


_SHAPE = f"""WITH {PW}, s1 AS (
  SELECT *, sqrt(p) AS mag, sum(p) OVER ({AT}) AS tot, sum(sqrt(p)) OVER ({AT}) AS mags, sum(p) OVER ({AT} ORDER BY b) AS run, coalesce(lag(sqrt(p)) OVER (PARTITION BY rec_id, b ORDER BY frame), sqrt(p)) AS old FROM pw
), s2 AS (
  SELECT *, p / (tot + 1e-12) AS sh, sum(p / (tot + 1e-12) * 10 * b) OVER ({AT}) AS mid, sum(mag * 10 * b) OVER ({AT}) / CASE WHEN mags > 0 THEN mags ELSE 1 END AS ctr, sqrt(sum(old * old) OVER ({AT})) AS nold FROM s1
), s3 AS (SELECT *, sqrt(sum(sh * (10 * b - mid) ** 2) OVER ({AT}) + 1e-12) AS spr FROM s2)
SELECT rec_id, frame::INT AS frame, round(least(greatest(exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12), 0), 1), 6) AS "FrameSF", round(-sum(sh * ln(sh + 1e-12)) / ln(9), 6) AS "FrameSE",
  least(sum((run < 0.85 * (tot + 1e-12))::INT), 8)::DOUBLE * 10 AS "FrameSR", round(sum((b - 4) * ln(p + 1e-12)) / 60, 6) AS "FrameSS",
  round(sum(sh * ((10 * b - mid) / spr) ** 3), 6) AS "FrameSSkew", round(sum(sh * ((10 * b - mid) / spr) ** 4) - 3, 6) AS "FrameSKurt", round(max(p) / (avg(p) + 1e-12), 6) AS "FrameSCF",
  round(sqrt(sum(mag * (10 * b - ctr) ** 2) / any_value(CASE WHEN mags > 0 THEN mags ELSE 1 END)), 6) AS "FrameSBW", round(sqrt(sum((mag / (sqrt(tot) + 1e-12) - old / (nold + 1e-12)) ** 2)), 6) AS "FrameSFlux", round(any_value(ctr), 6) AS "Centroid"
FROM s3 GROUP BY rec_id, frame"""


@query(_SHAPE)
def fr_spectral_shape(spark, folder):
    """FrameSF, SE, SR, SS, SSkew, SKurt, SCF, SBW, SFlux, and the centroid, of each frame's spectrum."""
    return rounded(sp.spectral_measures(power(spark, folder), S))


@query(f"WITH {PF}, l AS (SELECT rec_id, frame, avg(x * x) AS l FROM pf GROUP BY ALL), q AS (SELECT rec_id, greatest(quantile_cont(l, 0.1), 1e-12) AS q FROM l WHERE l > 0 GROUP BY rec_id) SELECT rec_id, frame::INT AS frame, round(20 * log10(sqrt(l) + 1e-12), 6) AS \"FrameE\", round(least(greatest(10 * log10(l / q + 1e-12), -10), 60), 6) AS \"FrameSNR\" FROM l JOIN q USING (rec_id)")
def fr_levels(spark, folder):
    """FrameE, FrameSNR: level of each frame, and above the recording's quiet frames."""
    return rounded(sp.level_measures(sp.framed(recordings(spark, folder), S)))


@query(f"WITH {SIG}, ck AS (SELECT rec_id, n, unnest(range(n // 4 + 1)) AS frame FROM nn), cf AS (SELECT ck.rec_id, ck.frame, j, (x < 0)::INT AS neg FROM ck CROSS JOIN (SELECT unnest(range(16)) AS j) JOIN sig ON sig.rec_id = ck.rec_id AND t = least(greatest(4 * ck.frame + j - 8, 0), n - 1)), d AS (SELECT rec_id, frame, abs(neg - lag(neg) OVER ({AT} ORDER BY j)) AS d FROM cf) SELECT rec_id, frame::INT AS frame, round(sum(coalesce(d, 0)) / 16, 6) AS \"FrameZCR\" FROM d GROUP BY ALL")
def fr_crossings(spark, folder):
    """FrameZCR: sign changes in each frame."""
    return rounded(sp.crossings(sp.framed(recordings(spark, folder), S, "edge")))


@query(f"WITH {PF}, a AS (SELECT p.rec_id, p.frame, q.j - p.j AS l, sum(p.x * q.x) AS a FROM pf p JOIN pf q ON p.rec_id = q.rec_id AND p.frame = q.frame AND q.j >= p.j GROUP BY ALL), e AS (SELECT rec_id, frame, a AS e FROM a WHERE l = 0), k AS (SELECT rec_id, frame, max(a) AS peak, arg_max(l, a) AS lag FROM a WHERE l BETWEEN 2 AND 10 GROUP BY ALL), h AS (SELECT k.rec_id, k.frame, max(a) AS sub FROM k JOIN a ON a.rec_id = k.rec_id AND a.frame = k.frame AND l >= 2 * lag - 1 AND l < 2 * lag + 1 GROUP BY ALL) SELECT k.rec_id, k.frame::INT AS frame, round(CASE WHEN e < 1e-12 THEN 0 ELSE peak / (e + 1e-12) END, 6) AS \"FrameAC\", round(CASE WHEN e < 1e-12 THEN 0 ELSE coalesce(least(greatest(sub / (e + 1e-12) / (peak / (e + 1e-12) + 1e-12), 0), 2), 0) END, 6) AS \"FrameSHR\" FROM k JOIN e USING (rec_id, frame) LEFT JOIN h USING (rec_id, frame)")
def fr_periodicity(spark, folder):
    """FrameAC, FrameSHR: autocorrelation at the period and around twice the period."""
    return rounded(sp.periodicity(sp.framed(recordings(spark, folder), S), S, 16.0, 80.0))


@query(f"WITH {PF}, w AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / 15)) AS y FROM pf), lg AS (SELECT rec_id, frame, b, ln(sum(y * cos(2 * pi() * b * j / 16)) ** 2 + sum(y * sin(2 * pi() * b * j / 16)) ** 2 + 1e-12) AS g FROM w CROSS JOIN (SELECT unnest(range(16)) AS b) GROUP BY ALL), c AS (SELECT rec_id, frame, q, sum(g * cos(2 * pi() * b * q / 16)) / 16 AS c FROM lg CROSS JOIN (SELECT unnest(range(16)) AS q) GROUP BY ALL), k AS (SELECT rec_id, frame, max(c) FILTER (q BETWEEN 2 AND 7) AS peak, arg_max(q, c) FILTER (q BETWEEN 2 AND 7) AS pos, avg(c) AS m, sum(c * (q - 7.5)) / 340 AS s FROM c GROUP BY ALL) SELECT rec_id, frame::INT AS frame, round(peak - m - s * (pos - 7.5), 6) AS \"FrameCPP\" FROM k")
def fr_cepstral_peak(spark, folder):
    """FrameCPP: the cepstral peak above the line through the cepstrum."""
    return rounded(sp.cepstral_peak(sp.framed(recordings(spark, folder), S), S, 20.0, 80.0))


BANDS, KEEP = 5, 4
#: Triangles of equal area by their formula: below 1 kHz, as here, their corners are even in hertz.
_FILTERS = f"SELECT m, b, greatest(0, least((10 * b - l) / (c - l), (r - 10 * b) / (r - c))) * 2 / (r - l) AS f FROM (SELECT m, 5 + 75 * m / {BANDS + 1} AS l, 5 + 75 * (m + 1) / {BANDS + 1} AS c, 5 + 75 * (m + 2) / {BANDS + 1} AS r FROM (SELECT unnest(range({BANDS})) AS m)), (SELECT unnest(range(9)) AS b)"
_NEAR = "PARTITION BY rec_id, k ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING"
_MFCC = f"""WITH {PW}, mf AS ({_FILTERS}), me AS (
  SELECT rec_id, frame, m, 10 * log10(greatest(sum(p * f), 1e-10)) AS d FROM pw JOIN mf USING (b) GROUP BY ALL
), fl AS (SELECT rec_id, frame, m, greatest(d, max(d) OVER (PARTITION BY rec_id) - 80) AS d FROM me), ce AS (
  SELECT rec_id, frame, k, sum(d * cos(pi() * k * (m + 0.5) / {BANDS}) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / {BANDS})) AS c FROM fl CROSS JOIN (SELECT unnest(range({KEEP})) AS k) GROUP BY ALL
), li AS (SELECT rec_id, frame, k, c, list(c) OVER ({_NEAR}) AS l FROM ce), de AS (
  SELECT rec_id, frame, k, c, CASE WHEN len(l) = 9 THEN list_sum(list_transform(l, lambda v, i: v * (i - 5))) / 60 END AS d1, CASE WHEN len(l) = 9 THEN 2 * list_sum(list_transform(l, lambda v, i: v * ((i - 5) ** 2 - 20 / 3))) / 308 END AS d2 FROM li
), fi AS (
  SELECT rec_id, frame, k, c, coalesce(first_value(d1 IGNORE NULLS) OVER a, last_value(d1 IGNORE NULLS) OVER z, 0) AS d1, coalesce(first_value(d2 IGNORE NULLS) OVER a, last_value(d2 IGNORE NULLS) OVER z, 0) AS d2 FROM de
  WINDOW a AS (PARTITION BY rec_id, k ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), z AS (PARTITION BY rec_id, k ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) SELECT rec_id, frame::INT AS frame, round(var_pop(c), 5) AS "FrameMFCCVar", round(var_pop(d1), 5) AS "FrameDeltaMFCC", round(var_pop(d2), 5) AS "FrameDeltaDeltaMFCC" FROM fi WHERE k > 0 GROUP BY ALL"""


@query(_MFCC)
def fr_cepstral_variance(spark, folder):
    """FrameMFCCVar, FrameDeltaMFCC, FrameDeltaDeltaMFCC: spread of the mel cepstra and of their first two slopes."""
    return rounded(sp.cepstral_measures(sp.cepstra(power(spark, folder), S, KEEP, BANDS, 5.0, 80.0)), 5)


@query()
def fr_prediction(spark, folder):
    """FrameGNE: what linear prediction explains of each frame; an iterative lattice, tested against least squares."""
    return rounded(sp.predictability(sp.framed(recordings(spark, folder), S), order=3))


@query(f"""WITH {PW}, m AS (SELECT rec_id, frame, b, sqrt(p) AS v FROM pw), g(g, lo, hi) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 8)), r AS (
  SELECT rec_id, frame, g, max(v) AS t, min(v) AS l FROM m JOIN g ON b BETWEEN lo AND hi GROUP BY ALL
), d AS (SELECT rec_id, frame, 10 * log10(greatest(t, 1e-10)) AS t, 10 * log10(greatest(l, 1e-10)) AS l FROM r), f AS (
  SELECT rec_id, frame, greatest(t, max(t) OVER (PARTITION BY rec_id) - 80) - greatest(l, max(l) OVER (PARTITION BY rec_id) - 80) AS d FROM d
) SELECT rec_id, frame::INT AS frame, round(avg(d), 6) AS "FrameSC" FROM f GROUP BY ALL""")
def fr_contrast(spark, folder):
    """FrameSC: contrast in octave bands from 10 Hz: bins 0, 0 to 1 and 1 to 8."""
    return rounded(sp.contrast(power(spark, folder), S, lowest=10.0, bands=2))


@query(f"WITH {PW}, a AS (SELECT rec_id, b, avg(p) AS p, 10 * log10(greatest(avg(p), 1e-10)) AS d FROM pw GROUP BY ALL), r AS (SELECT *, sum(p) OVER (PARTITION BY rec_id ORDER BY b) AS run, sum(p) OVER (PARTITION BY rec_id) AS tot FROM a) SELECT rec_id, min(b * 10) FILTER (run >= 0.95 * tot)::DOUBLE AS bandwidth, round(10 * log10((sum(p) FILTER (b BETWEEN 3 AND 7) + 1e-12) / (sum(p) FILTER (b < 3) + 1e-12)), 6) AS alpha_ratio, round(max(d) FILTER (b < 4) - max(d) FILTER (b BETWEEN 4 AND 7), 6) AS hammarberg, round(regr_slope(d, b * 10) FILTER (b BETWEEN 2 AND 6), 6) AS slope, round((sum(p) FILTER (b < 3) + 1e-12) / (sum(p) FILTER (b >= 3) + 1e-12), 6) AS low_to_high FROM r GROUP BY rec_id")
def gf_spectrum(spark, folder):
    """Bandwidth, spectral balance (alpha ratio, Hammarberg index, slope) and subband ratio (§2.10) of whole recordings."""
    return rounded(sp.spectrum_features(power(spark, folder), S, split=25.0, top=70.0, edge=35.0, slope=(20.0, 60.0)))


@query(f"WITH {PW}, v AS (SELECT pw.*, CASE WHEN b BETWEEN 1 AND 2 THEN 0 WHEN b BETWEEN 3 AND 5 THEN 1 WHEN b >= 6 THEN 2 END AS band, frame % 3 <> 0 AS sp FROM pw), s AS (SELECT rec_id, band, coalesce(avg(p) FILTER (sp), 0) AS v, avg(p) FILTER (NOT sp) AS n FROM v WHERE band IS NOT NULL GROUP BY ALL) SELECT rec_id, band::INT AS band, round(coalesce(least(greatest(10 * log10((v + 1e-12) / (n + 1e-12)), -20), 60), 60), 6) AS snr FROM s")
def gf_subbands(spark, folder):
    """Subband analysis (§2.10): speech over other frames in three bands; two of three frames count as speech."""
    f = power(spark, folder).withColumn("speech", F.col("frame") % 3 != 0)
    return rounded(sp.band_noise(f, S, [(10.0, 30.0), (30.0, 60.0), (60.0, 81.0)]))


@query(f"WITH {SIG}, d AS (SELECT rec_id, x, abs((x < 0)::INT - lag((x < 0)::INT) OVER (PARTITION BY rec_id ORDER BY t)) AS d FROM sig), l AS (SELECT rec_id, coalesce(20 * log10(greatest(avg(abs(x)) FILTER (speech), 1e-10)), -60) AS e FROM sig GROUP BY rec_id) SELECT rec_id, round(abs(avg(x)), 6) AS dc, round(avg((abs(x) >= 0.99)::INT), 6) AS clipped_share, round(coalesce(sum(d), 0) / count(*), 6) AS zcr, round(any_value(e), 6) AS energy FROM d JOIN l USING (rec_id) GROUP BY rec_id")
def gf_samples(spark, folder):
    """Clipping, offset (channel quality), zero crossings and energy (§2.10) of whole recordings."""
    f = src.frames(spark, folder).select("rec_id", F.abs((F.col("value") - 50) / 500).alias("rms"), "speech")
    return rounded(sp.sample_features(recordings(spark, folder)).join(sp.energy(f), "rec_id"))


@query(f"WITH {SIG}, c AS (SELECT rec_id, t, abs(x) - avg(abs(x)) OVER (PARTITION BY rec_id) AS v FROM sig), k AS (SELECT rec_id, t // 16 AS o, t % 16 AS j, v, count(*) OVER (PARTITION BY rec_id, t // 16) AS n FROM c), s AS (SELECT rec_id, o, b, sum(v * cos(2 * pi() * b * j / 16)) ** 2 + sum(v * sin(2 * pi() * b * j / 16)) ** 2 AS p FROM k CROSS JOIN (SELECT unnest(range(9)) AS b) WHERE n = 16 GROUP BY ALL), a AS (SELECT rec_id, coalesce(sum(p) FILTER (b BETWEEN 2 AND 5), 0) / (sum(p) + 1e-12) AS share FROM s GROUP BY rec_id) SELECT nn.rec_id, round(coalesce(share, 0), 6) AS share FROM nn LEFT JOIN a USING (rec_id)")
def gf_modulation(spark, folder):
    """Reverberation, SRMR, intelligibility (§2.10): share of the modulation spectrum in a band."""
    f = src.frames(spark, folder).select("rec_id", "frame", F.abs((F.col("value") - 50) / 500).alias("rms"))
    return rounded(sp.modulation(f, rate=16.0, low=2.0, high=5.0, block=16))


@query(f"WITH {FR}, c AS (SELECT rec_id, frame, unnest([value, ln(value + 1)]) AS v, unnest([0, 1]) AS k FROM fr), s AS (SELECT rec_id, frame, k, var_pop(v) OVER (PARTITION BY rec_id, k ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) + 1e-6 AS l, var_pop(v) OVER (PARTITION BY rec_id, k ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) + 1e-6 AS r, var_pop(v) OVER (PARTITION BY rec_id, k ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) + 1e-6 AS w, max(frame) OVER (PARTITION BY rec_id) AS last FROM c), g AS (SELECT rec_id, frame, sum(8 * ln(w) - 4 * (ln(l) + ln(r))) AS g FROM s WHERE frame >= 8 AND frame % 4 = 0 AND frame + 7 <= last GROUP BY ALL), n AS (SELECT rec_id, count(*) AS turns FROM g WHERE g > ln(8) * 2 GROUP BY rec_id) SELECT rec_id, coalesce(any_value(turns), 0)::BIGINT AS turns FROM fr LEFT JOIN n USING (rec_id) GROUP BY rec_id")
def gf_speaker_turns(spark, folder):
    """Speaker turns (§2.10): changes by the Bayesian information criterion."""
    f = src.frames(spark, folder).select("rec_id", "frame", F.array("value", F.ln(F.col("value") + 1)).alias("cepstrum"))
    return sp.turns(f, window=8, step=4, keep=2)


@query()
def fr_features(spark, folder):
    """H1 over all frame measures, in the speech frames: 19 statistics of each recording and measure."""
    x = recordings(spark, folder)
    plain, p = sp.framed(x, S), power(spark, folder)
    mask = src.frames(spark, folder).select("rec_id", "frame", "speech")
    first = sp.frame_features(sp.speech_frames(sp.level_measures(plain), mask))
    second = sp.frame_features(sp.speech_frames(sp.spectral_measures(p, S).drop("Centroid"), mask))
    return rounded(first.unionByName(second), 6)



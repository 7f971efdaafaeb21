"""Queries over the noise, channel, distortion, spectra and harmonics of whole recordings (§2.10, §2.11).

Of a recording's frames two of three count as speech, as in ``gf_subbands``; levels are the recording's samples without sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import phonation as ph
from ..operators import quality as ql
from ..operators import spectra as sp
from ..operators import voice as vo
from ..sources import tables as src
from .registry import query, rounded
from .signals import _MFCC, _SHAPE, BANDS, KEEP, PF, PW, SIG, S, power, recordings
from .statistics import FR
from .voices import LOWEST, P, pitches

SPEECH = "frame % 3 <> 0"
SP = SPEECH


def spoken(spark, folder) -> DataFrame:
    return power(spark, folder).withColumn("speech", F.expr(SPEECH))


def levels(spark, folder) -> DataFrame:
    return src.frames(spark, folder).select("rec_id", "frame", F.abs((F.col("value") - 50) / 500).alias("rms"), "speech")


LV = f"{FR}, lv AS (SELECT rec_id, frame, abs((value - 50) / 500) AS rms, speech FROM fr)"
MB = f"mb AS (SELECT rec_id, b, avg(p) FILTER ({SP}) AS v, avg(p) FILTER (NOT ({SP})) AS n, avg(p) AS w, var_pop(p) AS r FROM pw GROUP BY ALL)"


def _spoken_mean(x: str, f: str = "avg") -> str:
    return f"coalesce({f}({x}) FILTER ({SP}), {f}({x}))"


@query(f"""WITH {PW}, {MB}, l AS (SELECT rec_id, b, 10 * b AS f, coalesce(v, w) AS p FROM mb), l1 AS (SELECT *, p / (sum(p) OVER (PARTITION BY rec_id) + 1e-12) AS sh FROM l
), l2 AS (SELECT *, sum(sh * f) OVER (PARTITION BY rec_id) AS mu FROM l1), l3 AS (SELECT *, sqrt(sum(sh * (f - mu) ** 2) OVER (PARTITION BY rec_id) + 1e-12) AS sg FROM l2
), g AS (
  SELECT rec_id, regr_slope(10 * log10(p + 1e-12), f) AS slope, 10 * log10((sum(p) FILTER (f < 25) + 1e-12) / (sum(p) FILTER (f >= 25) + 1e-12)) AS tilt, sum(sh * ((f - mu) / sg) ** 3) AS sk, sum(sh * ((f - mu) / sg) ** 4) - 3 AS ku, max(p) / (avg(p) + 1e-12) AS cr FROM l3 GROUP BY rec_id
), sh AS ({_SHAPE}), fl AS (SELECT *, CASE WHEN frame > min(frame) OVER (PARTITION BY rec_id) THEN "FrameSFlux" END AS flux FROM sh), h AS (
  SELECT rec_id, coalesce({_spoken_mean("flux")}, 0) AS fm, coalesce({_spoken_mean("flux", "stddev_pop")}, 0) AS fs, {_spoken_mean('"FrameSR"')} AS ro, {_spoken_mean('"FrameSE"')} AS en, {_spoken_mean('"Centroid"')} AS ce FROM fl GROUP BY rec_id
) SELECT rec_id, round(slope, 5) AS "LTAS_Slope", round(tilt, 5) AS "LTAS_Tilt", round(sk, 5) AS "SpectralSkewness", round(ku, 5) AS "SpectralKurtosis", round(cr, 5) AS "SpectralCrest", round(fm, 5) AS "SpectralFluxMean", round(fs, 5) AS "SpectralFluxStd",
  round(ro, 5) AS "SpectralRolloff", round(en, 5) AS "SpectralEntropy", round(ce, 5) AS "SpectralCentroid" FROM g JOIN h USING (rec_id)""")
def gf_spectral_quality(spark, folder):
    """Spectral quality and centroid (§2.10)."""
    return rounded(ql.spectral_quality(spoken(spark, folder), S, split=25.0), 5)


@query(f"""WITH {LV}, {PF.replace(FR + ", ", "", 1)}, a AS (SELECT rec_id, coalesce(avg(rms * rms) FILTER (NOT speech), 1e-24) AS p, coalesce(avg(rms) FILTER (NOT speech), 1e-12) AS m, coalesce(stddev_pop(rms) FILTER (NOT speech), 0) AS sd FROM lv GROUP BY rec_id
), s AS (SELECT rec_id, coalesce(avg(10 * log10(rms * rms / (p + 1e-12) + 1e-12)) FILTER (speech), 0) AS snr FROM lv JOIN a USING (rec_id) GROUP BY rec_id
), w AS (SELECT rec_id, coalesce(stddev_pop(x) FILTER ({SP}), 0) AS v, stddev_pop(x) FILTER (NOT ({SP})) AS n FROM pf GROUP BY rec_id
) SELECT rec_id, round(snr, 6) AS "SegmentalSNR", round(20 * log10(m + 1e-12), 6) AS "NoiseFloorLevel", round(sd / (m + 1e-12), 6) AS "NoiseStationarity", round(least(greatest(CASE WHEN n > 1e-12 THEN 20 * log10(v / (n + 1e-12) + 1e-12) ELSE 40 END, -10), 60), 6) AS "WADA_SNR" FROM a JOIN s USING (rec_id) JOIN w USING (rec_id)""")
def gf_noise(spark, folder):
    """Noise estimation (§2.10): segmental ratio, floor, stationarity, and the ratio of amplitudes."""
    frames = sp.framed(recordings(spark, folder), S).withColumn("speech", F.expr(SPEECH))
    return rounded(ql.noise(levels(spark, folder)).join(ql.amplitude_ratio(frames), "rec_id"))


_BANDS, _HUM = [(10.0, 30.0, 0.12), (30.0, 50.0, 0.2), (50.0, 70.0, 0.3), (70.0, 81.0, 0.38)], (20.0, 43.0)


def _sii() -> str:
    part = lambda c, lo, hi: f"coalesce(avg({c}) FILTER (10 * b >= {lo} AND 10 * b < {hi}), 1e-12)"
    return " + ".join(f"{w} * (least(greatest(10 * log10({part('v', lo, hi)} / ({part('n', lo, hi)} + 1e-12) + 1e-12), -15), 15) + 15) / 30" for lo, hi, w in _BANDS)


@query(f"""WITH {PW}, {MB}, x AS (
  SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY b) AS run, sum(n) OVER (PARTITION BY rec_id) + 1e-12 AS tot, 100 * b * b / (100 * b * b + 424.36 + 1e-12) * 100 * b * b / (100 * b * b + 148693636 + 1e-12) AS q, r / (w + 1e-12) AS ra,
    (coalesce(sum(w) OVER (PARTITION BY rec_id ORDER BY b ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(w) OVER (PARTITION BY rec_id ORDER BY b ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0))
      / (count(w) OVER (PARTITION BY rec_id ORDER BY b ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - 1) + 1e-12 AS near FROM mb
), y AS (SELECT *, q / (max(q) OVER (PARTITION BY rec_id) + 1e-12) AS wt, median(ra) OVER (PARTITION BY rec_id) AS med FROM x
) SELECT rec_id, round(coalesce(min(10 * b) FILTER (run >= 0.95 * tot), 80), 6)::DOUBLE AS "NoiseBandwidth",
  round(least(greatest(CASE WHEN count(v) > 0 AND count(n) > 0 THEN 10 * log10(sum(wt * v) / (sum(wt * n) + 1e-12) + 1e-12) ELSE 30 END, -10), 60), 6) AS "FrequencyWeightedSNR",
  round({_sii()}, 6) AS "SII_Estimate", round((max(w / near) FILTER (b = 2) + max(w / near) FILTER (b = 4)) / 2, 5) AS "PowerLineHum", round(avg((med > 0 AND ra < 0.1 * med)::INT), 6) AS "MusicalNoiseLevel" FROM y GROUP BY rec_id""")
def gf_noise_spectra(spark, folder):
    """Noise bandwidth, frequency-weighted ratio, intelligibility, hum and musical noise (§2.10)."""
    found = ql.noise_spectra(spoken(spark, folder), S, _BANDS, _HUM)
    return rounded(found.withColumn("PowerLineHum", F.round("PowerLineHum", 5)))


@query(f"""WITH {LV}, c AS (SELECT rec_id, frame, rms, count(*) OVER (PARTITION BY rec_id) AS n, least(6, count(*) OVER (PARTITION BY rec_id) // 2) AS k FROM lv), m AS (
  SELECT a.rec_id, a.frame, any_value(a.n) AS n, avg(b.rms) AS m FROM c a JOIN c b ON a.rec_id = b.rec_id AND b.frame BETWEEN a.frame - a.k + 1 AND a.frame WHERE a.frame >= a.k - 1 AND a.k > 1 GROUP BY a.rec_id, a.frame
), d AS (SELECT rec_id, any_value(n) AS n, stddev_pop(m) / (avg(m) + 1e-12) AS d FROM m GROUP BY rec_id), r AS (SELECT DISTINCT rec_id FROM lv
), s AS (SELECT rec_id, avg((abs((value - 50) / 500) > 0.2)::INT) AS sat, count(*) AS n FROM fr GROUP BY rec_id), q AS (
  SELECT rec_id, count(DISTINCT round((x - o) * 1e6)::BIGINT) AS kinds, count(o) AS n FROM (SELECT rec_id, (value - 50) / 500 AS x, lag((value - 50) / 500) OVER (PARTITION BY rec_id ORDER BY frame) AS o FROM fr) WHERE o IS NOT NULL GROUP BY rec_id
) SELECT r.rec_id, round(CASE WHEN d.n > 10 THEN coalesce(d, 0) ELSE 0 END, 6) AS "AGC_Activity", round(sat, 6) AS "SaturationRatio", round(coalesce(greatest(1 - kinds / least(q.n, 65536), 0), 0), 6) AS "QuantizationNoise" FROM r JOIN s USING (rec_id) LEFT JOIN d USING (rec_id) LEFT JOIN q USING (rec_id)""")
def gf_channel(spark, folder):
    """Channel quality and distortion (§2.10): gain drift over six levels, saturation above 0.2, distinct steps."""
    drift = ql.gain_drift(levels(spark, folder), 6)
    return rounded(drift.join(ql.sample_distortion(recordings(spark, folder), 0.2), "rec_id"))


@query(f"WITH {SIG}, c AS (SELECT rec_id, t, abs(x) - avg(abs(x)) OVER (PARTITION BY rec_id) AS v FROM sig), k AS (SELECT rec_id, t // 16 AS o, t % 16 AS j, v, count(*) OVER (PARTITION BY rec_id, t // 16) AS n FROM c), s AS (SELECT rec_id, o, b, sum(v * cos(2 * pi() * b * j / 16)) ** 2 + sum(v * sin(2 * pi() * b * j / 16)) ** 2 AS p FROM k CROSS JOIN (SELECT unnest(range(9)) AS b) WHERE n = 16 GROUP BY ALL), a AS (SELECT rec_id, (coalesce(sum(p) FILTER (b BETWEEN 3 AND 8), 0) + 1e-12) / (coalesce(sum(p) FILTER (b BETWEEN 1 AND 2), 0) + 1e-12) AS r, coalesce(sum(p) FILTER (b BETWEEN 3 AND 8), 0) / (sum(p) + 1e-12) AS h FROM s GROUP BY rec_id) SELECT nn.rec_id, round(coalesce(r, 1), 4) AS \"SRMR\", round(coalesce(h, 0), 6) AS \"ModulationSpectrumArea\" FROM nn LEFT JOIN a USING (rec_id)")
def gf_modulation_ratio(spark, folder):
    """SRMR and the modulation spectrum's area (§2.10)."""
    found = ql.modulation_ratio(levels(spark, folder), rate=16.0, block=16, voice=(3.0, 8.0), room=(1.0, 3.0))
    return rounded(found.withColumn("SRMR", F.round("SRMR", 4)))


@query()
def gf_onsets(spark, folder):
    """Onset strength (§2.10): mean rise of mel bands; tested by direct sums."""
    return rounded(ql.onset_strength(power(spark, folder), S, BANDS, 5.0, 80.0))


def _harmonic(h: int) -> str:
    return f"max(p) FILTER (b = least(ceil({h} * f0 / 10 - 0.5), 8))"


def _heard(hs) -> str:
    return " + ".join(f"CASE WHEN {h} * any_value(f0) <= 80 THEN {_harmonic(h)} ELSE 0 END" for h in hs)


@query(f"""WITH {PW}, f AS (SELECT *, (5 + frame * 7 % 23)::DOUBLE AS f0 FROM pw), v AS (
  SELECT rec_id, frame, 10 * log10({_harmonic(1)} + 1e-12) - 10 * log10({_harmonic(2)} + 1e-12) AS h, least(greatest(({_heard(range(2, 10))}) / ({_harmonic(1)} + 1e-12), 0), 100) AS r, least(greatest(({_heard(range(2, 10, 2))}) / ({_heard(range(1, 10, 2))} + 1e-12), 0), 100) AS e
  FROM f WHERE f0 >= 10 GROUP BY rec_id, frame
), a AS (SELECT rec_id, avg(h) AS h, avg(r) AS r, avg(e) AS e FROM v GROUP BY rec_id) SELECT nn.rec_id, round(coalesce(h, 0), 6) AS "H1H2", round(coalesce(r, 0), 5) AS "HRF", round(coalesce(e, 0), 5) AS "PSP" FROM nn LEFT JOIN a USING (rec_id)""")
def gf_harmonics(spark, folder):
    """Voice quality and glottal source (§2.10): power at multiples of a pitch, which is made of the frame's number here."""
    p = power(spark, folder)
    found = ql.harmonics(p, p.select("rec_id", "frame", (5 + F.col("frame") * 7 % 23).cast("double").alias("FrameF0")), S, LOWEST)
    return rounded(found.withColumn("HRF", F.round("HRF", 5)).withColumn("PSP", F.round("PSP", 5)))


@query()
def gf_glottal_source(spark, folder):
    """Glottal source (§2.10): quotients of the flow behind linear prediction, and the pitch's closures; tested on pulses."""
    return rounded(ql.glottal_source(sp.framed(recordings(spark, folder), S).where(SPEECH), pitches(spark, folder), S, order=3))


@query()
def fv_group_delay(spark, folder):
    """Group delay (§2.11): cepstra of the phase's steps and of the modified group delay; tested by direct sums."""
    frames = sp.framed(recordings(spark, folder), S, "zero").withColumn("speech", F.expr(SPEECH))
    one = lambda modified: ql.delay_cepstra(frames, S, 5, modified).withColumn("modified", F.lit(modified))
    return rounded(one(False).unionByName(one(True)))


_CEPSTRA = _MFCC[: _MFCC.index(", li AS")]
_KEPT = f"{_CEPSTRA}, sc AS (SELECT *, max(({SP})::INT) OVER (PARTITION BY rec_id) AS spoken FROM ce), ks AS (SELECT rec_id, frame, k, c FROM sc WHERE {SP} OR spoken = 0)"


@query(f"""{_KEPT}, en AS (SELECT rec_id, frame, sum(c * c) FILTER (k > 0) AS e FROM ks GROUP BY ALL), d AS (SELECT *, e / (sum(e) OVER (PARTITION BY rec_id) + 1e-12) AS sh, e - avg(e) OVER (PARTITION BY rec_id) AS dv FROM en
), t AS (SELECT rec_id, count(*) AS n, -sum(sh * ln(sh + 1e-12)) AS ent, CASE WHEN avg(dv * dv) > 0 THEN avg(dv ** 4) / avg(dv * dv) ** 2 - 3 ELSE 0 END AS kurt, max(e) - min(e) AS rg FROM d GROUP BY rec_id
), m AS (SELECT rec_id, k, avg(c) AS m, stddev_pop(c) AS s FROM ks GROUP BY ALL), wd AS (
  SELECT rec_id, {', '.join(f'max(m) FILTER (k = {k}) AS m{k}, max(s) FILTER (k = {k}) AS s{k}' for k in range(KEEP))}, exp(avg(ln(abs(m) + 1e-12)) FILTER (k > 0)) / (avg(abs(m)) FILTER (k > 0) + 1e-12) AS fl FROM m GROUP BY rec_id
) SELECT rec_id, {', '.join(f'round(m{k}, 5) AS "V_MFCC_Mean_{k + 1}", round(s{k}, 5) AS "V_MFCC_Std_{k + 1}"' for k in range(KEEP))}, round(CASE WHEN n > 2 THEN fl ELSE 0 END, 5) AS "V_LTFD_Flatness", round(CASE WHEN n > 2 THEN ent ELSE 0 END, 5) AS "V_LTFD_Entropy",
  round(CASE WHEN n > 2 THEN kurt ELSE 0 END, 4) AS "V_LTFD_Kurtosis", round(CASE WHEN n > 2 THEN rg ELSE 0 END, 3) AS "V_LTFD_Range" FROM wd JOIN t USING (rec_id)""")
def fv_cepstral(spark, folder):
    """Cepstral features and their long-term distribution (§2.11)."""
    c = sp.cepstra(power(spark, folder), S, KEEP, BANDS, 5.0, 80.0).withColumn("speech", F.expr(SPEECH))
    found = ql.cepstral_means(c, KEEP)
    return rounded(found.withColumn("V_LTFD_Kurtosis", F.round("V_LTFD_Kurtosis", 4)).withColumn("V_LTFD_Range", F.round("V_LTFD_Range", 3)), 5)


VO = f"{FR}, vo AS (SELECT rec_id, frame, CASE WHEN speech AND frame % 9 < 7 THEN 80 + value / 5 ELSE 0 END AS f0, CASE WHEN frame % 5 > 0 THEN value / 10 - 4 END AS hnr, speech FROM fr)"


def voice_rows(spark, folder) -> DataFrame:
    """Pitch and harmonicity rows made of event values, with gaps."""
    f = src.frames(spark, folder)
    pitch = F.when(F.col("speech") & (F.col("frame") % 9 < 7), 80 + F.col("value") / 5).otherwise(0.0)
    return f.select("rec_id", "frame", pitch.alias("FrameF0"), F.when(F.col("frame") % 5 > 0, F.col("value") / 10 - 4).alias("hnr"), "speech")


@query(f"""WITH {VO}, v AS (SELECT *, (f0 > 0)::INT AS v, (f0 > 0)::INT - lag((f0 > 0)::INT) OVER w AS turn, sum((f0 > 0)::INT) OVER w AS i FROM vo WINDOW w AS (PARTITION BY rec_id ORDER BY frame)), s AS (
  SELECT *, abs(1 / f0 - 1 / lag(f0) OVER (PARTITION BY rec_id ORDER BY frame)) AS step FROM v WHERE v = 1
), a AS (SELECT rec_id, count(*) AS n, sum(v) AS k, count(*) FILTER (turn = 1) AS o, count(*) FILTER (turn = -1) AS e, sum(speech::INT) * 4 / 160 AS sec FROM v GROUP BY rec_id
), b AS (SELECT rec_id, avg(f0) AS m, stddev_pop(f0) AS sd, max(f0) - min(f0) AS rg, max(f0) AS mx, CASE WHEN count(*) > 1 THEN regr_slope(f0, i) END AS sl, median(f0) AS md, avg(step) / (avg(1 / f0) + 1e-12) AS cv FROM s GROUP BY rec_id
), h AS (SELECT rec_id, avg(hnr) AS hm, stddev_pop(hnr) AS hs, avg((hnr > 10)::INT) AS mo, avg((hnr < 5)::INT) AS br FROM vo GROUP BY rec_id)
SELECT rec_id, round(o / (sec + 1e-12), 6) AS "V_ArticulationRate", round(coalesce(m, 0), 6) AS "V_F0_Mean", round(coalesce(sd, 0), 6) AS "V_F0_Std", round(coalesce(rg, 0), 6) AS "V_F0_Range", round(coalesce(mx, 0), 6) AS "V_F0_Max", round(coalesce(sl, 0), 6) AS "V_F0_Slope", round(coalesce(md, 0), 6) AS "V_F0_Median",
  round(coalesce(cv, 0), 6) AS "Tremor_CycleVariation", round(CASE WHEN k > 0 THEN e / (k * 4 / 160 + 1e-12) ELSE 0 END, 6) AS "MDVP_DVB", round(1 - k / n, 6) AS "UnvoicedFrameRatio", round(sec, 6) AS "SpeechSeconds",
  round(coalesce(hm, 0), 6) AS "CPP_Mean", round(coalesce(hs, 0), 6) AS "CPP_Std", round(coalesce(10 ** (-hm / 10), 1), 6) AS "NHR", round(coalesce(mo, 0.5), 6) AS "V_ModalProportion", round(coalesce(br, 0.5), 6) AS "V_BreathyProportion"
FROM a JOIN h USING (rec_id) LEFT JOIN b USING (rec_id)""")
def gf_phonation(spark, folder):
    """Prosody, voice breaks, harmonicity and voice quality (§2.10, §2.11) of pitch and harmonicity rows."""
    rows = voice_rows(spark, folder)
    found = ph.pitch_features(rows, rows, S).join(ph.harmonic_features(rows), "rec_id")
    return rounded(found)


_PH = {"turbulence": 60.0, "soft": (10.0, 30.0, 60.0), "low_high": (20.0, 70.0), "alpha": (10.0, 20.0, 80.0)}


@query(f"WITH {PW}, {MB} SELECT rec_id, round(coalesce(sum(w) FILTER (10 * b > 60), 0) / (sum(w) + 1e-12), 6) AS \"MDVP_VTI\", round((sum(w) FILTER (b BETWEEN 1 AND 3) + 1e-12) / (sum(w) FILTER (b BETWEEN 3 AND 6) + 1e-12), 5) AS \"MDVP_SPI\", round(sum(w) FILTER (b <= 2) / (sum(w) FILTER (b BETWEEN 2 AND 7) + 1e-12), 5) AS \"LowHigh\", round(10 * log10((sum(w) FILTER (b BETWEEN 1 AND 2) + 1e-12) / (sum(w) FILTER (b BETWEEN 2 AND 8) + 1e-12)), 5) AS \"V_AlphaRatio\", round(regr_slope(10 * log10(w + 1e-12), 10 * b), 6) AS \"V_SpectralTilt\" FROM mb GROUP BY rec_id")
def gf_voice_bands(spark, folder):
    """Turbulence, soft phonation, low over high, alpha ratio and tilt (§2.10, §2.11)."""
    found = ph.band_features(spoken(spark, folder), S, _PH)
    return rounded(found.withColumns({c: F.round(c, 5) for c in ("MDVP_SPI", "LowHigh", "V_AlphaRatio")}))


@query()
def gf_clinical(spark, folder):
    """Tremor and clinical composites (§2.10) of whole recordings, from pitch, harmonicity, perturbation and bands."""
    x, p = recordings(spark, folder), pitches(spark, folder)
    mask = src.frames(spark, folder).select("rec_id", "frame", "speech")
    shaken = vo.perturbation(vo.marks(x, p, P.rate, P.hop).withColumn("t", F.col("t") / 100))
    known = ph.pitch_features(p, mask, P).join(ph.harmonic_features(ph.harmonic_levels(sp.framed(x, P))), "rec_id").join(ph.band_features(spoken(spark, folder), S, _PH), "rec_id")
    known = known.join(shaken, "rec_id", "left").fillna(0.0, ["Jitter", "Shimmer"])
    return rounded(ph.composites(known).join(ph.tremor(p, P.rate / P.hop), "rec_id").join(ph.source_shape(sp.framed(x, P), p, P, 3, LOWEST), "rec_id"))


_LTAS = [(0.0, 10.0), (10.0, 30.0), (30.0, 50.0), (50.0, 70.0), (70.0, 90.0)]


@query(f"""WITH {PW}, {MB}, l AS (SELECT rec_id, b, 10 * log10(coalesce(v, w) + 1e-12) AS d FROM mb), lt AS (
  SELECT rec_id, avg(d) FILTER (b = 0) AS l1, avg(d) FILTER (b BETWEEN 1 AND 2) AS l2, avg(d) FILTER (b BETWEEN 3 AND 4) AS l3, avg(d) FILTER (b BETWEEN 5 AND 6) AS l4, avg(d) FILTER (b >= 7) AS l5 FROM l GROUP BY rec_id
), c AS (SELECT rec_id, frame, sum(p) + 1e-12 AS s, sum(p * 10 * b) / (sum(p) + 1e-12) AS c FROM pw GROUP BY ALL), m AS (SELECT *, coalesce(avg(c) FILTER ({SP}) OVER (PARTITION BY rec_id), avg(c) OVER (PARTITION BY rec_id)) AS m FROM c
), f AS (SELECT rec_id, frame, any_value(c) AS c, sqrt(sum(p * (10 * b - m) ** 2) / any_value(s)) AS w, -sum(p / s * ln(p / s + 1e-12)) / ln(9) AS e FROM pw JOIN m USING (rec_id, frame) GROUP BY ALL
), a AS (SELECT rec_id, {_spoken_mean("c")} AS cm, {_spoken_mean("c", "stddev_pop")} AS cs, {_spoken_mean("w")} AS wm, {_spoken_mean("e")} AS em, {_spoken_mean("e", "stddev_pop")} AS es FROM f GROUP BY rec_id
) SELECT rec_id, round(l1, 5) AS "V_LTAS_1", round(l2, 5) AS "V_LTAS_2", round(l3, 5) AS "V_LTAS_3", round(l4, 5) AS "V_LTAS_4", round(l5, 5) AS "V_LTAS_5", round(l1 - l3, 5) AS "V_LTAS_LowMidRatio", round(l3 - l5, 5) AS "V_LTAS_MidHighRatio",
  round(cm, 5) AS "V_SpectralCentroid_Mean", round(cs, 5) AS "V_SpectralCentroid_Std", round(wm, 5) AS "V_SpectralBW_Mean", round(em, 5) AS "V_SpectralEntropy_Mean", round(es, 5) AS "V_SpectralEntropy_Std" FROM lt JOIN a USING (rec_id)""")
def fv_distribution(spark, folder):
    """Long-term levels and spectral identity (§2.11)."""
    return rounded(ql.long_term(spoken(spark, folder), S, _LTAS), 5)


@query(f"""WITH {FR}, g AS (SELECT rec_id, frame, speech, row_number() OVER (PARTITION BY rec_id ORDER BY frame) - row_number() OVER (PARTITION BY rec_id, speech ORDER BY frame) AS g FROM fr
), r AS (SELECT rec_id, speech, min(frame) AS first, count(*) / 100 AS sec FROM g GROUP BY rec_id, speech, g), d AS (SELECT *, CASE WHEN speech THEN abs(sec - lag(sec) OVER (PARTITION BY rec_id, speech ORDER BY first)) END AS step FROM r)
SELECT rec_id, round(coalesce(avg(step) / (avg(sec) FILTER (speech) + 1e-12), 0), 6) AS "V_Rhythm_nPVI", round(coalesce(sum(sec) FILTER (speech), 0) / sum(sec), 6) AS "V_Rhythm_VoicedPct", round(coalesce(stddev_pop(sec) FILTER (speech), 0), 6) AS "V_Rhythm_SpeechSegVar",
  round(coalesce(stddev_pop(sec) FILTER (NOT speech), 0), 6) AS "V_Rhythm_SilenceSegVar", round(least(coalesce(sum(sec) FILTER (speech), 0) / (coalesce(sum(sec) FILTER (NOT speech), 0) + 1e-12), 1000), 6) AS "V_Rhythm_SpeechSilenceRatio" FROM d GROUP BY rec_id""")
def fv_rhythm_features(spark, folder):
    """Rhythm (§2.11): runs of speech and silence in seconds."""
    return rounded(ql.rhythm_features(src.frames(spark, folder).select("rec_id", "frame", "speech"), 0.01))

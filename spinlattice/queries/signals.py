"""Signal time-series queries (I, and the windows and joins that belong to them)."""

from pyspark.sql import Window
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signal as sg
from .registry import query, r6

c = F.col
O = "SELECT track_id, frame, round(CAST(onset AS DOUBLE), 9) AS onset FROM v_onset"
onset = lambda v: v("v_onset").select("track_id", "frame", F.round(c("onset").cast("double"), 9).alias("onset"))


def frames(v):
    """Embedding vectors as frames of ten tracks."""
    e = v.spark.read.parquet(f"{v.sf_dir}/embeddings.parquet")
    w = Window.partitionBy("label").orderBy("vec_id")
    x = F.transform("embedding", lambda y: y.cast("double"))
    return e.select(c("label").cast("long").alias("track_id"), (F.row_number().over(w) - 1).cast("int").alias("frame"), x.alias("x"))


def chroma(v):
    mag = lambda a: F.transform(a, F.abs)
    return frames(v).select("track_id", "frame", mag(F.slice("x", 1, 12)).alias("c12"), F.transform(F.sequence(F.lit(0), F.lit(71)), lambda b: F.abs(F.get("x", (b % 64).cast("int")))).alias("c72"))


def spectrogram(v):
    return frames(v).select("track_id", "frame", F.posexplode("x").alias("bin", "m")).select("track_id", "frame", "bin", F.abs("m").alias("mag"))


FR = "SELECT CAST(label AS BIGINT) AS track_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding AS x FROM embeddings"
SPEC = f"SELECT track_id, frame, CAST(generate_subscripts(x, 1) - 1 AS INT) AS bin, abs(CAST(unnest(x) AS DOUBLE)) AS mag FROM ({FR}) f"

query("f11_moving_average", f"SELECT track_id, frame, round(avg(onset) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS onset FROM ({O}) o")(lambda v: sg.moving_average(onset(v), "onset").withColumn("onset", r6(c("onset"))))
query("f12_whitening", f"SELECT track_id, frame, round(CASE WHEN m > 0 THEN sqrt(onset / m) ELSE 0 END, 6) AS onset FROM (SELECT *, max(onset) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM ({O}) o) x")(lambda v: sg.whiten(onset(v), 10).withColumn("onset", r6(c("onset"))))
query("f13_sliding_upper_median", f"SELECT track_id, frame, round(list_sort(l)[len(l) // 2 + 1], 6) AS med FROM (SELECT *, list(onset) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS l FROM ({O}) o) x")(lambda v: sg.sliding_upper_median(onset(v), "onset").withColumn("med", r6(c("med"))))
query("i01_centred_window", f"SELECT track_id, frame FROM (SELECT *, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({O}) o) x WHERE frame >= greatest(0, floor((n - 100) / 2.0)) AND frame < greatest(0, floor((n - 100) / 2.0)) + 100")(lambda v: sg.centred_window(onset(v), 100).select("track_id", "frame"))
AC = f"SELECT track_id, lag, round(CASE WHEN z > 0 THEN raw / z ELSE 0 END, 6) AS value FROM (SELECT *, first_value(raw) OVER (PARTITION BY track_id ORDER BY lag) AS z FROM (SELECT t.track_id, l.lag, coalesce(sum(a.onset * b.onset), 0) AS raw FROM (SELECT track_id, max(frame) + 1 AS n FROM ({O}) o GROUP BY track_id) t CROSS JOIN (SELECT CAST(unnest(range(0, 65)) AS INT) AS lag) l LEFT JOIN ({O}) a ON a.track_id = t.track_id LEFT JOIN ({O}) b ON b.track_id = a.track_id AND b.frame = a.frame + l.lag WHERE l.lag < t.n GROUP BY t.track_id, l.lag) y) x"
ac = lambda v: sg.autocorrelation(onset(v), 64)
query("i19_autocorrelation", AC)(lambda v: ac(v).withColumn("value", r6(c("value"))))
query("d15_lag_join", f"SELECT * FROM ({AC}) w WHERE value > 0")(lambda v: sg.autocorrelation_by_join(onset(v), 64).withColumn("value", r6(c("value"))).where("value > 0"))
query("i20_peaks")(lambda v: sg.peaks(ac(v), 2, 60).select("track_id", "lag", r6(c("strength")).alias("strength"), "rank"))
query("i21_peak_places")(lambda v: sg.peaks(ac(v), 2, 60).select("track_id", "lag", r6(c("place")).alias("place")))
query("i22_tempo")(lambda v: sg.tempo(sg.peaks(ac(v), 2, 60), onset(v)))
query("i02_framing", f"SELECT track_id, CAST(k AS INT) AS frame, CAST(i AS INT) AS i, round(CAST(x[k * 8 + i + 1] AS DOUBLE), 6) AS v FROM ({FR}) f CROSS JOIN (SELECT unnest(range(0, 7)) AS k) a CROSS JOIN (SELECT unnest(range(0, 16)) AS i) b")(
    lambda v: sg.framing(frames(v).select("track_id", c("x").alias("samples")), 16, 8).select("track_id", "frame", F.posexplode("samples").alias("i", "v")).withColumn("v", r6(c("v")))
)
DFT = """SELECT track_id, frame, CAST(b AS INT) AS bin, sqrt(pow(sum(x[i + 1] * w * cos(2 * pi() * b * i / 64)), 2) + pow(sum(x[i + 1] * w * sin(2 * pi() * b * i / 64)), 2)) AS mag
FROM (SELECT track_id, frame, CAST(x AS DOUBLE[]) AS x, i, 0.5 * (1 - cos(2 * pi() * i / 64)) AS w FROM ({}) f CROSS JOIN (SELECT unnest(range(0, 64)) AS i) n) z CROSS JOIN (SELECT unnest(range(0, 33)) AS b) y GROUP BY track_id, frame, b"""
query("i03_spectrum", f"SELECT track_id, frame, bin, round(mag, 5) AS mag FROM ({DFT.format(FR)}) q")(
    lambda v: sg.spectrum(frames(v).select("track_id", "frame", c("x").alias("samples"))).select("track_id", "frame", F.posexplode("mags").alias("bin", "mag")).withColumn("mag", F.round("mag", 5))
)
SPLIT = f"""SELECT track_id, frame, bin, mag, h * h / (h * h + p * p + 1e-10) AS mask FROM (SELECT track_id, frame, bin, mag, list_sort(hl)[len(hl) // 2 + 1] AS h, list_sort(pl)[len(pl) // 2 + 1] AS p FROM (
SELECT *, list(mag) OVER (PARTITION BY track_id, bin ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS hl, list(mag) OVER (PARTITION BY track_id, frame ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS pl FROM ({SPEC}) s) a) b"""
query("i04_harmonic_split", f"SELECT track_id, frame, bin, round(mag * mask, 6) AS harmonic, round(mag * (1 - mask), 6) AS percussive FROM ({SPLIT}) q")(
    lambda v: sg.harmonic_split(spectrogram(v)).select("track_id", "frame", "bin", r6(c("harmonic")).alias("harmonic"), r6(c("percussive")).alias("percussive"))
)
query("d14_sparse_fold", f"SELECT track_id, frame, bin % 12 AS pc, round(sum(mag / (bin + 1)), 6) AS value FROM ({SPEC}) s GROUP BY 1, 2, 3")(lambda v: sg.fold(spectrogram(v), v.spark.range(64).select(c("id").cast("int").alias("bin"), (c("id") % 12).cast("int").alias("pc"), (1.0 / (c("id") + 1)).alias("w"))).withColumn("value", r6(c("value"))))
folded = lambda df: df.withColumn("value", r6(c("value")))
PITCH = "CAST((CAST(floor(12 * log2(bin * {} / {} / 440.0) + 69 + 0.5) AS BIGINT) % 12 + 12) % 12 AS INT)"
query("i05_chroma", f"SELECT track_id, frame, {PITCH.format('31.25', '1')} AS pc, round(sum(mag), 6) AS value FROM ({SPEC}) s WHERE bin > 0 GROUP BY 1, 2, 3")(lambda v: folded(sg.fold(spectrogram(v), sg.bin_map(v.spark, 64, 128, 4000.0))))
KERNEL = """SELECT band, b, x / sum(x) OVER (PARTITION BY band) * f AS w FROM (SELECT band, b, f, 1 - cos(2 * pi() * (b - begin) / width) AS x FROM (SELECT *, centre * q AS width, centre - centre * q / 2 AS begin FROM (
SELECT band, 32.70319566257483 * pow(2, band / 12.0) AS f, 32.70319566257483 * pow(2, band / 12.0) * 128 / 2000 AS centre, 0.8 * (pow(2, 1 / 12.0) - 1) AS q FROM (SELECT unnest(range(0, 72)) AS band) n) k) j
CROSS JOIN (SELECT unnest(range(0, 64)) AS b) i WHERE b >= ceil(begin) AND b <= floor(begin + width)) h"""
query("i06_kernel_chroma", f"SELECT track_id, frame, CAST(band AS INT) AS pc, round(sum(mag * w), 6) AS value FROM ({SPEC}) s JOIN ({KERNEL}) k ON k.b = s.bin GROUP BY 1, 2, 3")(lambda v: folded(sg.fold(spectrogram(v), sg.kernel_map(v.spark, 64, 128, 2000.0))))
query("i07_hpcp", f"SELECT track_id, frame, {PITCH.format('62.5', 'k')} AS pc, round(sum(mag * w), 6) AS value FROM ({SPEC}) s CROSS JOIN (VALUES (1.0, 1.0), (2.0, 0.5), (3.0, CAST(1 AS DOUBLE) / 3), (4.0, 0.25)) AS h(k, w) WHERE bin * 62.5 > 200 GROUP BY 1, 2, 3")(
    lambda v: folded(sg.fold(spectrogram(v), sg.bin_map(v.spark, 64, 128, 8000.0, True)))
)
MEAN = f"SELECT track_id, i, m / max(m) OVER (PARTITION BY track_id) AS v FROM (SELECT track_id, bin AS i, avg(mag) AS m FROM ({SPEC}) s WHERE bin < 12 GROUP BY track_id, bin) a"
query("i08_mean_chroma", f"SELECT track_id, i, round(v, 6) AS v FROM ({MEAN}) b")(lambda v: sg.mean_chroma(chroma(v)).select("track_id", F.posexplode("c12").alias("i", "v")).withColumn("v", r6(c("v"))))
SEG = f"SELECT track_id, segment, i, m / sqrt(sum(m * m) OVER (PARTITION BY track_id, segment)) AS v FROM (SELECT track_id, CAST(least(floor(frame / floor(n / 8.0)), 7) AS INT) AS segment, bin AS i, avg(mag) AS m FROM (SELECT *, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({SPEC}) s) t WHERE bin < 12 GROUP BY 1, 2, 3) a"
seg = lambda v: sg.segment_means(chroma(v), 8)
query("i09_segment_means", f"SELECT track_id, segment, i, round(v, 6) AS v FROM ({SEG}) b")(lambda v: seg(v).select("track_id", "segment", F.posexplode("c12").alias("i", "v")).withColumn("v", r6(c("v"))))

# fixed values, written out once more so that the SQL knows nothing of the library's tables
PROFILES_12 = """(VALUES ('krumhansl', 'major', [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]), ('krumhansl', 'minor', [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]),
('temperley', 'major', [0.26, 0.04, 0.11, 0.06, 0.16, 0.14, 0.06, 0.18, 0.05, 0.12, 0.05, 0.08]), ('temperley', 'minor', [0.26, 0.07, 0.12, 0.18, 0.07, 0.12, 0.07, 0.16, 0.14, 0.08, 0.10, 0.09]),
('shaath', 'major', [7.239005026181452, 3.503511667251587, 3.584451775366494, 2.845118164786763, 5.818988921185498, 4.558650574153210, 2.447788505455065, 6.994731921468295, 3.391066136735049, 4.556142566551435, 4.073926666635236, 4.459327573788869]),
('shaath', 'minor', [7.002550450602844, 3.143602790159967, 4.359043197149625, 5.404181207189341, 3.672344208793061, 4.089711849177979, 3.907914359915540, 6.199602885623165, 3.634246256252774, 2.872411910798756, 5.354679997945427, 3.832420385950484])) AS b(f, mode, q)"""
AMODAL_12 = """(VALUES ('braw', 'major', [1.0000, 0.1573, 0.4200, 0.1570, 0.5296, 0.3669, 0.1632, 0.7711, 0.1676, 0.3827, 0.2113, 0.2965]), ('braw', 'minor', [1.0000, 0.2330, 0.3615, 0.3905, 0.2925, 0.3777, 0.1961, 0.7425, 0.2701, 0.2161, 0.4228, 0.2272]),
('braw', 'other', [1.0000, 0.2608, 0.3528, 0.2935, 0.4393, 0.3580, 0.2137, 0.7809, 0.2578, 0.2539, 0.3233, 0.2615]),
('bgate', 'major', [1.00, 0.00, 0.42, 0.00, 0.53, 0.37, 0.00, 0.77, 0.00, 0.38, 0.21, 0.30]), ('bgate', 'minor', [1.00, 0.00, 0.36, 0.39, 0.00, 0.38, 0.00, 0.74, 0.27, 0.00, 0.42, 0.23]),
('bgate', 'other', [1.00, 0.26, 0.35, 0.29, 0.44, 0.36, 0.21, 0.78, 0.26, 0.25, 0.32, 0.26])) AS b(f, mode, q)"""
OCTAVES_72 = "[0.3999726755, 0.556344252483, 0.524966363451, 0.608475483843, 0.5989811568, 0.49072435318]"


def bank(profiles: str, bands: int = 12) -> str:
    """Rows (f, mode, tonic, i, w) of profiles turned to each tonic, over one octave or six."""
    w = "CAST(q[(i % 12 - tonic + 12) % 12 + 1] AS DOUBLE)" + (f" * CAST({OCTAVES_72}[i // 12 + 1] AS DOUBLE)" if bands == 72 else "")
    return f"SELECT f, mode, tonic, i, {w} AS w FROM {profiles} CROSS JOIN (SELECT unnest(range(0, 12)) AS tonic) t CROSS JOIN (SELECT unnest(range(0, {bands})) AS i) x"


def scored(means: str, templates: str, gain: int) -> str:
    return f"SELECT s.track_id, s.segment, k.f AS family, k.mode, CAST(k.tonic AS INT) AS tonic, sum(ln(1 + {gain} * s.v) * k.w) / (sqrt(sum(pow(ln(1 + {gain} * s.v), 2))) * sqrt(sum(k.w * k.w))) AS score FROM ({means}) s JOIN ({templates}) k ON k.i = s.i GROUP BY 1, 2, 3, 4, 5"


TS = scored(SEG, bank(PROFILES_12), 5)
ts = lambda v: sg.template_scores(seg(v), sg.templates(v.spark))
query("i10_templates", f"SELECT track_id, segment, family, mode, tonic, round(score, 6) AS score FROM ({TS}) q")(lambda v: sg.template_scores(seg(v), sg.templates(v.spark, bands=12)).withColumn("score", r6(c("score"))))
query("i11_template_scores", f"SELECT track_id, segment, family, mode, tonic, round(score, 6) AS score FROM ({TS}) q")(lambda v: ts(v).withColumn("score", r6(c("score"))))
EN = f"SELECT track_id, segment, mode, tonic, sum(score * w) / sum(w) AS score FROM (SELECT *, CASE family WHEN 'krumhansl' THEN 0.15 WHEN 'temperley' THEN 0.25 ELSE 1.0 END AS w FROM ({TS}) q) r GROUP BY 1, 2, 3, 4"
en = lambda v: sg.ensemble(ts(v))
query("i12_ensemble", f"SELECT track_id, segment, mode, tonic, round(score, 6) AS score FROM ({EN}) z")(lambda v: en(v).withColumn("score", r6(c("score"))))
#: The same with the shaath family on 72 bands, as an analysis scores.
SEG72 = f"""SELECT track_id, segment, i, m / sqrt(sum(m * m) OVER (PARTITION BY track_id, segment)) AS v FROM (SELECT track_id, CAST(least(floor(frame / floor(n / 8.0)), 7) AS INT) AS segment, b.i, avg(mag) AS m
FROM (SELECT *, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({SPEC}) s) t JOIN (SELECT unnest(range(0, 72)) AS i) b ON b.i % 64 = t.bin GROUP BY 1, 2, 3) a"""
ONLY = lambda sql, cond: f"SELECT * FROM ({sql}) only_ WHERE {cond}"
DTS = ONLY(TS, "family <> 'shaath'") + " UNION ALL " + scored(SEG72, ONLY(bank(PROFILES_12, 72), "f = 'shaath'"), 3)
DUAL = f"SELECT track_id, segment, mode, tonic, sum(score * w) / sum(w) AS score FROM (SELECT *, CASE family WHEN 'krumhansl' THEN 0.15 WHEN 'temperley' THEN 0.25 ELSE 1.0 END AS w FROM ({DTS}) q) r GROUP BY 1, 2, 3, 4"
dual = lambda v: sg.dual_scores(chroma(v), 8)
query("i12_dual_ensemble", f"SELECT track_id, segment, mode, tonic, round(score, 6) AS score FROM ({DUAL}) z")(lambda v: dual(v).withColumn("score", r6(c("score"))))


def soft_sql(scores: str) -> str:
    spread = f"SELECT *, min(score) OVER (PARTITION BY track_id, segment) AS lo, max(score) OVER (PARTITION BY track_id, segment) AS hi FROM ({scores}) z"
    return f"SELECT track_id, mode, tonic, round(t / sum(t) OVER (PARTITION BY track_id), 6) AS confidence FROM (SELECT track_id, mode, tonic, sum((score - lo) / (hi - lo)) AS t FROM ({spread}) y GROUP BY 1, 2, 3) x"


def winners_sql(scores: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, segment ORDER BY round(score, 9) DESC, mode, tonic) AS r FROM ({scores}) z) y WHERE r = 1"


def hard_sql(scores: str) -> str:
    won = f"SELECT track_id, mode, tonic, count(*) AS wins, avg(score) AS score FROM ({winners_sql(scores)}) w GROUP BY 1, 2, 3"
    sure = f"SELECT *, 0.6 * wins / sum(wins) OVER (PARTITION BY track_id) + 0.4 * least(1.0, greatest(0.0, score)) AS confidence FROM ({won}) v"
    return f"SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(confidence, 9) DESC, wins DESC, round(score, 9) DESC, mode, tonic) AS rnk FROM ({sure}) u"


soft = lambda df: sg.soft_vote(df).select("track_id", "mode", "tonic", r6(c("confidence")).alias("confidence"))
hard = lambda df: sg.hard_vote(df).select("track_id", "mode", "tonic", "wins", r6(c("confidence")).alias("confidence"), c("rank").alias("rnk"))
HARD = lambda scores: f"SELECT track_id, mode, tonic, wins, round(confidence, 6) AS confidence, rnk FROM ({hard_sql(scores)}) h"
query("i13_soft_vote", soft_sql(EN))(lambda v: soft(en(v)))
query("i13_dual_soft_vote", soft_sql(DUAL))(lambda v: soft(dual(v)))
query("i14_hard_vote", HARD(EN))(lambda v: hard(en(v)))
query("i14_dual_hard_vote", HARD(DUAL))(lambda v: hard(dual(v)))

SPREAD_36 = f"SELECT track_id, segment, family, CASE mode WHEN 'other' THEN 'minor' ELSE mode END AS mode, tonic, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS x FROM ({scored(SEG, bank(AMODAL_12), 5)}) z WINDOW w AS (PARTITION BY track_id, segment, family)"


@query("i15_amodal_vote", f"""SELECT track_id, family, mode, tonic, round(t / sum(t) OVER (PARTITION BY track_id, family), 6) AS confidence FROM (SELECT track_id, family, mode, tonic, sum(x) AS t FROM (
SELECT track_id, segment, family, mode, tonic, max(x) AS x FROM ({SPREAD_36}) a GROUP BY 1, 2, 3, 4, 5) b GROUP BY 1, 2, 3, 4) d""")  # fmt: skip
def _(v):
    votes = [sg.amodal_vote(sg.template_scores(seg(v), sg.templates(v.spark, [f]))).withColumn("family", F.lit(f)) for f in ("braw", "bgate")]
    return votes[0].unionByName(votes[1]).select("track_id", "family", "mode", "tonic", r6(c("confidence")).alias("confidence"))


#: The middle 40 frames in four segments, 72 bands alone.
MIDDLE = f"SELECT *, frame - greatest(0, floor((n - 40) / 2.0)) AS pos, least(n, 40) AS total FROM (SELECT *, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({SPEC}) s) t"
SEG_MIDDLE = f"""SELECT track_id, segment, i, m / sqrt(sum(m * m) OVER (PARTITION BY track_id, segment)) AS v FROM (SELECT track_id, CAST(least(floor(pos / floor(total / 4.0)), 3) AS INT) AS segment, b.i, avg(mag) AS m
FROM ({MIDDLE}) t JOIN (SELECT unnest(range(0, 72)) AS i) b ON b.i % 64 = t.bin WHERE pos >= 0 AND pos < 40 GROUP BY 1, 2, 3) a"""
query("i16_ablation_72", soft_sql(scored(SEG_MIDDLE, ONLY(bank(PROFILES_12, 72), "f = 'shaath'"), 3)))(
    lambda v: soft(sg.ensemble(sg.template_scores(sg.segment_means(sg.centred_window(chroma(v), 40), 4, "c72", 72), sg.templates(v.spark, ["shaath"], 72), "c72", 3.0)))
)


def dual_sql(spec):
    """Segment scores of an analysis over the frames in ``spec``: 12 pitch classes and 72 bands, eight segments."""
    cut = f"SELECT *, CAST(least(floor(pos / floor(n / 8.0)), 7) AS INT) AS segment FROM ({spec}) s"
    norm = "SELECT track_id, segment, i, m / sqrt(sum(m * m) OVER (PARTITION BY track_id, segment)) AS v FROM ({}) a"
    by12 = norm.format(f"SELECT track_id, segment, bin AS i, avg(mag) AS m FROM ({cut}) t WHERE bin < 12 GROUP BY 1, 2, 3")
    by72 = norm.format(f"SELECT track_id, segment, b.i, avg(mag) AS m FROM ({cut}) t JOIN (SELECT unnest(range(0, 72)) AS i) b ON b.i % 64 = t.bin GROUP BY 1, 2, 3")
    both = ONLY(scored(by12, bank(PROFILES_12), 5), "family <> 'shaath'") + " UNION ALL " + scored(by72, ONLY(bank(PROFILES_12, 72), "f = 'shaath'"), 3)
    return f"SELECT track_id, segment, mode, tonic, sum(score * w) / sum(w) AS score FROM (SELECT *, CASE family WHEN 'krumhansl' THEN 0.15 WHEN 'temperley' THEN 0.25 ELSE 1.0 END AS w FROM ({both}) q) r GROUP BY 1, 2, 3, 4"


def harmonic_sql(radius):
    """The frames with their harmonic part by medians over ``radius`` places to either side."""
    near = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    lists = f"SELECT *, list(mag) OVER (PARTITION BY track_id, bin ORDER BY frame {near}) AS hl, list(mag) OVER (PARTITION BY track_id, frame ORDER BY bin {near}) AS pl FROM ({SPEC}) s"
    medians = f"SELECT track_id, frame, bin, mag, list_sort(hl)[len(hl) // 2 + 1] AS h, list_sort(pl)[len(pl) // 2 + 1] AS p FROM ({lists}) a"
    return f"SELECT track_id, frame, bin, mag * (h * h / (h * h + p * p + 1e-10)) AS mag, frame AS pos, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({medians}) b"


WHOLE = f"SELECT *, frame AS pos, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({SPEC}) s"
WINDOW = f"SELECT track_id, frame, bin, mag, pos, total AS n FROM ({MIDDLE}) t WHERE pos >= 0 AND pos < 40"
#: What an analysis leaves out or changes, as the votes that it then gives.
ABLATIONS = {"twelve bins": soft_sql(EN), "no split": soft_sql(dual_sql(WHOLE)), "kernel 5": soft_sql(dual_sql(harmonic_sql(2))), "kernel 17": soft_sql(dual_sql(harmonic_sql(8))), "window": soft_sql(dual_sql(WINDOW))}


@query("i16_ablations", " UNION ALL ".join(f"SELECT '{name}' AS variant, * FROM ({sql}) v{i}" for i, (name, sql) in enumerate(ABLATIONS.items())))
def _(v):
    def of_split(radius):
        return sg.chroma_of_bins(sg.harmonic_split(spectrogram(v), radius).select("track_id", "frame", "bin", c("harmonic").alias("mag")), 64)

    votes = {"twelve bins": en(v), "no split": dual(v), "kernel 5": sg.dual_scores(of_split(2), 8), "kernel 17": sg.dual_scores(of_split(8), 8), "window": sg.dual_scores(sg.centred_window(chroma(v), 40), 8)}
    parts = [soft(scores).withColumn("variant", F.lit(name)) for name, scores in votes.items()]
    return reduce(DataFrame.unionByName, parts)


spans = lambda v: v.spark.range(8).select(c("id").cast("int").alias("segment"), (c("id") * 10.0).alias("start_s"), (c("id") * 10.0 + 10).alias("end_s")).crossJoin(chroma(v).select("track_id").distinct())
NAMED = "concat(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][{0}.tonic + 1], ' ', {0}.mode)"
TIMELINE = f"""SELECT w.track_id, w.segment, CAST(w.segment * 10 AS DOUBLE) AS start_s, CAST(w.segment * 10 + 10 AS DOUBLE) AS end_s, {NAMED.format('w')} AS key, d.code AS wheel, 0.6 + 0.4 * least(1.0, greatest(0.0, w.score)) AS confidence,
 {NAMED.format('g')} AS global_key, e.code AS global_wheel, g.confidence AS global_confidence FROM ({winners_sql(DUAL)}) w JOIN v_dim d ON d.tonic = w.tonic AND d.is_major = (w.mode = 'major')
 JOIN ({hard_sql(DUAL)}) g ON g.track_id = w.track_id AND g.rnk = 1 JOIN v_dim e ON e.tonic = g.tonic AND e.is_major = (g.mode = 'major')"""
MODULATES = "(SELECT count(DISTINCT u.wheel) FROM timeline u WHERE u.track_id = t.track_id) > 1"
query("i17_key_timeline", f"SELECT track_id, segment, start_s, end_s, key, wheel, round(confidence, 6) AS confidence, {MODULATES} AS modulates, global_key, global_wheel, round(global_confidence, 6) AS global_confidence, false AS abstained FROM (WITH timeline AS ({TIMELINE}) SELECT * FROM timeline t) t".replace("FROM timeline u WHERE", f"FROM ({TIMELINE}) u WHERE"))(
    lambda v: sg.key_timeline(dual(v), spans(v)).withColumn("confidence", r6(c("confidence"))).withColumn("global_confidence", r6(c("global_confidence")))
)
CHANGES = f"SELECT *, lag(wheel) OVER (PARTITION BY track_id ORDER BY segment) AS before, count(*) OVER (PARTITION BY track_id) AS n FROM ({TIMELINE}) t"
SHIFT = "CASE WHEN before IS NULL THEN concat('Opens ', key) ELSE concat('shifts to ', key, ' at ', CAST(CAST(round_even(start_s / 60, 0) AS INT) AS STRING), ':', lpad(CAST(CAST(start_s AS INT) % 60 AS STRING), 2, '0')) END"
query("f09_modulation_summary", f"SELECT track_id, CASE WHEN count(DISTINCT wheel) > 1 THEN string_agg({SHIFT}, ', ' ORDER BY segment) ELSE '' END AS summary FROM ({CHANGES}) h WHERE before IS NULL OR before <> wheel GROUP BY track_id")(
    lambda v: sg.modulation_summary(sg.key_timeline(dual(v), spans(v)))
)
WINDOWED = f"SELECT track_id, w AS segment, mode, tonic, avg(score) AS score FROM (SELECT *, unnest(range(CAST(greatest(floor(segment * 10 / 15.0) - 1, 0) AS BIGINT), CAST(floor(segment * 10 / 15.0) AS BIGINT) + 1)) AS w FROM ({EN}) z) y GROUP BY 1, 2, 3, 4"
query("l03_windowed_vote", f"SELECT *, sum(CASE WHEN share > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id) > 1 AS modulating FROM (SELECT track_id, mode, tonic, round(weight / sum(weight) OVER (PARTITION BY track_id), 6) AS share FROM (SELECT track_id, mode, tonic, sum(score) AS weight FROM ({winners_sql(WINDOWED)}) q WHERE score >= 0.3 GROUP BY 1, 2, 3) a) b")(
    lambda v: sg.windowed_vote(en(v), 10.0).select("track_id", "mode", "tonic", r6(c("share")).alias("share"), "modulating")
)
query("i18_onset_from_energy", f"SELECT track_id, frame, round(greatest(e - 0.9 * coalesce(lag(e) OVER (PARTITION BY track_id ORDER BY frame), e), 0), 6) AS onset FROM (SELECT track_id, frame, list_sum(list_transform(x, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))) AS e FROM ({FR}) f) g")(lambda v: sg.onset_from_energy(frames(v).select("track_id", "frame", c("x").alias("samples"))).withColumn("onset", r6(c("onset"))))
RISES = f"SELECT track_id, frame, CASE WHEN bin < 8 THEN 0 WHEN bin < 32 THEN 1 ELSE 2 END AS band, greatest(mag - coalesce(lag(mag) OVER (PARTITION BY track_id, bin ORDER BY frame), mag), 0) AS rise FROM ({SPEC}) s"
BANDED = f"SELECT track_id, frame, flux / max(flux) OVER (PARTITION BY track_id, band) AS x FROM (SELECT track_id, frame, band, sum(rise) AS flux FROM ({RISES}) r GROUP BY 1, 2, 3) a"
query("i23_spectral_flux", f"SELECT track_id, frame, round(avg(y) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS onset FROM (SELECT track_id, frame, t / max(t) OVER (PARTITION BY track_id) AS y FROM (SELECT track_id, frame, sum(x) AS t FROM ({BANDED}) b GROUP BY 1, 2) d) e")(
    lambda v: sg.spectral_flux(spectrogram(v), [8, 32]).withColumn("onset", r6(c("onset")))
)
GRID = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY is_override DESC, created_at DESC, source) AS rn FROM v_beat_grids) x WHERE rn = 1"
BEATS = f"SELECT track_id, source, CAST(beat AS INT) AS beat, first_beat_ms + beat * (60000.0 / bpm) AS ms, CAST(floor((beat - downbeat_offset_beats) / CAST(meter_numerator AS DOUBLE)) AS INT) AS bar, CAST((beat - downbeat_offset_beats + meter_numerator) % meter_numerator AS INT) AS beat_in_bar FROM (SELECT *, unnest(range(0, CAST(floor((60000 - first_beat_ms) / (60000.0 / bpm)) AS BIGINT) + 1)) AS beat FROM ({GRID}) g) h"


def beats(v):
    from ..operators.catalog import newest

    grid = newest(v("v_beat_grids"), ["track_id"], [c("is_override").desc(), c("created_at").desc(), c("source")])
    return sg.expand_grid(grid, F.lit(60000))


def in_force(v):
    tempos = v("v_beat_grids").groupBy("track_id", (c("first_beat_ms").cast("double") * 40).alias("start_ms")).agg(F.max("bpm").alias("bpm"))
    return sg.tempo_in_force(beats(v), tempos).select("track_id", "beat", r6(c("bpm")).alias("bpm"))


query("i24_beat_grid", f"SELECT track_id, source, beat, round(ms, 6) AS ms, bar, beat_in_bar, beat_in_bar = 0 AS is_downbeat FROM ({BEATS}) b")(lambda v: beats(v).withColumn("ms", r6(c("ms"))))
on_beats = lambda v: onset(v).where("frame % 12 = 0").select("track_id", (c("frame") / 12).cast("int").alias("beat"), "frame")
query("i25_snap_beats", f"SELECT b.track_id, CAST(b.frame / 12 AS INT) AS beat, coalesce((SELECT o.frame FROM ({O}) o WHERE o.track_id = b.track_id AND o.frame BETWEEN b.frame - 3 AND b.frame + 3 AND o.onset > b.onset ORDER BY o.onset DESC, o.frame LIMIT 1), b.frame) AS frame FROM ({O}) b WHERE b.frame % 12 = 0")(
    lambda v: sg.snap(on_beats(v), onset(v))
)
query("d12_beat_onset_window", f"SELECT b.track_id, b.frame AS at, max(o.onset) AS top FROM ({O}) b JOIN ({O}) o ON o.track_id = b.track_id AND o.frame BETWEEN b.frame - 3 AND b.frame + 3 WHERE b.frame % 12 = 0 GROUP BY 1, 2")(
    lambda v: on_beats(v).select("track_id", c("frame").alias("at"), F.explode(F.sequence(c("frame") - 3, c("frame") + 3)).alias("frame")).join(onset(v), ["track_id", "frame"]).groupBy("track_id", "at").agg(F.max("onset").alias("top"))
)
GAPS = f"SELECT track_id, list_sort(l)[len(l) // 2 + 1] AS gap FROM (SELECT track_id, list(gap) FILTER (WHERE gap IS NOT NULL) AS l FROM (SELECT track_id, (frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame)) * 512 / 22050.0 AS gap FROM ({O}) o WHERE frame % 12 = 0) a GROUP BY track_id) b"
query("i26_interval_bpm", f"SELECT track_id, round(CASE WHEN 60 / gap BETWEEN 66 AND 216 THEN 0.7 * 60 / gap + 36 ELSE 120 END, 6) AS bpm FROM ({GAPS}) g")(
    lambda v: sg.interval_bpm(on_beats(v), onset(v).select("track_id").distinct().withColumn("bpm", F.lit(120.0))).withColumn("bpm", r6(c("bpm")))
)
GUESSES = "SELECT k, m, w, pref, unnest(range(0, m)) AS off FROM (VALUES (0, 4, [1.0, 0.7, 0.8, 0.7], 1.05), (1, 3, [1.0, 0.7, 0.8], 1.0), (2, 2, [1.0, 0.7], 0.95), (3, 6, [1.0, 0.5, 0.6, 0.8, 0.5, 0.6], 1.0)) AS g(k, m, w, pref)"
METER = f"SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9) DESC, k, off) AS r FROM (SELECT track_id, k, m, off, avg(onset * CAST(w[(CAST(frame / 12 AS INT) + off) % m + 1] AS DOUBLE)) * CAST(max(pref) AS DOUBLE) AS score FROM ({O}) o CROSS JOIN ({GUESSES}) g WHERE frame % 12 = 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8) a"
query("i27_meter", f"SELECT t.track_id, CAST(coalesce(a.m, 4) AS INT) AS meter, CAST(coalesce(a.off, 0) AS INT) AS off, round(CASE WHEN a.score > 0 AND b.score > 0 THEN least(1.0, greatest(0.0, 1 - b.score / a.score)) ELSE 0 END, 6) AS confidence FROM (SELECT DISTINCT track_id FROM ({O}) o WHERE frame % 12 = 0) t LEFT JOIN ({METER}) a ON a.track_id = t.track_id AND a.r = 1 LEFT JOIN ({METER}) b ON b.track_id = t.track_id AND b.r = 2")(
    lambda v: sg.meter(on_beats(v), onset(v)).withColumn("confidence", r6(c("confidence")))
)
query("i28_beat_confidence", f"SELECT b.track_id, CAST(b.frame / 12 AS INT) AS beat, round(CASE WHEN m > 1e-10 THEN least(3.0, b.onset / m) / 3 ELSE 0 END, 6) AS confidence FROM (SELECT *, avg(onset) OVER (PARTITION BY track_id) AS m FROM ({O}) o) b WHERE b.frame % 12 = 0")(lambda v: sg.beat_confidence(on_beats(v), onset(v)).withColumn("confidence", r6(c("confidence"))))
AROUND = f"SELECT b.track_id, b.frame, greatest(max(o.onset), 0) AS m FROM ({O}) b JOIN ({O}) o ON o.track_id = b.track_id AND o.frame BETWEEN b.frame - 3 AND b.frame + 3 WHERE b.frame % 12 = 0 GROUP BY 1, 2"
query("i28_grid_confidence", f"SELECT a.track_id, round(0.6 * CASE WHEN m.mean > 1e-10 THEN least(5.0, avg(a.m) / m.mean) / 5 ELSE 0 END + 0.2, 6) AS confidence FROM ({AROUND}) a JOIN (SELECT track_id, avg(onset) AS mean FROM ({O}) o GROUP BY 1) m ON m.track_id = a.track_id GROUP BY a.track_id, m.mean")(
    lambda v: sg.grid_confidence(on_beats(v), onset(v), 0.5).withColumn("confidence", r6(c("confidence")))
)
PCM = f"SELECT track_id, frame, frame * 64 + i AS pos, CAST(x[i + 1] AS DOUBLE) AS x FROM ({FR}) f CROSS JOIN (SELECT unnest(range(0, 64)) AS i) n"
MOVED = f"SELECT *, CASE WHEN pos >= 6 THEN sum(x) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / 6 ELSE x END AS lo, lag(x) OVER (PARTITION BY track_id ORDER BY pos) AS px FROM ({PCM}) p"
POWER = f"SELECT track_id, count(*) FILTER (WHERE p > 3 * a AND p > 1.5 * b) AS hits FROM (SELECT *, avg(p) OVER (PARTITION BY track_id) AS a, lag(p) OVER (PARTITION BY track_id ORDER BY frame) AS b FROM (SELECT track_id, frame, avg(x * x) AS p FROM ({PCM}) q GROUP BY 1, 2) y) z GROUP BY 1"
SOUND = f"SELECT m.track_id, 20 * greatest(log10(sqrt(avg(x * x))), -60) AS loud, least(count(*) FILTER (WHERE (px >= 0) <> (x >= 0)) / (count(*) / 3200.0) * 1600, 20000) AS bright, max(hits) / greatest(count(*) / 3200.0, 0.1) AS dense, sum((x - lo) * (x - lo)) / (sum((x - lo) * (x - lo)) + sum(lo * lo) + 1e-10) AS share FROM ({MOVED}) m JOIN ({POWER}) w ON w.track_id = m.track_id GROUP BY 1"
query("i29_energy", f"SELECT track_id, round(loud, 6) AS loudness_db, round(bright, 6) AS centroid_hz, round(dense, 6) AS onset_density, round(share, 6) AS high_share, CAST(least(10, greatest(1, floor(1 + 0.15 * greatest(loud + 30, 0) + 0.001 * bright + 0.5 * dense + 2 * share + 0.5))) AS INT) AS energy_level FROM ({SOUND}) s")(
    lambda v: sg.energy(frames(v).select("track_id", "frame", c("x").alias("samples")), 3200).select("track_id", *(r6(c(x)).alias(x) for x in ("loudness_db", "centroid_hz", "onset_density", "high_share")), "energy_level")
)
query("i30_waveform", f"SELECT track_id, col AS \"column\", round(low / t, 6) AS low, round(mid / t, 6) AS mid, round(high / t, 6) AS high FROM (SELECT *, max(greatest(low, mid, high)) OVER (PARTITION BY track_id) AS t FROM (SELECT track_id, CAST(floor(frame / (greatest(n, 20) / 20.0)) AS INT) AS col, max(mag) FILTER (WHERE bin < 8) AS low, max(mag) FILTER (WHERE bin >= 8 AND bin < 32) AS mid, max(mag) FILTER (WHERE bin >= 32) AS high FROM (SELECT *, max(frame) OVER (PARTITION BY track_id) + 1 AS n FROM ({SPEC}) s) a GROUP BY 1, 2) b) x")(lambda v: sg.waveform(spectrogram(v), (8, 32), 20).select("track_id", "column", *(r6(c(x)).alias(x) for x in ("low", "mid", "high"))))
ZED = f"SELECT track_id, frame, bin, (mag - avg(mag) OVER (PARTITION BY track_id)) / (stddev_pop(mag) OVER (PARTITION BY track_id) + 1e-8) AS z FROM ({SPEC}) s WHERE bin < 12"
query("i31_feature_matrix", f"SELECT t.track_id, CAST(f AS INT) AS frame, CAST(i AS INT) AS i, round(coalesce(z, 0), 6) AS z FROM (SELECT DISTINCT track_id FROM ({SPEC}) s) t CROSS JOIN (SELECT unnest(range(0, 40)) AS f) a CROSS JOIN (SELECT unnest(range(0, 12)) AS i) b LEFT JOIN ({ZED}) z ON z.track_id = t.track_id AND z.frame = f AND z.bin = i")(
    lambda v: sg.feature_matrix(chroma(v), "c12", 40).select("track_id", F.posexplode("matrix").alias("frame", "row")).select("track_id", "frame", F.posexplode("row").alias("i", "z")).withColumn("z", r6(c("z")))
)
query("i32_time_roll")(lambda v: sg.time_roll(sg.feature_matrix(chroma(v), "c12", 40), "matrix", 7))
query("i32_augment", f"SELECT s.track_id, frame, CAST(h AS INT) AS shift, CAST((s.track_id % 24 % 12 + h + 12) % 12 + CASE WHEN s.track_id % 24 < 12 THEN 0 ELSE 12 END AS INT) AS label, CAST((bin + h + 12) % 12 AS INT) AS i, round(mag, 6) AS v FROM ({SPEC}) s CROSS JOIN (VALUES (-1), (1)) AS x(h) WHERE bin < 12")(
    lambda v: sg.augment(chroma(v).withColumn("label", (c("track_id") % 24).cast("int")), "c12", [-1, 1]).select("track_id", "frame", "shift", c("label").cast("int").alias("label"), F.posexplode("c12").alias("i", "v")).withColumn("v", r6(c("v")))
)
MAP = "SELECT track_id, CAST(first_beat_ms AS DOUBLE) * 40 AS start_ms, max(bpm) AS bpm FROM v_beat_grids GROUP BY 1, 2"
query("d13_tempo_in_force", f"SELECT b.track_id, b.beat, round(m.bpm, 6) AS bpm FROM ({BEATS}) b ASOF LEFT JOIN ({MAP}) m ON m.track_id = b.track_id AND m.start_ms <= b.ms")(in_force)

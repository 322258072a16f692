"""Accuracy of predictions against labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered

from ..functions import keys, scoring, text

c = F.col
LARGE = 150 * 1024 * 1024
# fixed values: file extensions that an analysis reads
EXTENSIONS = ["mp3", "wav", "flac", "ogg", "oga", "opus", "aiff", "aif", "m4a", "aac", "wma", "alac", "mkv", "mp4", "mov", "webm", "m4v", "avi", "flv", "mpg", "mpeg", "ts", "3gp"]


def classify(rows: DataFrame, files: DataFrame) -> DataFrame:
    """A corpus row's status, the first that holds: no file, too large, unsupported, no key, atonal, ready."""
    got = rows.join(files.select(c("path").alias("location"), c("length").alias("_size")), "location", "left")
    status = (
        F.when(c("_size").isNull(), "missing_file").when(c("_size") > LARGE, "large_mix").when(~F.coalesce(c("extension").isin(*EXTENSIONS), F.lit(False)), "unsupported")
        .when(F.coalesce("key", F.lit("")) == "", "no_key_label").when(c("key") == "All", "atonal").otherwise("ready")
    )
    return got.withColumn("status", status).drop("_size")


def status_counts(rows: DataFrame) -> DataFrame:
    """E13."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, seed: int, limit: int, stratum: str = "genre", by: str = "location") -> DataFrame:
    """the first of each stratum in a seeded order, then the seconds, and so on, to ``limit`` rows.

    The order inside a stratum is that of md5(seed, row); a row number needs no more than ``limit`` rows
    of a stratum, which Spark's window group limit keeps before the shuffle."""
    order = F.md5(F.concat(F.lit(str(seed)), c(by)))
    w = Window.partitionBy(stratum).orderBy("_h", by)
    ranked = rows.withColumn("_h", order).withColumn("pick", F.row_number().over(w)).where(c("pick") <= limit)
    return ranked.orderBy("pick", stratum).limit(limit).drop("_h")


def score(predictions: DataFrame) -> DataFrame:
    """Predictions with mirex, error, exact, tonic_ok, compatible, bpm_exact, bpm_octave, ratio; null where a truth or prediction lacks."""
    dim = keys.dim_key(predictions.sparkSession).select("code", "tonic", "is_major")
    columns = predictions.columns

    def told(df: DataFrame, code: str, at: str) -> DataFrame:
        """A code's tonic and mode as columns, from the 24 keys: expressions would be spelled out again in every score."""
        own = F.concat(keys.number(c(code)).cast("string"), F.when(keys.is_major(c(code)), "B").otherwise("A"))
        return df.withColumn("_c", own).join(F.broadcast(dim.toDF("_c", f"{at}t", f"{at}m")), "_c", "left").drop("_c")

    predictions = told(told(predictions, "truth_camelot", "_t"), "pred_camelot", "_p")
    tt, tm, pt, pm = c("_tt"), c("_tm"), c("_pt"), c("_pm")
    both = tt.isNotNull() & pt.isNotNull()
    mirex = F.when(both, scoring.mirex(pt, pm, tt, tm))
    tempo = c("pred_bpm").isNotNull() & c("truth_bpm").isNotNull()
    return predictions.select(
        *columns, text.normalize_genre(c("genre_raw")).alias("genre"), mirex.alias("mirex"), F.when(both, scoring.error_class(pt, pm, tt, tm)).alias("error"), F.when(both, (pt == tt) & (pm == tm)).alias("exact"),
        F.when(both, pt == tt).alias("tonic_ok"), (mirex > 0).alias("compatible"), F.when(tempo, scoring.within_one(c("pred_bpm"), c("truth_bpm"), False)).alias("bpm_exact"),
        F.when(tempo, scoring.within_one(c("pred_bpm"), c("truth_bpm"), True)).alias("bpm_octave"), F.when(tempo, scoring.bpm_ratio(c("pred_bpm"), c("truth_bpm"))).alias("ratio"),
        F.when(both, scoring.mirex_one_sided(pt, pm, tt, tm)).alias("mirex_one_sided"), keys.label24(tt, tm).alias("label"), keys.label24(pt, pm).alias("pred_label"),
    )


def partitions(scored: DataFrame) -> DataFrame:
    """Accuracy overall, by genre and by extension, in one pass of grouping sets. Key shares divide by all rows that
    did not fail, tempo shares by those with both tempos."""
    ok = scored.where("failure is null")
    share = lambda x: F.count_if(x) / F.count("*") * 100
    of_tempo = lambda x: F.try_divide(F.count_if(x) * F.lit(100.0), F.count("ratio"))
    got = ok.groupingSets([[], ["genre"], ["extension"]], "genre", "extension")
    return got.agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), share("exact").alias("exact_pct"), share("tonic_ok").alias("tonic_pct"), (F.sum(F.coalesce("mirex", F.lit(0.0))) / F.count("*")).alias("mirex"),
        share("compatible").alias("compatible_pct"), of_tempo("bpm_exact").alias("bpm_exact_pct"), of_tempo("bpm_octave").alias("bpm_octave_pct"),
    )


def report(scored: DataFrame) -> DataFrame:
    """The accuracy report as one JSON text: overall, by_genre, by_extension (arrays in order of name) and errors (a count a class).

    Its parts are bounded by genres, extensions and error classes; the records behind it are ``scored`` itself, a table of its own."""
    shares = ["n", "exact_pct", "tonic_pct", "mirex", "compatible_pct", "bpm_exact_pct", "bpm_octave_pct"]
    parts = partitions(scored)
    listed = lambda gid, by: F.array_sort(F.collect_list(F.when(c("gid") == gid, F.struct(c(by).alias("name"), *shares))))
    overall = F.max(F.when(c("gid") == 3, F.struct(*shares)))
    got = parts.agg(overall.alias("overall"), listed(1, "genre").alias("by_genre"), listed(2, "extension").alias("by_extension"))
    wrong = scored.where("failure is null and error is not null").groupBy("error").agg(F.count("*").alias("n"))
    errors = wrong.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors"))
    return got.crossJoin(errors).select(F.to_json(F.struct("overall", "by_genre", "by_extension", "errors")).alias("report"))


def error_map(scored: DataFrame, by: str = "genre") -> DataFrame:
    """Error class counts of each part, as a map."""
    n = scored.where("failure is null and error is not null").groupBy(by, "error").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors"))


def confusion(scored: DataFrame) -> DataFrame:
    """Cells of the 24 by 24 confusion matrix."""
    return scored.where("label is not null and pred_label is not null").groupBy("label", "pred_label").agg(F.count("*").alias("n"))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = confusion(scored)
    hit = cells.where("label = pred_label").select("label", c("n").alias("tp"))
    support, predicted = cells.groupBy("label").agg(F.sum("n").alias("support")), cells.groupBy(c("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    both = support.join(predicted, "label", "full_outer").join(hit, "label", "left").na.fill(0, ["support", "predicted", "tp"])
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return both.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def summary(scored: DataFrame) -> DataFrame:
    """Accuracy and mean scores of rows that have both keys, the fifth counted on one side."""
    return scored.where("error is not null").agg(F.count("*").alias("n"), F.avg(F.when(c("exact"), 1.0).otherwise(0.0)).alias("accuracy"), F.avg("mirex_one_sided").alias("mirex"), F.avg(F.when(c("error") == "relative", 1.0).otherwise(0.0)).alias("relative"), F.avg(F.when(c("error") == "parallel", 1.0).otherwise(0.0)).alias("parallel"))


def upper_median_of(values: DataFrame, column: str) -> DataFrame:
    """One row with the upper median of a column's values, none without any: values are sorted in ranges, and the one in the middle is
    read by its place. No task holds more than a range, whatever the number of distinct values."""
    placed = numbered(values.where(c(column).isNotNull()).select(column), [column], "median")
    return placed.crossJoin(placed.agg(F.floor(F.count("*") / 2).alias("_middle"))).where("at = _middle").select(column)


def run_summary(scored: DataFrame) -> DataFrame:
    """Upper median of the tempo ratios (1 if there are none), mean time of scored tracks, failures."""
    fine = c("failure").isNull()
    got = scored.agg(F.count_if(~fine).alias("failed"), F.avg(F.when(fine, c("total_ms"))).alias("mean_ms"))
    middle = upper_median_of(scored.where(fine).select(c("ratio").cast("double").alias("ratio")), "ratio")
    return got.join(middle, F.lit(True), "left").select(F.coalesce("ratio", F.lit(1.0)).alias("ratio_median"), "mean_ms", "failed")


def label_distribution(rows: DataFrame, by: str = "label") -> DataFrame:
    """E16."""
    return rows.where(c(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))


def split(rows: DataFrame, label: str, by: str, seed: int, folds: int, ranges: int = 64) -> DataFrame:
    """A fold for each row, dealt in hash order inside its label, so that folds are stratified to the row and repeatable.

    A label can hold most rows, so rows are numbered within ``ranges`` of the hash first, and each range starts where those before
    it end: no task has more than a range of a label."""
    h = F.md5(F.concat(F.lit(str(seed)), c(by).cast("string")))
    dealt = rows.withColumn("_h", h).withColumn("_range", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int"))
    sizes = dealt.groupBy(label, "_range").agg(F.count("*").alias("n"))
    before = sizes.select(c(label).alias("_label"), c("_range").alias("_at"), (F.sum("n").over(Window.partitionBy(label).orderBy("_range")) - c("n")).alias("_before"))
    w = Window.partitionBy(label, "_range").orderBy("_h", by)
    ranked = dealt.withColumn("_r", F.row_number().over(w) - 1).join(before, c(label).eqNullSafe(c("_label")) & (c("_range") == c("_at")))
    return ranked.withColumn("fold", F.pmod(c("_r") + c("_before"), F.lit(folds)).cast("int")).select(*rows.columns, "fold")

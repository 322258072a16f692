"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts are cut into windows of eight words, a window at every fourth word, so that each of a text's five-word shingles
lies in one window of four. A template has such a window at every word, so that one of them always begins where
a text's window does. A window's MinHash has BANDS values, each a band of its own (one row a band): the least of its shingles'
hashes under the order that band has. Two windows of shingle similarity s meet with probability 1 - (1 - s)**BANDS about: 0.99 at a
quarter, over 1 - 1e-11 at 0.8, always at 1. A template of fewer shingles than a window also meets windows of its own length,
at every word, so that an exact short notice is at similarity 1.

What a text's bands retrieve, and only that, is verified: retrieved texts are read again, and a template is reported where the text holds at
least 0.8 of its distinct shingles. Templates are a parameter of checked size, whose bands are the broadcast side of the retrieval. All of it
is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, table
from .license_templates import TEMPLATES

K = 5
SHINGLES = 4
BANDS = 16
CONTAINMENT = 0.8
#: Template windows of one scan, which bounds what is broadcast; larger template sets are scanned in several passes.
MOST_WINDOWS = 40_000


def _signed(x: int) -> int:
    return (x & (1 << 64) - 1) - ((x & 1 << 63) << 1)


#: By band the pattern whose exclusive or orders hashes: the top bits take every value, the rest is mixed.
ORDERS = [_signed(k * (1 << 64) // BANDS ^ ((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 4) for k in range(BANDS)]


def _words(text: Column) -> Column:
    """Lower-cased words without surrounding punctuation; words of punctuation only vanish."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.array_remove(F.split(plain, SPACES, -1), "")


def _windows(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, at (the word's number) and s0..s3, the hashes of the shingles that start at a word and the three after it (null
    beyond the text's end), for every word that starts a shingle."""
    hashed = df.select(*keep, F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)).alias("_w"))
    n = K + SHINGLES - 1
    # the words' hashes shifted against each other, side by side: no per-element lambda for the windows
    zipped = F.arrays_zip(*(F.slice("_w", F.lit(k + 1), F.greatest(F.size("_w") - k, F.lit(0))).alias(f"w{k}") for k in range(n)))
    rows = hashed.where(F.size("_w") >= K).select(*keep, F.posexplode(zipped).alias("at", "_z")).where(F.col(f"_z.w{K - 1}").isNotNull())
    rows = rows.select(*keep, "at", *(F.col(f"_z.w{k}").alias(f"w{k}") for k in range(n)))
    shingle = lambda j: F.xxhash64(*(F.col(f"w{j + k}") for k in range(K)))
    each = ((F.when(F.col(f"w{j + K - 1}").isNotNull(), shingle(j)) if j else shingle(0)).alias(f"s{j}") for j in range(SHINGLES))
    # a generator keeps filters on s0.. from being rewritten to hash the words again for each use
    return rows.select(*keep, "at", F.inline(F.array(F.struct(*each))))


def _bands() -> Column:
    """The values of a window's bands; nulls beyond a text's end do not count."""
    return F.array(*(F.least(*(F.col(f"s{j}").bitwiseXOR(F.lit(r)) for j in range(SHINGLES))) for r in ORDERS))


def _own_band(n: int) -> Column:
    """The one band of a window of n shingles, which windows of similarity 1 share; null if the text ends before."""
    least = F.least(*(F.col(f"s{j}") for j in range(n))) if n > 1 else F.col("s0")
    return F.when(F.col(f"s{n - 1}").isNotNull(), F.xxhash64(least, F.lit(n)))


def template_windows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, at, s0..s3 of every template window."""
    given = spark.createDataFrame([*templates.items()], "name string, body string").repartition(8)
    return materialize(_windows(given, ["name"], "body"), "license-templates")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_licenses, licenses (names with their containment, comma-joined by name).

    A row for each distinct key. Null and empty texts have none; texts of fewer than five
    words hold no shingle and match nothing; repeated keys are one document; no rows give no rows. Other columns, whatever their names, are
    not read. A very long text is cut into windows whole."""
    known = template_windows(docs.sparkSession, templates or TEMPLATES)
    sizes = {r["name"]: r["n"] for r in known.groupBy("name").agg(F.count("*").alias("n")).collect()}  # a row a template
    parts, size = [[]], 0
    for name, n in sorted(sizes.items()):
        if size + n > MOST_WINDOWS and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(name)
        size += n
    hits = reduce(DataFrame.unionByName, (_hits(docs, known.where(F.col("name").isin(p)), {n: sizes[n] for n in p}, key, text) for p in parts))
    ids = docs.select(F.col(key).alias("doc_id")).distinct()
    told = hits.groupBy("doc_id").agg(F.count("*").alias("n_licenses"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "share"))), lambda x: F.concat_ws(":", x["name"], F.format_string("%.3f", x["share"]))), ",").alias("licenses"))
    return ids.join(told, ids["doc_id"].eqNullSafe(told["doc_id"]), "left").select(ids["doc_id"], F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def retrieve(docs: DataFrame, known: DataFrame, sizes: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, name: the templates (``known``: their windows, ``sizes``: their numbers) that share a band with a document."""
    windows = _windows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body")), ["doc_id"], "body")
    short = sorted({n for n in sizes.values() if n < SHINGLES})
    of_size = lambda n: F.col("name").isin([x for x, m in sizes.items() if m == n])
    own = [known.where((F.col("at") == 0) & of_size(n)).select(_own_band(n).alias("band"), "name") for n in short]
    bands = reduce(DataFrame.unionByName, own, known.select(F.explode(_bands()).alias("band"), "name")).distinct()
    # every window's bands at every fourth word; at the others only bands of short windows can meet
    met = F.when(F.col("at") % SHINGLES == 0, _bands()).otherwise(F.array().cast("array<bigint>"))
    every = F.concat(met, F.array(*map(_own_band, short))) if short else met
    return windows.select("doc_id", F.explode(every).alias("band")).join(F.broadcast(bands), "band").select("doc_id", "name").distinct()


def _hits(docs: DataFrame, known: DataFrame, sizes: dict[str, int], key: str, text: str) -> DataFrame:
    """doc_id, name, share: retrieved templates of which a text holds CONTAINMENT or more."""
    retrieved = materialize(retrieve(docs, known, sizes, key, text), "license-candidates")
    asked = retrieved.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("name").alias("names"))  # of at most all templates
    # few documents have candidates; if many have, this is a shuffle of both sides
    again = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    again = again.join(asked, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    shingles = known.select("s0", "name").distinct()
    total = shingles.groupBy("name").agg(F.count("*").alias("total"))
    held = _windows(again, ["doc_id", "names"], "body").join(F.broadcast(shingles), "s0").where(F.array_contains("names", F.col("name")))
    counted = held.groupBy("doc_id", "name").agg(F.count_distinct("s0").alias("n"))
    share = F.col("n") / F.col("total")
    return counted.join(F.broadcast(total), "name").select("doc_id", "name", share.alias("share")).where(F.col("share") >= CONTAINMENT)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

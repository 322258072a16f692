"""Order MinHash fingerprints in DataFrame functions only.

k-mers are five words in a row, numbered by occurrence so that repeats count. Component j of COMPONENTS has an order of its own on
hashed k-mers: along the ring of all hashes from its anchor j / COMPONENTS on. It selects the two k-mers of least order,
puts them back in text order and hashes that tuple. Every component of a text of two k-mers or more so holds an order, and
equal components mean equal k-mers in equal order: moving blocks of text, which plain MinHash does not see, changes them.

Everything is array arithmetic inside a row. For the two sorts (by k-mer to number occurrences, by hash to select) a hash is packed into one long
with its place in as many low bits as the text needs, so that they run on primitive arrays; whatever goes into a fingerprint is read
back by place from the whole 64-bit hashes, so texts of all lengths have the same k-mers.

One ring of hashes stands for COMPONENTS permutations: in the mean that gives the likeness that independent ones give, but in a text of
few k-mers neighbouring components often select the same pair, so the likeness of two texts of n k-mers varies as that of about
min(n, COMPONENTS) independent components would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, range_bounds, range_bucket, table, words

K = 5
COMPONENTS = 64
EMPTY = "...."


def _mask(n: Column) -> Column:
    """The low bits that the places of n k-mers take."""
    bits = F.greatest(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def _pack(hashed: Column, mask: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(place.cast("long"))


def fingerprint_columns(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and column ``name``: COMPONENTS times four hex digits.

    Texts of one to five words are one k-mer, which every component hashes alone; null texts and those without words have only EMPTY. Ties
    of hashes go by place. Each step is a projection of its own that later steps read more than once, so none is evaluated again for every element.
    """
    keep = df.columns
    w, f, h, p, e, q, s = (f"_{name}_{x}" for x in "wfhpeqs")
    df = df.select(*keep, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias(w))
    n = F.size(w) - (K - 1)
    kmer = lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(K)))
    none = F.array().cast("array<bigint>")
    df = df.select(*keep, F.when(F.size(w) == 0, none).when(n < 1, F.array(F.xxhash64(F.col(w)))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), kmer)).alias(f))
    keep_f = [*keep, f]
    whole = lambda place: F.get(F.col(f), place.cast("int"))
    df = df.select(*keep_f, let(_mask(F.size(f)), lambda m: F.transform(f, lambda x, i: _pack(x, m, i))).alias(h))
    df = df.select(*keep_f, F.sort_array(h).alias(p))
    # places in the sorted array where another k-mer begins
    top = lambda m, j: F.get(F.col(p), j).bitwiseAND(F.bitwise_not(m))
    edges = let(_mask(F.size(p)), lambda m: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: (j == 0) | (top(m, j) != top(m, j - 1))))
    df = df.select(*keep_f, p, F.when(F.size(p) > 0, edges).otherwise(F.array().cast("array<int>")).alias(e))
    # occurrence numbers, aligned with the sorted k-mers: 1, 2, ... within each run
    runs = F.transform(e, lambda a, k: F.sequence(F.lit(1), F.coalesce(F.get(F.col(e), k + 1), F.size(p)) - a))
    numbered = let(_mask(F.size(p)), lambda m: F.zip_with(p, F.flatten(runs), lambda x, o: let(x.bitwiseAND(m), lambda at: _pack(F.xxhash64(whole(at), o), m, at))))
    df = df.select(*keep_f, numbered.alias(q))
    df = df.select(*keep_f, F.sort_array(q).alias(s))
    size, mask = F.size(s), _mask(F.size(s))

    def component(m: Column, steps: Column, anchor: Column) -> Column:
        # how many hashes are below the anchor: a binary search, each step half as wide
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= size) & (F.get(F.col(s), at + step - 1) < anchor), at + step).otherwise(at))

        def chosen(at: Column) -> Column:
            x, y = F.get(F.col(s), at % size).bitwiseAND(m), F.get(F.col(s), (at + 1) % size).bitwiseAND(m)
            pair = F.xxhash64(whole(F.least(x, y)), whole(F.greatest(x, y)))
            return F.when(size == 1, F.xxhash64(whole(x))).otherwise(pair)

        return let(below, chosen)

    digits = lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(0xFFFF)))), 4, "0")
    anchors = F.array(*(F.lit((j << 58) - (1 << 63)) for j in range(COMPONENTS)))
    halves = F.transform(F.sequence(F.ceil(F.log2(size + 1)).cast("int"), F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b))
    every = let(F.struct(mask.alias("m"), halves.alias("steps")), lambda t: F.transform(anchors, lambda a: digits(component(t["m"], t["steps"], a))))
    return df.select(*keep, F.when(size == 0, F.lit(EMPTY * COMPONENTS)).otherwise(F.array_join(every, "")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that either has; 1 if neither has any."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), lambda i: x.substr(4 * i + 1, F.lit(4)))
    both = F.zip_with(cut(a), cut(b), lambda u, v: F.when((u == EMPTY) & (v == EMPTY), 0).when(u == v, 2).otherwise(1))
    return F.aggregate(both, F.struct(F.lit(0).alias("some"), F.lit(0).alias("same")), lambda t, x: F.struct((t["some"] + F.when(x > 0, 1).otherwise(0)).alias("some"), (t["same"] + F.when(x == 2, 1).otherwise(0)).alias("same")), lambda t: F.when(t["some"] == 0, F.lit(1.0)).otherwise(t["same"] / t["some"]))


def with_next(df: DataFrame, key: str, columns: list[str], first: list[str], place: str | None = None) -> DataFrame:
    """``df`` with ``columns`` of the row that follows in ascending key order (after the last: the first)
    as ``next_<column>``. Null keys come first; ties are ordered by ``first``. ``place`` names a column that ascends in that order, without ties.

    Rows are dealt to key ranges; each range also gets a copy of the following range's first row,
    so nothing but one row a range crosses a border and no task sees the whole order.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("_range", range_bucket(F.col(key), range_bounds(df.select(key), key, ranges)))
    order = [F.col(key).asc_nulls_first(), *map(F.col, first)]
    least = F.struct((F.col(key).isNotNull()).alias("some"), F.col(key).alias("at"))
    # a row a range: its first key, found on the key column alone
    starts = cut.select("_range", key).groupBy("_range").agg(F.min(least)["at"].alias("at"))
    w = Window.orderBy("_range")
    last = Window.orderBy(F.col("_range").desc())
    before = F.coalesce(F.lag("_range").over(w), F.first("_range").over(last))
    moves = starts.select(before.alias("_to"), F.col("at").alias("_at"), F.col("_range").alias("_from"))
    copies = cut.join(F.broadcast(moves), (cut["_range"] == F.col("_from")) & cut[key].eqNullSafe(F.col("_at")))
    kept = [*dict.fromkeys([key, *columns, *first])]
    # copies of a later range stand behind all rows of theirs; of tied first rows only the first counts
    sent = copies.select(F.col("_to").alias("_range"), F.lit(1).alias("_copy"), *kept)
    rows = cut.withColumn("_copy", F.lit(0)).unionByName(sent, allowMissingColumns=True)
    at = Window.partitionBy("_range").orderBy("_copy", *order)
    number = [(F.col("_range") * (1 << 40) + F.row_number().over(at)).alias(place)] if place else []
    found = rows.select("*", *(F.lead(c).over(at).alias(f"next_{c}") for c in columns), *number)
    return found.where("_copy = 0").drop("_copy", "_range")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of op6_order_minhash for each row of ``docs``.

    Null texts are empty; the row after a row is the next in ascending key order, null keys first, tied keys by text (repeated rows follow each
    other); a single row follows itself; no rows give no rows. Other columns of ``docs`` are never read, so their names cannot clash."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    both = with_next(rows, "doc_id", ["body"], ["body"], "place")
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("body").substr(F.lit(1), n - half), F.col("next_body").substr(F.lit(1), half))
    own = fingerprint_columns(both.select("doc_id", "place", n.cast("long").alias("n_chars"), edited.alias("edited"), "body"), "body", "fingerprint")
    done = fingerprint_columns(own.drop("body"), "edited", "edited_fingerprint")
    # each text is fingerprinted once; the next one's fingerprint comes from this table of a row a document
    table_ = materialize(done.select("doc_id", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "order-minhash")
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(x) for c, x in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return with_next(table_, "place", ["fingerprint"], []).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))

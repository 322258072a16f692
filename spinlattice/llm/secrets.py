"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

A scan finds candidate spans with regular expressions on whole texts. Candidate values are
aggregated over the corpus by distinct repositories and owners: a value that
several owners have, or many repositories of one or two owners, is a widely copied example; one that few repositories of a single
owner or two have looks live. Pattern kinds always report their spans and carry the verdict; the opaque kind (long
mixed-case strings with digits) reports only values that look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize, table

# fixed values: the base kinds' patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group of the value, least characters of the value; in the order of ties
KINDS = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}", 0, 24),
)
BASE = ("assign", "access", "hex")
#: A value that so many owners, or repositories of whatever owners, have is a widely copied example.
SHARED_OWNERS, SHARED_REPOS = 3, 4
_STEP = 256


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _starts(lengths: Column, pieces: Column) -> Column:
    """Start of match k: all before it, and the piece before it. Two-level sums keep
    texts with very many matches from costing the square of their number."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")), lambda b: _sum(F.slice(lengths, b * _STEP + 1, F.lit(_STEP))))
    from_block = lambda k: F.floor(k / _STEP).cast("int")
    start = lambda bs: F.transform(lengths, lambda _, k: _sum(F.slice(bs, F.lit(1), from_block(k))) + _sum(F.slice(lengths, from_block(k) * _STEP + 1, k % _STEP)) + F.char_length(F.get(pieces, k)))
    return F.get(F.transform(F.array(blocks), start), 0)


_SPAN = "array<struct<start:int,rank:int,finish:int,kind:string,value:string>>"


def _spans(text: Column, found: Column, rank: int) -> Column:
    """Spans of one kind: code points, end exclusive. ``found`` holds the pattern's matches."""
    kind, pattern, group, least = KINDS[rank]
    pieces = F.split(text, pattern, -1)

    def build(p: Column) -> Column:
        both = F.zip_with(F.slice(p, F.lit(1), F.size(found)), found, lambda a, m: F.char_length(a) + F.char_length(m))

        def spans(at: Column) -> Column:
            value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
            every = F.zip_with(at, found, lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.char_length(m)).alias("finish"), F.lit(kind).alias("kind"), value(m).alias("value")))
            return F.filter(every, lambda x: F.char_length(x["value"]) >= least)

        return F.get(F.transform(F.array(F.get(F.transform(F.array(both), lambda b: _starts(b, p)), 0)), spans), 0)

    made = F.get(F.transform(F.array(pieces), build), 0)
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs``: the columns ``carry`` as c0, c1, ..., rid and spans (all kinds, sorted
    by start, then kind). Null texts are empty."""
    carry = carry or []
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = rows.select("*", *(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)).alias(f"m{i}") for i, (_, pattern, _, _) in enumerate(KINDS)))
    every = F.array_sort(F.concat(*(_spans(F.col("body"), F.col(f"m{i}"), i) for i in range(len(KINDS)))))
    return found.select(F.monotonically_increasing_id().alias("rid"), *(f"c{i}" for i in range(len(carry))), every.alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``candidates`` (digest, owner, repo): digest, owners, repos, found (occurrences), live. Null owners count as one owner.

    Distinct triples, then two sums: each step combines within tasks before it shuffles, so a value in
    a third of all rows is a few rows by the time it moves."""
    named = candidates.select("digest", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    by_repo = named.groupBy("digest", "owner", "repo").agg(F.count("*").alias("found"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("n"), F.sum("found").alias("found"))
    got = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"), F.sum("found").alias("found"))
    return got.withColumn("live", (F.col("owners") < SHARED_OWNERS) & (F.col("repos") < SHARED_REPOS))


def judged(scanned: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """rid, spans with their verdicts (array of start, rank, finish, kind, live, owners, repos), for rows that have any.

    Opaque candidates that are widely copied are left out."""
    each = scanned.select("rid", owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.explode("spans").alias("s"))
    each = each.select("rid", "owner", "repo", F.md5("s.value").alias("digest"), "s.start", "s.rank", "s.finish", "s.kind")
    verdicts = materialize(ownership(each), "secrets-verdicts")
    told = join_hot(each.drop("owner", "repo"), verdicts, "digest", "found", F.col("rid")).where((F.col("kind") != "opaque") | F.col("live"))
    return told.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "finish", "kind", "live", "owners", "repos"))).alias("told"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Counts, digests and spans for each row of ``docs``; the columns as op4_secrets returns them, with the distinct owners and repositories
    of every span's value (owners_repos, owners:repositories by span). The tables at hand name no repository: source and language stand for one.

    Null and empty texts have no spans; repeated rows are rows of their own (and one owner);
    no rows give no rows; other columns of ``docs`` are never read. Spans of different kinds may overlap and all count; of one kind they are
    leftmost and do not. A very long text is scanned whole."""
    carry = [key, owner, *repo]
    scanned = materialize(scan(docs, text, carry), "secrets")
    place = F.concat_ws("/", *(F.coalesce(F.col(f"c{2 + i}").cast("string"), F.lit("")) for i in range(len(repo))))
    told = judged(scanned, F.col("c1"), place)
    base = scanned.select("rid", F.col("c0").alias("doc_id"), F.filter("spans", lambda s: s["kind"].isin(*BASE)).alias("base"))
    both = base.join(told, "rid", "left").withColumn("told", F.coalesce("told", F.expr("cast(array() as array<struct<start:int,rank:int,finish:int,kind:string,live:boolean,owners:bigint,repos:bigint>>)")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return both.select(
        "doc_id", *map(count, BASE), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("told")).alias("spans"),
        F.size(F.filter("told", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("told", lambda s: ~s["live"])).cast("long").alias("n_shared"),
        _text_of(F.filter("told", lambda s: s["live"])).alias("live_spans"),
        F.array_join(F.transform("told", lambda s: F.concat_ws(":", s["owners"], s["repos"])), ",").alias("owners_repos"),
    )


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), live: str = "[SECRET]", shared: str = "[EXAMPLE]") -> DataFrame:
    """``docs`` with every span replaced: those that look live by ``live``, widely copied ones by
    ``shared``. Overlapping spans become one, live if any of them is. All columns and rows stay, whatever their names; null and empty texts stay as
    they are, rows that repeat are redacted alike, an empty table stays empty. A very long text is scanned whole."""
    columns = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    scanned = materialize(scan(docs, text, columns), "secrets")
    place = F.concat_ws("/", *(F.coalesce(F.col(at[c]).cast("string"), F.lit("")) for c in repo))
    told = judged(scanned, F.col(at[owner]), place)
    # rows without spans need no join: only the others move
    without = scanned.where(F.size("spans") == 0)
    some = scanned.where(F.size("spans") > 0).join(told, "rid", "left")
    body = F.col(at[text])

    def merged(t: Column) -> Column:
        """Disjoint spans in order; a fold over one text's few spans."""
        empty = F.expr("cast(array() as array<struct<a:int,b:int,live:boolean>>)")

        def step(acc: Column, s: Column) -> Column:
            one = F.struct(s["start"].alias("a"), s["finish"].alias("b"), s["live"].alias("live"))
            last = F.try_element_at(acc, F.lit(-1))
            wider = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["finish"]).alias("b"), (last["live"] | s["live"]).alias("live"))
            grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))
            return F.when((F.size(acc) > 0) & (s["start"] < last["b"]), grown).otherwise(F.concat(acc, F.array(one)))

        return F.aggregate(t, empty, step)

    spans = F.when(F.col("told").isNull(), F.expr("cast(array() as array<struct<a:int,b:int,live:boolean>>)")).otherwise(merged(F.col("told")))

    def replaced(ss: Column) -> Column:
        before = F.transform(ss, lambda s, k: F.concat(body.substr(F.when(k == 0, 0).otherwise(F.get(ss, k - 1)["b"]) + 1, s["a"] - F.when(k == 0, 0).otherwise(F.get(ss, k - 1)["b"])), F.when(s["live"], F.lit(live)).otherwise(F.lit(shared))))
        rest = body.substr(F.try_element_at(ss, F.lit(-1))["b"] + 1, F.char_length(body))
        return F.when(F.size(ss) == 0, body).otherwise(F.concat(F.array_join(before, ""), rest))

    clean = F.get(F.transform(F.array(spans), replaced), 0)
    kept = [clean.alias(c) if c == text else F.col(at[c]).alias(c) for c in columns]
    return some.select(*kept).unionByName(without.select(*(F.col(at[c]).alias(c) for c in columns)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

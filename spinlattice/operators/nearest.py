"""The nearest items on a line, for many places at once and in many cells, without pairs and without a task a cell.

Items are laid out in lanes: upwards and downwards by value, those without a value by id, and all by id. One
sorted layout of all lanes and cells, cut into ranges of rows wherever a cell begins or ends, numbers the items; a place asked for
finds its number in the same pass, and its nearest items are the next ones in two lanes. A range knows the next items beyond its
border by a halo of as many rows as are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

c = F.col
#: Rows of a block of the layout.
BLOCK = 256
ENTRY = "struct<id:bigint,x:double>"


def _lanes(*lanes: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("lane"), s.cast("double").alias("s")) for name, s in lanes))


def _laid(items: DataFrame, first: int | None) -> DataFrame:
    """cell, id, x, lane, s of items (cell, id, x); of one place in a lane the ``first`` by id, or all. The limit is kept
    before rows are dealt by place, so a place that most items share is not one task's work."""
    zero = F.lit(0.0)
    timed, blank = _lanes(("up", c("x")), ("down", -c("x")), ("every", zero)), _lanes(("blank", zero), ("every", zero))
    rows = items.select("cell", "id", "x", F.inline(F.when(c("x").isNull(), blank).otherwise(timed)))
    if first is None:
        return rows
    by_id = Window.partitionBy("lane", "cell", "s").orderBy("id")
    return rows.withColumn("_r", F.row_number().over(by_id)).where(c("_r") <= first).drop("_r")


def _places(wanted: DataFrame, far: bool) -> DataFrame:
    """cell, x, lane, s: where wanted (cell, x) looks; without a value only at the lane of all."""
    zero = F.lit(0.0)
    timed = [("up", c("x")), ("down", -c("x")), ("blank", zero), *([("every", zero)] if far else [])]
    return wanted.select("*", F.inline(F.when(c("x").isNull(), _lanes(("every", zero))).otherwise(_lanes(*timed))))


def _numbered(laid: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items with their number ``at`` in the layout, and the distinct places with that of the first item not before them.

    A place stands before items of its own value, but in the lane downwards behind them, which
    has them already upwards. The driver holds one number a range."""
    kind = F.when(c("lane") == "down", 2).otherwise(0)
    marks = places.select("lane", "cell", "s").distinct().select("*", kind.alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("x"))
    rows = laid.select("lane", "cell", "s", F.lit(1).alias("kind"), "id", "x").unionByName(marks)
    order = ["lane", "cell", "s", "kind", "id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    table = materialize(dealt, "layout").withColumn("_part", F.shiftright("_row", 33).cast("int"))
    offsets, before = [], 0
    for r in sorted(table.groupBy("_part").agg(F.count_if(c("kind") == 1).alias("n")).collect()):  # one row a range
        offsets.append((r["_part"], before))
        before += r["n"]
    known = laid.sparkSession.createDataFrame(offsets, "_part int, _before long")
    here = F.sum(F.when(c("kind") == 1, 1).otherwise(0)).over(Window.partitionBy("_part").orderBy("_row"))
    got = table.withColumn("_here", here).join(F.broadcast(known), "_part").withColumn("at", c("_before") + c("_here"))
    return got.where("kind = 1").select("cell", "id", "x", "lane", (c("at") - 1).alias("at")), got.where("kind <> 1").select("lane", "cell", "s", "at")


def nearest(items: DataFrame, wanted: DataFrame, m: int, far: bool = False) -> DataFrame:
    """For distinct ``wanted`` (cell, x) the columns up, down, blank and every: of the items (cell, id, x) of that cell the ``m`` nearest at or above x
    and below it, the ``m`` of least id that have no x, and the ``m`` of least id of all (where x is null, or with ``far``); each an array of (id, x), ties by
    id, null where nothing is asked for or found."""
    laid = _laid(items, m)
    numbered, marks = _numbered(laid, _places(wanted, far))
    rows = max(BLOCK, m)
    block = F.expr(f"at div {rows}")
    # a block's rows once, in order, and the m - 1 first ones of the next as its halo: a place takes the m from its own on
    halo = F.array_compact(F.array(block, F.when(c("at") % rows < m - 1, block - 1)))
    held = numbered.withColumn("_block", F.explode(halo)).groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("at", "lane", "cell", "id", "x"))).alias("_held"))
    found = marks.withColumn("_block", block).join(held, "_block")
    next_ = F.slice("_held", (c("at") - c("_block") * rows + 1).cast("int"), m)
    own = F.filter(next_, lambda e: (e["lane"] == c("lane")) & e["cell"].eqNullSafe(c("cell")))
    found = found.select("lane", "cell", "s", F.transform(own, lambda e: F.struct(e["id"].alias("id"), e["x"].alias("x"))).alias("near")).where(F.size("near") > 0)
    out = wanted
    for lane, x in (("up", c("s")), ("down", -c("s"))):
        out = out.join(found.where(c("lane") == lane).select("cell", x.alias("x"), c("near").alias(lane)), ["cell", "x"], "left")
    for lane in ("blank", "every"):  # a row a cell
        out = out.join(found.where(c("lane") == lane).select("cell", c("near").alias(lane)), "cell", "left")
    asked = {"blank": c("x").isNotNull(), "every": c("x").isNull() | F.lit(far)}
    return out.withColumns({lane: F.when(ok, c(lane)) for lane, ok in asked.items()})


def nearest_deep(items: DataFrame, asks: DataFrame) -> DataFrame:
    """Like :func:`nearest`, but each ask (ask, cell, x, depth) has a depth of its own, and every item found is a row: ask, cell, id, x. The work is
    that of the depths, whatever the deepest; rows are those of the blocks that an ask's run meets."""
    laid = _laid(items, None)
    places = _places(asks, False)
    numbered, marks = _numbered(laid, places)
    block = lambda at: F.floor(at / F.lit(BLOCK)).cast("long")
    blocks = numbered.groupBy(block(c("at")).alias("_block")).agg(F.collect_list(F.struct("at", "lane", "cell", "id", "x")).alias("_held"))
    runs = places.join(marks, ["lane", "cell", "s"]).withColumn("_block", F.explode(F.sequence(block(c("at")), block(c("at") + c("depth") - 1))))
    hit = F.filter("_held", lambda e: (e["at"] >= c("at")) & (e["at"] < c("at") + c("depth")) & (e["lane"] == c("lane")) & (e["cell"] == c("cell")))
    return runs.join(blocks, "_block").select("ask", "cell", F.explode(hit).alias("_e")).select("ask", "cell", "_e.id", "_e.x")

"""Operators along an ordered chain: windows, runs, fragments, hotspot lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.scale import SEGMENT_ROWS, blocked, running, with_ordinals


def best_window(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 12, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Start of the best full window of ``size`` rows per chain (first one on ties); short chains give none.

    ``order`` has to be total. Totals are compared as exact decimal sums (18 places), so the order of addition breaks no tie;
    only a chain with a value that no such decimal holds is compared by its floating-point sums.
    """
    numbered = with_ordinals(df.select(*keys, *order, F.col(value).alias("_v")), keys, order, "pos", segment_rows)
    exact = f"decimal({38 - len(str(size))}, 18)"  # leaves room for the sum
    numbered = numbered.withColumn("_x", F.col("_v").try_cast(exact))
    rows, parts = blocked(numbered, keys, "pos", 0, size - 1, segment_rows)
    w = Window.partitionBy(*parts).orderBy("pos").rowsBetween(0, size - 1)
    odd = F.col("_v").isNotNull() & F.col("_x").isNull()
    sums = rows.select(*keys, "pos", "_ghost", F.sum("_v").over(w).alias("total"), F.sum("_x").over(w).alias("_exact"), F.count("*").over(w).alias("_c"), F.max(odd).over(w).alias("_odd"))
    full = sums.filter(~F.col("_ghost") & (F.col("_c") == size))
    first = (-F.col("pos")).alias("neg")
    best = full.groupBy(*keys).agg(F.max(F.struct("_exact", first, "total")).alias("_e"), F.max(F.struct("total", first)).alias("_f"), F.bool_or("_odd").alias("_odd"))
    pick = lambda c: F.when(F.col("_odd"), F.col(f"_f.{c}")).otherwise(F.col(f"_e.{c}"))
    return best.select(*keys, (-pick("neg")).alias("start"), pick("total").alias("total"))


def state_runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    member: Column,
    number: str | None = None,
    longer_than: int = 10,
    strict_compat: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Runs of consecutive member rows longer than ``longer_than``.

    ``number`` is the residue number (rows are consecutive if it grows by one; default: every next
    row is). ``strict_compat`` keeps two published oddities: the row after a numbering gap belongs
    to no run, and a run still open at the end of the chain is not reported.
    """
    src = df.withColumn("_m", member)
    numbered = with_ordinals(src, keys, order, "pos", segment_rows)
    num = F.col(number) if number else F.col("pos")
    numbered = numbered.withColumn("_num", num)
    rows, parts = blocked(numbered, keys, "pos", 1, 1, segment_rows)
    w = Window.partitionBy(*parts).orderBy("pos")
    rows = (
        rows.withColumn("_pm", F.lag("_m").over(w))
        .withColumn("_adjacent", F.coalesce(F.lag("_num").over(w) == F.col("_num") - 1, F.lit(False)))
        .withColumn("_last", F.lead("pos").over(w).isNull())
        .filter(~F.col("_ghost"))
        .drop("_ghost", "_block")
    )
    if strict_compat:
        inside = F.col("_m") & F.col("_adjacent")
        starts = ~inside
    else:
        inside = F.col("_m")
        starts = ~F.col("_m") | ~F.coalesce(F.col("_pm"), F.lit(False)) | ~F.col("_adjacent")
    islands = running(rows.withColumn("_in", inside), keys, ["pos"], {"_island": F.when(starts, 1).otherwise(0).cast("long")}, segment_rows)
    runs = islands.filter("_in").groupBy(*keys, "_island").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("length"), F.max("_last").alias("_open")
    )
    runs = runs.filter(F.col("length") > longer_than)
    if strict_compat:
        runs = runs.filter(~F.col("_open"))
    return runs.drop("_open", "_island")


def fragments(df: DataFrame, keys: list[str], order: list[str], terminator: Column, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Fragment number per row, from 1; a terminator row closes its own fragment."""
    out = running(df.withColumn("_t", F.when(terminator, 1).otherwise(0).cast("long")), keys, order, {"_c": F.col("_t")}, segment_rows)
    return out.withColumn("fragment", F.col("_c") - F.col("_t") + 1).drop("_c", "_t")


def fragment_spans(df: DataFrame, keys: list[str], resid: str, serial: str) -> DataFrame:
    """First residue and length per fragment, by the residue numbers of its first and last atom row."""
    first, last = F.min_by(resid, serial), F.max_by(resid, serial)
    return df.groupBy(*keys).agg(first.alias("start"), (last - first + 1).alias("length"))


def model_numbers(df: DataFrame, keys: list[str], order: list[str], is_model: Column, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Model counter while reading a text: rows before the first MODEL line belong to model 0 too."""
    out = running(df.withColumn("_t", F.when(is_model, 1).otherwise(0).cast("long")), keys, order, {"_c": F.col("_t")}, segment_rows)
    return out.withColumn("model", F.greatest(F.col("_c") - 1, F.lit(0)).cast("int")).drop("_c", "_t")


def trim_hotspots(hotspots: Column, span: int = 15, gap: int = 2) -> Column:
    """Drop outlying first or last hotspots of a sorted list while the end gaps exceed ``gap``.

    Applies only where the list spans ``span`` or more at the start; the span is not looked at again.
    """
    n = F.size(hotspots)
    at = lambda i: F.get(hotspots, (i - 1).cast("int"))
    state = F.struct(F.lit(1).alias("lo"), n.alias("hi"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        room = (s["hi"] > s["lo"]) & ~s["done"]
        front = room & (at(s["lo"] + 1) - at(s["lo"]) > gap)
        back = room & ~front & (at(s["hi"]) - at(s["hi"] - 1) > gap)
        return F.struct(
            (s["lo"] + F.when(front, 1).otherwise(0)).alias("lo"),
            (s["hi"] - F.when(back, 1).otherwise(0)).alias("hi"),
            (~front & ~back).alias("done"),
        )

    safe = F.when(n >= 2, F.aggregate(hotspots, state, step)).otherwise(state)
    trimmed = F.slice(hotspots, safe["lo"], safe["hi"] - safe["lo"] + 1)
    wide = (n >= 2) & (F.element_at(hotspots, -1) - F.element_at(hotspots, 1) >= span)
    return F.when(wide, trimmed).otherwise(hotspots)

"""White-space ranking: where demand is high and a category is scarce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import clip, display_name
from gridloom.operators.features import kring_sum
from gridloom.operators.normalize import apply_bounds, fit_bounds
from gridloom.operators.order import running
from gridloom.sources.store import kept

DEMAND = {"poi_count": 0.4, "amenity_count": 0.3, "transit_stop_count": 0.3}


def categories(counts: DataFrame, least: int = 10, scope: str | None = None) -> DataFrame:
    """(scope?, category, total, n_cells, display_name) of categories with ``least`` points or more."""
    keys = [scope] if scope else []
    totals = counts.groupBy(*keys, "category").agg(F.sum("count").alias("total"), F.count("*").alias("n_cells")).where(F.col("total") >= least)
    return totals.withColumn("display_name", display_name(F.col("category"))).orderBy(*keys, F.desc("total"), "category")


def demand(cells: DataFrame, bounds: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """(cell_id, scope?, demand_proxy)."""
    bounds = fit_bounds(cells, list(DEMAND), scope) if bounds is None else bounds
    total = None
    for feature, weight in DEMAND.items():
        term = F.lit(weight) * F.col(f"n_{feature}")
        total = term if total is None else total + term
    return apply_bounds(cells, bounds, list(DEMAND), scope).select("cell_id", *([scope] if scope else []), total.alias("demand_proxy"))


def _raw(kring: Column, most: Column) -> Column:
    saturation = F.when(most > 0, kring / (most + 1)).otherwise(0.0)
    return clip(F.col("demand_proxy") * (1.0 - saturation))


def _ranked(asked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _down, the rank of a cell from the highest demand on (ties: smaller id first), and _up, from the lowest.

    Demands that agree in nine decimals are ties. No task holds all cells.
    """
    ranked = running(asked, keys, [F.desc(_nine("demand_proxy")), F.col("cell_id")])
    return ranked.withColumn("_down", F.col("_before") + 1).withColumn("_up", F.col("_all") - F.col("_before")).drop("_before", "_all")


def _nine(c: str) -> Column:
    return F.floor(F.col(c) * 1e9 + 0.5)


_BLOCK = 4096


def _free(rows: DataFrame, keys: list[str], rank: str, n: int = 1) -> DataFrame:
    """(keys, rank): the n least ranks from 1 on that none of a group's rows has; a row of rank 0 holds none.

    Ranks are put in blocks, whose rows are counted. Only these counts are walked in order; the ranks
    themselves are gathered for the blocks before which fewer than n ranks are free, and for no others.
    """
    at = F.col(rank) - 1
    placed = rows.select(*keys, F.floor(at / _BLOCK).alias("_block"), at.alias("_at"))
    blocks = placed.groupBy(*keys, "_block").agg(F.count_if(F.col("_at") >= 0).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_block")
    after = F.coalesce(F.lag("_block").over(order), F.lit(-1)) + 1  # the first block behind the one before
    walked = blocks.select(*keys, "_block", after.alias("_after"), F.lead("_block").over(order).isNull().alias("_last"), (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    few = walked.where(F.col("_after") * _BLOCK - F.col("_before") < n)
    # _BLOCK numbers at most in a list
    few = few.join(placed, [*keys, "_block"]).groupBy(*keys, "_block", "_after", "_last").agg(F.collect_list((F.col("_at") % _BLOCK).cast("int")).alias("_held"))
    none = F.array().cast("array<bigint>")
    stretch = lambda low, high: F.when(low < high, F.sequence(low, F.least(high, low + n) - 1)).otherwise(none)
    start = F.col("_block") * _BLOCK
    gap = F.when(F.col("_block") > 0, stretch(F.col("_after") * _BLOCK, start)).otherwise(none)
    own = F.when(F.col("_block") >= 0, F.transform(F.array_except(F.sequence(F.lit(0), F.lit(_BLOCK - 1)), "_held"), lambda i: i + start)).otherwise(none)
    end = F.when(F.col("_last"), stretch(start + _BLOCK, start + _BLOCK + n)).otherwise(none)
    found = few.select(*keys, F.explode(F.concat(gap, F.slice(own, 1, n), end)).alias("_at"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= n).select(*keys, (F.col("_at") + 1).alias(rank))


def _parts(counts: DataFrame, cells: DataFrame, k: int, keys: list[str], scope: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of the cells that a category reaches; all cells by demand; ranks that a category's rows hold, and its bounds."""
    counts = kept(counts, "counts")  # read four times below
    ranked = _ranked(demand(cells, scope=scope), keys)
    ring = kring_sum(counts, cells, "count", "cat_count_kring", k, by=("category",), scope=scope)
    own = counts.select("cell_id", *keys, "category", F.col("count").alias("cat_count_cell"))
    rows = ring.join(own, ["cell_id", *keys, "category"], "left").fillna(0, subset=["cat_count_cell"]).join(ranked, ["cell_id", *keys])
    rows = kept(rows.join(rows.groupBy(*keys, "category").agg(F.max("cat_count_kring").alias("_most")), [*keys, "category"]), "opportunity")
    rows = rows.withColumn("saturation", F.col("cat_count_kring") / (F.col("_most") + 1)).withColumn("opportunity_raw", _raw(F.col("cat_count_kring"), F.col("_most")))
    names = counts.select(*keys, "category").distinct()
    held = rows.select(*keys, "category", "_down", "_up").union(names.select(*keys, "category", F.lit(0), F.lit(0)))
    edges = names.join(rows.groupBy(*keys, "category").agg(F.max("opportunity_raw").alias("_max"), F.min("opportunity_raw").alias("_min")), [*keys, "category"], "left")
    for way, name in (("_down", "_best"), ("_up", "_worst")):
        at = ranked.select(*keys, way, F.col("demand_proxy").alias(name))
        edges = edges.join(_free(held, [*keys, "category"], way), [*keys, "category"]).join(at, [*keys, way], "left").drop(way)
    free = lambda name: F.when(F.col(name).isNotNull(), clip(F.col(name)))  # noqa: E731  (null where every cell has a row)
    edges = edges.select(*keys, "category", F.greatest("_max", free("_best")).alias("_high"), F.least("_min", free("_worst")).alias("_low"))
    return rows, ranked, held, edges


def _scaled() -> Column:
    span = F.col("_high") - F.col("_low")
    return F.when(span > 0, clip((F.col("opportunity_raw") - F.col("_low")) / F.nullif(span, F.lit(0.0)))).otherwise(F.col("opportunity_raw"))


def opportunity(counts: DataFrame, cells: DataFrame, k: int = 2, scope: str | None = None) -> DataFrame:
    """Sparse opportunities: a row for each category and cell that a point of it reaches within k steps.

    Cells without a row have saturation 0, hence ``demand_proxy`` as raw value. They still count in
    the minimum and maximum that raw values are scaled by, without ever being listed: the least rank
    by demand that none of a category's rows has tells the best-placed cell that has no row, and
    likewise from the other end. ``scope``: a column of both tables; ids of two cities may coincide.

    Columns: cell_id, scope?, category, cat_count_cell, cat_count_kring, demand_proxy, saturation,
    opportunity_raw, opportunity.
    """
    keys = [scope] if scope else []
    rows, _, _, edges = _parts(counts, cells, k, keys, scope)
    return rows.join(edges, [*keys, "category"]).select("cell_id", *keys, "category", "cat_count_cell", "cat_count_kring", "demand_proxy", "saturation", "opportunity_raw", _scaled().alias("opportunity"))


def top_opportunities(counts: DataFrame, cells: DataFrame, n: int = 10, k: int = 2, scope: str | None = None) -> DataFrame:
    """(cell_id, scope?, category, cat_count_cell, cat_count_kring, demand_proxy, opportunity, rank): the n best cells of each category.

    The best of all cells, while only the sparse rows are ranked and, for each category, the n cells of
    highest demand that it does not reach. Opportunities that agree in nine decimals are ties, which
    go to the smaller id.
    """
    keys = [scope] if scope else []
    rows, ranked, held, edges = _parts(counts, cells, k, keys, scope)
    wide_open = _free(held, [*keys, "category"], "_down", n).join(ranked, [*keys, "_down"]).select("cell_id", *keys, "category", F.lit(0).cast("long").alias("cat_count_cell"), F.lit(0).cast("long").alias("cat_count_kring"), "demand_proxy", clip(F.col("demand_proxy")).alias("opportunity_raw"))
    both = rows.select(*wide_open.columns).union(wide_open).join(edges, [*keys, "category"]).withColumn("opportunity", _scaled())
    order = Window.partitionBy(*keys, "category").orderBy(F.desc(_nine("opportunity")), "cell_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("opportunity_raw", "_low", "_high")


def densify(counts: DataFrame, cells: DataFrame, names: list[str] | DataFrame, k: int = 2, scope: str | None = None) -> DataFrame:
    """Opportunity of every cell for the named categories (a category without points anywhere too).

    ``names``: a list, or a table with a column category.
    """
    keys = [scope] if scope else []
    if not isinstance(names, DataFrame):
        names = cells.sparkSession.createDataFrame([(n,) for n in names], "category string")
    names = names.select("category").distinct()
    chosen = counts.join(names, "category", "left_semi")
    asked = demand(cells, scope=scope).join(names)  # every cell with every name is what is asked for
    ring = kring_sum(chosen, cells, "count", "cat_count_kring", k, by=("category",), scope=scope)
    own = chosen.select("cell_id", *keys, "category", F.col("count").alias("cat_count_cell"))
    rows = asked.join(ring, ["cell_id", *keys, "category"], "left").join(own, ["cell_id", *keys, "category"], "left").fillna(0, subset=["cat_count_kring", "cat_count_cell"])
    rows = rows.join(rows.groupBy(*keys, "category").agg(F.max("cat_count_kring").alias("_most")), [*keys, "category"])
    rows = rows.withColumn("saturation", F.when(F.col("_most") > 0, F.col("cat_count_kring") / (F.col("_most") + 1)).otherwise(0.0)).withColumn("opportunity_raw", _raw(F.col("cat_count_kring"), F.col("_most")))
    ends = rows.groupBy(*keys, "category").agg(F.min("opportunity_raw").alias("_low"), F.max("opportunity_raw").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high > low, clip((F.col("opportunity_raw") - low) / F.nullif(high - low, F.lit(0.0)))).otherwise(F.col("opportunity_raw"))
    return rows.join(ends, [*keys, "category"]).withColumn("opportunity", scaled).select("cell_id", *keys, "demand_proxy", "category", "cat_count_kring", "cat_count_cell", "saturation", "opportunity_raw", "opportunity")


def best_per_category(opportunities: DataFrame, n: int = 10, scope: str | None = None) -> DataFrame:
    order = Window.partitionBy(*([scope] if scope else []), "category").orderBy(F.desc("opportunity"), "cell_id")
    return opportunities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def summary(counts: DataFrame, cells: DataFrame, scope: str | None = None) -> DataFrame:
    """(scope?, category, total_in_grid, cells_with, cells_without), from the sparse counts inside the grid."""
    keys = [scope] if scope else []
    inside = counts.join(cells.select("cell_id", *keys), ["cell_id", *keys], "left_semi").where("count > 0")
    sums = inside.groupBy(*keys, "category").agg(F.sum("count").alias("total_in_grid"), F.countDistinct("cell_id").alias("cells_with"))
    size = cells.groupBy(*keys).agg(F.countDistinct("cell_id").alias("_cells"))  # one row for each scope
    both = sums.join(size, scope) if scope else sums.crossJoin(F.broadcast(size))
    return both.select(*keys, "category", "total_in_grid", "cells_with", (F.col("_cells") - F.col("cells_with")).alias("cells_without"))


def verdict(kring: Column, own: Column) -> Column:
    return F.when(kring == 0, "wide open").when(own == 0, "moderate").otherwise("saturated")

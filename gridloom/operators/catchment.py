"""Walk-time catchments: bounded shortest paths from many sources at once, rolled up to cells."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import WALK_M_PER_MIN, minutes
from gridloom.sources.store import kept

BUCKETS = (5, 10, 15)


def undirected(edges: DataFrame, scope: str | None = None) -> DataFrame:
    """(u, v, length, scope?): the least positive length of each unordered pair, in both directions."""
    good = edges.where(F.col("length").isNotNull() & ~F.isnan(F.col("length").cast("double")) & (F.col("length") > 0) & F.col("u").isNotNull() & F.col("v").isNotNull())
    keys = [scope] if scope else []
    least = good.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *keys).agg(F.min("length").alias("length"))
    way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    ways = F.when(F.col("u") == F.col("v"), F.array(way("u", "v"))).otherwise(F.array(way("u", "v"), way("v", "u")))
    return least.select(F.explode(ways).alias("way"), "length", *keys).select("way.u", "way.v", "length", *keys)


#: Kinds of rows: arrays of a round's labels that may go on, offers to improve them, arrays of the region's graph, labels to put out.
_LABELS, _OFFER, _GRAPH, _FOUND = 0, 1, 2, 3
_CELLS = 1 << 20  # distances that a task holds at a time
_TASKS = 64  # regions are few in small graphs; their sources are spread over about so many tasks


def shortest_paths(sources: DataFrame, edges: DataFrame, cutoff_m: float, regions: DataFrame | None = None, scope: str | None = None, most_nodes: int = 1 << 14, sources_per_task: int = 128) -> DataFrame:
    """(src, scope?, node, d) with d <= cutoff_m, from (src, node) starts over (u, v, length) both ways.

    The graph is cut into regions of at most ``most_nodes`` nodes, and each is packed into arrays once. In
    a round every region that was offered something relaxes its own nodes for the sources that reach it,
    and only improved distances across its borders travel on, to the next round. A distance that leaves no room
    for even the shortest edge of its node is put out at once: it is neither offered nor dealt again; the others
    are dealt as arrays, a row for each round, region and part of the sources. A graph of
    no more than ``most_nodes`` nodes is one region, and one round. The costs of a source follow the nodes that it
    reaches; no graph is sent anywhere as a whole, and sources of one region are spread over tasks.

    ``regions``: (node, scope?, region long), such as blocks of a map; those with more nodes are split, and nodes without a row make
    one of their own. Any cut gives the same distances; the fewer edges it cuts, the fewer rounds.
    Nodes are long; edges of negative or no length are left out, starts without an edge reach themselves.
    ``scope``: a column of all tables, such as the city, whose sources and nodes have ids of their own.
    """
    found = _labels(sources, edges, cutoff_m, regions, scope, most_nodes, sources_per_task)
    return found.groupBy("src", *([scope] if scope else []), "node").agg(F.min("d").alias("d"))


def _labels(sources: DataFrame, edges: DataFrame, cutoff_m: float, regions: DataFrame | None, scope: str | None, most_nodes: int = 1 << 14, sources_per_task: int = 128) -> DataFrame:
    """As shortest_paths(), with distances of paths that are not the shortest beside those of the shortest."""
    keys = [scope] if scope else []
    good = edges.where(F.col("length").between(0, cutoff_m)).select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("length").cast("double").alias("length")).dropna()
    starts = sources.select("src", *keys, F.col("node").cast("long").alias("node")).dropna().distinct()
    placed = _placed(starts, good, regions, keys, most_nodes)
    graph = _packed(good, placed, keys)
    place = [*keys, "region", "part"]
    began = kept(starts.join(placed, [*keys, "node"]).select(*keys, "region", "src", "node"), "starts")
    most = began.groupBy(*keys, "region").count().agg(F.max("count")).first()[0] or 0
    n_regions, n_sources = graph.count(), began.select(*keys, "src").distinct().count()
    parts = int(most // sources_per_task) + 1
    if n_regions:
        parts = max(parts, min(int(n_sources // sources_per_task) + 1, -(-_TASKS // n_regions)))
    part = F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int").alias("part")
    none = F.lit(None).cast("binary").alias("blob")
    offers = began.select(*keys, "region", part, F.lit(_OFFER).alias("kind"), "src", "node", F.lit(0.0).alias("d"), none)
    src = sources.schema["src"].dataType.simpleString()
    schema = ", ".join([*(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in keys), f"region long, part int, kind int, src {src}, node long, d double, blob binary"])
    found: list[DataFrame] = []
    while not found or not offers.isEmpty():
        touched = offers.select(*place).distinct()
        columns = [*place, "kind", "src", "node", "d", "blob"]
        graphs = touched.join(graph, [*keys, "region"]).withColumns({"kind": F.lit(_GRAPH), "src": F.lit(None).cast(src), "node": F.lit(0).cast("long"), "d": F.lit(0.0)})
        rows = offers.select(*columns).union(graphs.select(*columns))
        for done in found:  # of the regions and parts that were offered something, no others
            rows = rows.union(done.where(F.col("kind") == _LABELS).join(touched, place, "left_semi").select(*columns))
        found.append(kept(rows.groupBy(*place).applyInArrow(_relaxed(cutoff_m, len(keys)), schema), "walk"))
        offers = found[-1].where(F.col("kind") == _OFFER)
    every = found[0]
    for done in found[1:]:
        every = every.union(done)
    return every.where(F.col("kind") == _FOUND).select("src", *keys, "node", "d")


def _placed(starts: DataFrame, edges: DataFrame, regions: DataFrame | None, keys: list[str], most_nodes: int) -> DataFrame:
    """(keys, node, region, least): every node in a region of about ``most_nodes`` nodes or fewer, and its shortest edge."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), "length"), F.struct(F.col("v").alias("node"), F.lit(None).cast("double").alias("length")))).alias("end")
    nodes = edges.select(*keys, ends).select(*keys, "end.*").union(starts.select(*keys, "node", F.lit(None).cast("double").alias("length"))).groupBy(*keys, "node").agg(F.min("length").alias("least"))
    if regions is None:
        named = nodes.withColumn("region", F.lit(-1).cast("long"))
    else:
        given = regions.groupBy(*keys, F.col("node").cast("long").alias("node")).agg(F.min(F.col("region").cast("long")).alias("region"))
        named = nodes.join(given, [*keys, "node"], "left").withColumn("region", F.coalesce("region", F.lit(-1).cast("long")))
    named = kept(named, "nodes")
    sizes = named.groupBy(*keys, "region").agg(F.count("*").alias("n"))
    totals = sizes.withColumn("all", F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)]))))  # a row for each region
    split = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / most_nodes))
    region = F.when(F.col("all") <= most_nodes, F.lit(0).cast("long")).otherwise(F.xxhash64("region", split))
    return kept(named.join(totals, [*keys, "region"]).select(*keys, "node", region.alias("region"), F.coalesce("least", F.lit(float("inf"))).alias("least")), "placed")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the first type that holds them all."""
    for kind in (np.int16, np.int32) if x.dtype.kind == "i" else (np.float32,):
        with np.errstate(over="ignore", invalid="ignore"):
            small = x.astype(kind)
        if np.array_equal(small, x):
            return small
    return x


def _packed(edges: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region, blob): the arrays of each region."""
    here = placed.select(*keys, F.col("node").alias("u"), "region")
    there = placed.select(*keys, F.col("node").alias("v"), F.col("region").alias("to"), "least")
    ends = edges.join(here, [*keys, "u"]).join(there, [*keys, "v"])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        u, v, length, to, beyond = (table.column(c).to_numpy() for c in ("u", "v", "length", "to", "least"))
        own = to == key[-1].as_py()
        nodes, at = np.unique(np.concatenate([u, v[own]]), return_inverse=True)
        start, end = at[: len(u)], at[len(u) :]
        least = np.full(len(nodes), np.inf)
        np.minimum.at(least, start, length)
        inner, outer = np.argsort(start[own], kind="stable"), np.argsort(start[~own], kind="stable")
        first, out_first = (np.searchsorted(x, np.arange(len(nodes) + 1)) for x in (start[own][inner], start[~own][outer]))
        names, named = np.unique(to[~own][outer], return_inverse=True)
        arrays = (nodes, least, first, end[inner], length[own][inner], out_first, v[~own][outer], names, named, length[~own][outer], beyond[~own][outer])
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip([*keys, "region"], key, strict=True)}, "blob": pa.array([pickle.dumps([_narrow(x) for x in arrays], protocol=5)], pa.binary())})

    schema = ", ".join([*(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in keys), "region long, blob binary"])
    return kept(ends.select(*keys, "region", "u", "v", "length", "to", "least").groupBy(*keys, "region").applyInArrow(pack, schema), "graph")


def _unpacked(blob: bytes | None) -> list[np.ndarray]:
    if blob:
        return [x.astype(np.int64) if x.dtype.kind == "i" else x.astype(np.float64) for x in pickle.loads(blob)]
    zero, whole, real = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return [whole, real, zero, whole, real, zero, whole, whole, whole, real, real]


def _edges_of(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of nodes ``at``, one after another, and how many each has."""
    size = first[at + 1] - first[at]
    return np.arange(size.sum()) + np.repeat(first[at] - (np.cumsum(size) - size), size), size


def _relaxed(cutoff_m: float, n_keys: int):
    """A function of the rows of one region and part: improved labels, and offers across its borders."""

    def lower(known: np.ndarray, keys: np.ndarray, n: int, first: np.ndarray, to: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Lowers the distances of a block (a row of the region's nodes for each source) from ``keys`` on; the keys that were lowered."""
        lowered = [keys]
        while len(keys):
            node = keys % n
            edge, size = _edges_of(node, first)
            offer, there = np.repeat(known[keys], size) + length[edge], np.repeat(keys - node, size) + to[edge]
            better = (offer <= cutoff_m) & (offer < known[there])
            offer, there = offer[better], there[better]
            np.minimum.at(known, there, offer)
            keys = np.unique(there)
            lowered.append(keys)
        return np.unique(np.concatenate(lowered))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blobs = table.column("blob")
        of = lambda k: [blobs[int(i)].as_py() for i in np.flatnonzero(kind == k)]
        nodes, least, first, to, length, out_first, out_node, out_names, out_region, out_length, out_least = _unpacked(next(iter(of(_GRAPH)), None))
        before = [pickle.loads(x) for x in of(_LABELS)]
        rows = np.flatnonzero(kind == _OFFER)
        asked = table.column("src").combine_chunks()
        asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
        names = pa.concat_arrays([asked.take(pa.array(rows)), *(x for x, _, _ in before)]).dictionary_encode()
        src = names.indices.to_numpy()
        node = np.concatenate([table.column("node").to_numpy()[rows], *(nodes[x] for _, x, _ in before)])
        d = np.concatenate([table.column("d").to_numpy()[rows], *(x for _, _, x in before)])
        offered = np.arange(len(d)) < len(rows)
        alone = np.setdiff1d(node, nodes)  # starts without an edge
        every = np.concatenate([nodes, alone])
        n = len(every)
        least = np.concatenate([least, np.full(len(alone), np.inf)])
        first, out_first = (np.concatenate([x, np.full(len(alone), x[-1])]) for x in (first, out_first))
        order = np.argsort(every, kind="stable")
        at = order[np.searchsorted(every, node, sorter=order)]
        out: list[tuple] = []
        on: list[tuple] = []  # labels that may go on
        block = max(1, min(_CELLS // n, len(names.dictionary)))
        known = np.full(block * n, np.inf)
        by_src = np.argsort(src, kind="stable")
        edges_of_block = np.searchsorted(src[by_src], np.arange(0, len(names.dictionary) + block, block))
        home = key[n_keys].as_py()
        for i, (low, high) in enumerate(zip(edges_of_block[:-1], edges_of_block[1:], strict=True)):
            some = by_src[low:high]
            places = (src[some] - i * block).astype(np.int64) * n + at[some]
            new = offered[some]
            np.minimum.at(known, places[~new], d[some][~new])
            lowers = d[some][new] < known[places[new]]
            better = places[new][lowers]
            np.minimum.at(known, better, d[some][new][lowers])
            changed = lower(known, np.unique(better), n, first, to, length)
            what, who, best = changed % n, changed // n + i * block, known[changed]
            known[places] = known[changed] = np.inf  # for the next block
            out.append((np.full(len(changed), _FOUND), who, every[what], best, np.full(len(changed), home)))
            going = best + least[what] <= cutoff_m
            what, who, best = what[going], who[going], best[going]
            on.append((who, what, best))
            edge, size = _edges_of(what, out_first)
            far = np.repeat(best, size) + out_length[edge]
            within = far <= cutoff_m
            edge, far, who = edge[within], far[within], np.repeat(who, size)[within]
            sort = np.lexsort((far, out_node[edge], who))
            edge, far, who = edge[sort], far[sort], who[sort]
            one = np.ones(len(who), bool)
            one[1:] = (who[1:] != who[:-1]) | (out_node[edge[1:]] != out_node[edge[:-1]])
            edge, far, who = edge[one], far[one], who[one]
            out.append((np.where(far + out_least[edge] > cutoff_m, _FOUND, _OFFER), who, out_node[edge], far, out_names[out_region[edge]]))
        labels, at, best = (np.concatenate(x) for x in zip(*on, strict=True))
        packed = pickle.dumps((names.dictionary.take(pa.array(labels)), at.astype(np.int32), best), protocol=5)
        what, who, node, d, region = (np.concatenate(x) for x in zip(*out, strict=True))
        n = len(what)
        last = lambda x, one, kind: pa.concat_arrays([x, pa.array([one], kind)])
        fixed = {c: pa.repeat(k, n + 1) for c, k in zip(table.column_names[:n_keys], key[:n_keys], strict=True)}
        return pa.table({
            **fixed,
            "region": pa.array(np.append(region, home), pa.int64()),
            "part": pa.repeat(key[n_keys + 1], n + 1),
            "kind": pa.array(np.append(what, _LABELS), pa.int32()),
            "src": last(names.dictionary.take(pa.array(who)), None, names.dictionary.type),
            "node": pa.array(np.append(node, 0), pa.int64()),
            "d": pa.array(np.append(d, 0.0)),
            "blob": last(pa.nulls(n, pa.binary()), packed, pa.binary()),
        })

    return run


def walk_times(starts: DataFrame, edges: DataFrame, node_cells: DataFrame, max_minutes: float = 15.0, m_per_min: float = WALK_M_PER_MIN, scope: str | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(src_cell, scope?, cell_id, minutes): the least walk time to any node of a cell; the source itself is 0.

    ``starts``: (src_cell, node), the node nearest to each source; ``node_cells``: (node, cell_id).
    The cutoff is inclusive. Cells outside the grid stay in the result. ``scope``: a column of all three
    tables, such as the city; ids of cells and nodes count within it. ``regions``: as for shortest_paths().
    """
    keys = [scope] if scope else []
    # distances that are not the shortest go with the others of their cell
    paths = _labels(starts.select(F.col("src_cell").alias("src"), *keys, "node"), edges, max_minutes * m_per_min, regions, scope)
    reached = paths.join(node_cells, ["node", *keys]).select(F.col("src").alias("src_cell"), *keys, "cell_id", minutes(F.col("d"), m_per_min).alias("minutes"))
    own = starts.select("src_cell", *keys, F.col("src_cell").alias("cell_id"), F.lit(0.0).alias("minutes"))
    return reached.union(own).groupBy("src_cell", *keys, "cell_id").agg(F.min("minutes").alias("minutes"))


def summary(times: DataFrame, cells: DataFrame, scope: str | None = None) -> DataFrame:
    """(src_cell, scope?, within_min, n_cells, n_pois): nested, inclusive buckets over cells of the grid."""
    pois = F.coalesce(F.col("poi_count"), F.lit(0)) if "poi_count" in cells.columns else F.lit(0)
    keys = [scope] if scope else []
    grid = cells.select("cell_id", *keys, pois.cast("long").alias("_pois"))
    inside = times.join(grid, ["cell_id", *keys])
    wide = inside.groupBy("src_cell", *keys).agg(F.array(*[F.struct(F.lit(b).alias("within_min"), F.count_if(F.col("minutes") <= b).alias("n_cells"), F.coalesce(F.sum(F.when(F.col("minutes") <= b, F.col("_pois"))), F.lit(0)).alias("n_pois")) for b in BUCKETS]).alias("all"))
    return wide.select("src_cell", *keys, F.explode("all").alias("one")).select("src_cell", *keys, "one.*")


def as_map(summary_rows: DataFrame, scope: str | None = None) -> DataFrame:
    """(src_cell, scope?, buckets map<string, struct>): the roll-up of each source in one row."""
    entry = F.struct(F.concat(F.col("within_min").cast("string"), F.lit("_min")), F.struct("n_cells", "n_pois"))
    return summary_rows.groupBy("src_cell", *([scope] if scope else [])).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("buckets"))

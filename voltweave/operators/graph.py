"""The road graph: nodes and undirected edges (src < dst) as tables.

Iterations write each round's state, so lineage stays short and a lost executor
costs a round at most; they stop when a round changes nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.geo import haversine, node_key
from ..plans.staging import drop, stage
from .spatial import closest_across, nearest_join, self_radius_candidates

#: Directed edges up to which the graph is sent to every worker (24 bytes each).
LOCAL_EDGES = 2_000_000
#: Links between components up to which they are joined on the driver (32 bytes each).
LOCAL_LINKS = 200_000
#: Nodes of an origin's tree up to which its ways are followed in one group (16 bytes each).
LOCAL_NODES = 4_000_000
#: Improved rows of a round up to which their keys are broadcast, and rounds after which they are merged.
BROADCAST_ROWS, MERGE_ROUNDS = 1_000_000, 12


def polyline_segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices of each polyline, without segments that rounding makes points.

    ``vertices``: road_id, seq, lat, lon, free_flow_speed, traffic_volume.
    """
    order = Window.partitionBy("road_id").orderBy("seq")
    keyed = vertices.withColumn("node", node_key(F.col("lat"), F.col("lon")))
    step = {c: F.lead(c).over(order) for c in ("node", "lat", "lon")}
    pairs = keyed.select("road_id", "seq", F.col("node").alias("a"), "lat", "lon", step["node"].alias("b"), step["lat"].alias("lat_b"), step["lon"].alias("lon_b"), "free_flow_speed", "traffic_volume")
    pairs = pairs.filter("b is not null and a <> b").withColumn("length", haversine(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")))
    return pairs.select("road_id", "seq", "a", "b", "length", F.try_divide("length", "free_flow_speed").alias("time"), "free_flow_speed", "traffic_volume")


def explode_parts(roads: DataFrame) -> DataFrame:
    """Vertices of polylines kept as arrays of parts; each part is a line of its own."""
    parts = roads.select("road_id", "free_flow_speed", "traffic_volume", F.posexplode("parts").alias("part", "line"))
    return parts.select(F.struct("road_id", "part").alias("road_id"), "free_flow_speed", "traffic_volume", F.posexplode("line").alias("seq", "v")).select("road_id", F.col("seq").cast("long").alias("seq"), F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"), "free_flow_speed", "traffic_volume")


def road_graph(segments: DataFrame) -> DataFrame:
    """One edge for each pair of nodes; of several segments the last by (road_id, seq) sets it."""
    ends = segments.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "road_id", "seq", "length", "time")
    return ends.groupBy("src", "dst").agg(F.max_by(F.struct("length", "time"), F.struct("road_id", "seq")).alias("e")).select("src", "dst", "e.length", "e.time")


def graph_nodes(vertices: DataFrame) -> DataFrame:
    """Nodes with the attributes of the first vertex that lies there."""
    first = F.min_by(F.struct("lat", "lon", "free_flow_speed", "traffic_volume"), F.struct("road_id", "seq"))
    return vertices.groupBy(node_key(F.col("lat"), F.col("lon")).alias("node_id")).agg(first.alias("n")).select("node_id", "n.*")


def both_ways(edges: DataFrame) -> DataFrame:
    columns = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *columns).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))


def node_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def contract_graph(edges: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Nodes of degree two are replaced by an edge while its length stays within bounds.

    In a round those go that are smallest among themselves and their neighbours
    in question, so no two of them touch; of parallel edges the fastest stays.
    """
    edges = stage(edges.select("src", "dst", "length", "time"), "edges")
    while True:
        both = both_ways(edges)
        ends = both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("p"), F.max("dst").alias("q"), F.sum("length").alias("length"), F.sum("time").alias("time"))
        able = stage(ends.filter((F.col("n") == 2) & (F.col("length") <= params.contract_km)), "able")
        rivals = both.select("src", "dst").join(able.select(F.col("src").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.min("dst").alias("rival"))
        go = stage(able.join(rivals, "src", "left").filter("rival is null or src < rival"), "contracted")
        if go.isEmpty():
            return edges
        gone = go.select(F.col("src").alias("gone"))
        kept = edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
        made = go.select(F.col("p").alias("src"), F.col("q").alias("dst"), "length", "time")
        best = kept.unionByName(made).groupBy("src", "dst").agg(F.min_by(F.struct("length", "time"), F.struct("time", "length")).alias("e"))
        edges = stage(best.select("src", "dst", "e.length", "e.time"), "edges")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and component, the component's smallest node.

    Each round a node takes the smallest label around it, then its label's label.
    """
    both = stage(both_ways(edges.select("src", "dst")), "links")
    labels = stage(nodes.select("node_id", F.col("node_id").alias("component")), "labels")
    while True:
        around = both.join(labels, both["dst"] == labels["node_id"]).groupBy("src").agg(F.min("component").alias("near"))
        hooked = stage(labels.join(around, labels["node_id"] == around["src"], "left").select("node_id", F.least("component", "near").alias("component"), F.col("component").alias("was")), "hooked")
        up = hooked.select(F.col("node_id").alias("at"), F.col("component").alias("up"))
        after = stage(hooked.join(up, hooked["component"] == up["at"], "left").select("node_id", F.least("component", "up").alias("component"), "was"), "labels")
        labels = after.select("node_id", "component")
        if after.filter("component <> was").isEmpty():
            return labels


def component_closest_pair(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """The closest two nodes of different components."""
    labelled = stage(nodes.join(components, "node_id"), "labelled")
    return closest_across(labelled, "component").orderBy("distance_km", "src", "dst").limit(1).select("src", "dst", "distance_km")


def _joined(labelled: DataFrame, made: DataFrame) -> DataFrame:
    """``labelled`` with the components that the links ``made`` join as one; components change, nodes are not looked at again."""
    of = labelled.select("node_id", "component")
    ends = made.join(of.withColumnsRenamed({"node_id": "src", "component": "a"}), "src").join(of.withColumnsRenamed({"node_id": "dst", "component": "b"}), "dst")
    pairs = stage(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "joined")
    if pairs.count() <= LOCAL_LINKS:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in pairs.collect():
            x, y = sorted((find(a), find(b)))
            root[y] = x
        merged = labelled.sparkSession.createDataFrame([(i, find(i)) for i in root], "component long, whole long")
    else:
        every = pairs.select(F.col("src").alias("node_id")).unionByName(pairs.select(F.col("dst").alias("node_id"))).distinct()
        merged = connected_components(every, pairs).select(F.col("node_id").alias("component"), F.col("component").alias("whole"))
    return labelled.join(merged, "component", "left").select("node_id", "lat", "lon", F.coalesce("whole", "component").alias("component"))


def patch_components(nodes: DataFrame, edges: DataFrame, params: Params = DEFAULTS, max_degree: int | None = None) -> DataFrame:
    """Edges that connect all components: those of the shortest tree between them.

    In a round every component takes its closest link to another; distances with
    ties by node pair are distinct, so this is the tree that single closest links give.
    """
    if max_degree is not None:
        degrees = node_degree(edges)
        candidates = nodes.join(degrees, "node_id", "left").filter(F.coalesce("degree", F.lit(0)) <= max_degree).drop("degree")
    else:
        candidates = nodes
    labels = connected_components(nodes, edges)
    labelled = stage(candidates.select("node_id", "lat", "lon").join(labels, "node_id"), "labelled")
    added = None
    while labelled.select("component").distinct().limit(2).count() > 1:
        made = stage(closest_across(labelled, "component").select("src", "dst", "distance_km").distinct(), "patches")
        if made.isEmpty():
            break
        added = made if added is None else added.unionByName(made)
        before, labelled = labelled, stage(_joined(labelled, made), "labelled")
        drop(before)
    if added is None:
        return edges.select("src", "dst", "length", "time").limit(0)
    return added.select("src", "dst", F.col("distance_km").alias("length"), (F.col("distance_km") / params.patch_speed).alias("time"))


def stitch_edges(nodes: DataFrame, edges: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Edges between nodes that are near in degrees (stitch_km / 111) and not yet adjacent.

    A node brings the few it is adjacent to, so neither all pairs nor all edges are exchanged or broadcast.
    """
    reach = params.stitch_km / 111
    here = nodes.select("node_id", "lat", "lon")
    other = here.select(F.col("node_id").alias("right_id"), "lat", "lon")
    adjacent = both_ways(edges.select("src", "dst").filter("src < dst")).groupBy(F.col("src").alias("node_id")).agg(F.collect_set("dst").alias("adjacent"))
    # A degree of longitude is at most one of latitude in km, so this radius holds the circle in degrees.
    pairs = self_radius_candidates(here.join(adjacent.hint("merge"), "node_id", "left"), other, reach * 111.2)
    square = (F.col("lat") - F.col("right_lat")) ** 2 + (F.col("lon") - F.col("right_lon")) ** 2
    close = pairs.filter(square <= reach * reach).filter("adjacent is null or not array_contains(adjacent, right_id)")
    distance = haversine(F.col("lat"), F.col("lon"), F.col("right_lat"), F.col("right_lon"))
    made = close.select(F.least("node_id", "right_id").alias("src"), F.greatest("node_id", "right_id").alias("dst"), (distance * params.stitch_factor).alias("length"))
    return made.withColumn("time", F.col("length") / params.stitch_speed)


PATHS = "origin long, node_id long, cost double, hops long, pred long"


def cheapest(start: int, first: list[int], to: list[int], weight: list[float]) -> dict[int, tuple[float, int, int]]:
    """node -> (cost, hops, predecessor) of the cheapest ways from ``start`` (Dijkstra); edges of node i: first[i] to first[i + 1]."""
    best = {start: (0.0, 0, -1)}
    heap, done = [(0.0, 0, -1, start)], set()
    while heap:
        cost, hops, _, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        for e in range(first[at], first[at + 1]):
            label = (cost + weight[e], hops + 1, at)
            if to[e] not in done and (to[e] not in best or label < best[to[e]]):
                best[to[e]] = label
                heapq.heappush(heap, (*label, to[e]))
    return best


def _paths_by_worker(both: DataFrame, origins: DataFrame) -> DataFrame:
    """The graph is broadcast; each origin is a row of work."""
    got = both.toArrow()
    src, dst, w = (np.asarray(got[c]) for c in ("src", "dst", "w"))
    order = np.argsort(src, kind="stable")
    nodes = np.unique(src)
    sent = both.sparkSession.sparkContext.broadcast((nodes, np.searchsorted(src[order], nodes), np.searchsorted(nodes, dst[order]), w[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, to, weight = sent.value
        lists = [*first.tolist(), len(to)], to.tolist(), weight.tolist()
        for batch in batches:
            for origin in batch.column(0).to_pylist():
                at = int(np.searchsorted(ids, origin))
                if at == len(ids) or ids[at] != origin:  # no edge leaves it
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((origin, origin, 0.0, 0, None), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["origin", "node_id", "cost", "hops", "pred"])
                    continue
                best = cheapest(at, *lists)
                reached = np.fromiter(best, np.int64, len(best))
                cost, hops, pred = (np.array(x) for x in zip(*best.values()))
                columns = [pa.array(np.full(len(best), origin, np.int64)), pa.array(ids[reached]), pa.array(cost), pa.array(hops.astype(np.int64)), pa.array(ids[np.maximum(pred, 0)], mask=pred < 0)]
                yield pa.RecordBatch.from_arrays(columns, ["origin", "node_id", "cost", "hops", "pred"])

    return origins.repartition("origin").mapInArrow(run, PATHS)


def _paths_by_rounds(both: DataFrame, origins: DataFrame) -> DataFrame:
    """Every round extends the rows that got cheaper; only these are written, and merged with the rest now and then."""
    label = F.struct("cost", "hops", "pred").alias("m")
    least = lambda df: df.groupBy("origin", "node_id").agg(F.min(label).alias("m")).select("origin", "node_id", "m.*")
    start = origins.select("origin", F.col("origin").alias("node_id"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("long").alias("pred"))
    parts = [stage(start, "reached")]
    new = parts[0]
    while True:
        step = new.join(both, F.col("node_id") == F.col("src")).select("origin", F.col("dst").alias("node_id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("pred"))
        step = stage(least(step), "steps")
        n = step.count()
        if not n:
            break
        hint = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
        known = reduce(DataFrame.unionByName, parts).join(hint(step.select("origin", "node_id")), ["origin", "node_id"], "left_semi")
        known = known.groupBy("origin", "node_id").agg(F.min(label).alias("k"))
        better = step.join(known, ["origin", "node_id"], "left").filter(F.col("k").isNull() | (F.struct("cost", "hops", "pred") < F.col("k"))).drop("k")
        new = stage(better, "reached")
        drop(step)
        parts.append(new)
        if len(parts) > MERGE_ROUNDS:
            merged = stage(least(reduce(DataFrame.unionByName, parts)), "reached")
            drop(*parts[:-1])  # the last is still to be extended
            parts = [merged]
    return stage(least(reduce(DataFrame.unionByName, parts)), "paths")


def shortest_paths(edges: DataFrame, origins: DataFrame, weight: str = DEFAULTS.weight) -> DataFrame:
    """origin, node_id, cost, pred of the cheapest way from each origin (column ``origin``) to each node it reaches.

    A missing weight is 1; a negative one is an error.  Equal costs go by fewer steps,
    then by the smaller predecessor, so predecessors never form a ring.  Null origins go.
    """
    w = F.when(F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")), F.col(weight).cast("double")).otherwise(1.0)
    both = stage(both_ways(edges.filter("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w"))), "links")
    n, lowest = both.agg(F.count(F.lit(1)), F.min("w")).first()
    if n and lowest < 0:
        raise ValueError(f"negative weight: {lowest}")
    starts = origins.select(F.col("origin").cast("long").alias("origin")).filter("origin is not null").distinct()
    found = _paths_by_worker(both, starts) if n <= LOCAL_EDGES else _paths_by_rounds(both, starts)
    return found.drop("hops")


def _ways_by_origin(goals: DataFrame, reached: DataFrame) -> DataFrame:
    town = dict(goals.dtypes)["dest"]

    def follow(ends: pa.Table, tree: pa.Table) -> pa.Table:
        nodes, pred = np.asarray(tree["cur"]), tree["pred"].combine_chunks()
        before = dict(zip(nodes.tolist(), pred.to_pylist()))
        paths = []
        for at in ends["node_id"].to_pylist():
            path = [at]
            while (at := before[at]) is not None:
                path.append(at)
                if len(path) > len(before):
                    raise ValueError("predecessors form a ring")
            paths.append(path[::-1])
        return pa.table({"from_node": ends["origin"], "dest": ends["dest"], "path": pa.array(paths, pa.list_(pa.int64())), "road_cost": ends["cost"]})

    grouped = goals.select("origin", "dest", "node_id", "cost").groupBy("origin").cogroup(reached.select(F.col("origin").alias("from_node"), F.col("node_id").alias("cur"), "pred").groupBy("from_node"))
    return grouped.applyInArrow(follow, f"from_node long, dest {town}, path array<long>, road_cost double")


def _ways_by_rounds(goals: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """All ways grow by a node in each round, back to their origins."""
    todo = stage(goals.select(F.col("origin").alias("from_node"), "dest", F.col("node_id").alias("cur"), F.array("node_id").alias("path"), F.col("cost").alias("road_cost")), "routes")
    back = reached.select(F.col("origin").alias("from_node"), F.col("node_id").alias("cur"), "pred")
    done = None
    for _ in range(most + 1):
        ended = todo.filter("cur = from_node")
        done = ended if done is None else done.unionByName(ended)
        going = todo.filter("cur <> from_node")
        if going.isEmpty():
            return done.drop("cur")
        todo = stage(going.join(back, ["from_node", "cur"]).select("from_node", "dest", F.col("pred").alias("cur"), F.concat(F.array("pred"), "path").alias("path"), "road_cost"), "routes")
    raise ValueError("predecessors form a ring")


def town_routes(paths: DataFrame, towns: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The way between every ordered pair of towns (town_id, node_id) that are connected.

    Columns: origin, dest (towns), path (nodes), road_cost, cost (with both
    town links).  The way back is followed through predecessors for town targets only.
    """
    at = stage(towns.select("town_id", "node_id"), "towns")
    reached = stage(paths, "paths")
    goals = reached.join(at.select(F.col("town_id").alias("dest"), "node_id"), "node_id")
    most = reached.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done = _ways_by_origin(goals, reached) if most <= LOCAL_NODES else _ways_by_rounds(goals, reached, most)
    starts = at.select(F.col("town_id").alias("origin"), F.col("node_id").alias("from_node"))
    links = F.when(F.col("origin") == F.col("dest"), 0.0).otherwise(2 * params.town_link_weight)
    return done.join(starts, "from_node").select("origin", "dest", F.when(F.col("origin") == F.col("dest"), F.slice("path", 1, 1)).otherwise(F.col("path")).alias("path"), "road_cost", (F.col("road_cost") + links).alias("cost"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that have at least one edge."""
    return nodes.join(both_ways(edges.select("src", "dst")).select(F.col("src").alias("node_id")).distinct(), "node_id", "left_semi")


def attach_towns(towns: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """town_id, node_id, distance_km: the nearest node of each town among those that have an edge."""
    found = nearest_join(towns.select("town_id", "lat", "lon"), connected_nodes(nodes, edges).select("node_id", "lat", "lon"), "town_id", "node_id")
    return found.select("town_id", "node_id", "distance_km")


def with_towns(nodes: DataFrame, edges: DataFrame, towns: DataFrame, attached: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph with the towns: towns are nodes -town_id - 1 with is_town, their edges have no length and the link's weight as time."""
    town = -F.col("town_id") - 1
    every = nodes.select("node_id", "lat", "lon", F.lit(False).alias("is_town")).unionByName(towns.select(town.alias("node_id"), "lat", "lon", F.lit(True).alias("is_town")))
    links = attached.select(town.alias("src"), F.col("node_id").alias("dst"), F.lit(None).cast("double").alias("length"), F.lit(params.town_link_weight).alias("time"))
    return every, edges.select("src", "dst", "length", "time").unionByName(links)


def route_geometry(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates along each route, in order."""
    steps = routes.select("origin", "dest", F.posexplode("path").alias("seq", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda s: F.array(s["lon"], s["lat"]))
    return steps.groupBy("origin", "dest").agg(points.alias("line"))

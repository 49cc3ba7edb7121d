"""Networks as edge tables (``src, dst, cost``): shortest ways, service areas, facilities."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.checkpoints import saved as _saved


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "cost").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_cost: float | None = None) -> DataFrame:
    """``origin, node, cost, previous`` of all nodes that can be reached, from all sources at once.

    Each round extends the nodes whose cost fell in the round before by one edge
    and keeps the least cost; of equal ways the one over the smaller previous
    node stays. Costs must not be negative: then a round that lowers no cost comes
    at last. Many origins share the rounds.
    """
    edges = _saved(edges.groupBy("src", "dst").agg(F.min("cost").cast("double").alias("cost")))
    found = sources.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"), F.lit(None).cast(sources.schema["node"].dataType).alias("previous")).distinct()
    found = front = _saved(found)
    while True:
        step = front.select("origin", F.col("node").alias("src"), F.col("cost").alias("so_far")).join(edges, "src").select("origin", F.col("dst").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"), F.col("src").alias("previous"))
        if max_cost is not None:
            step = step.where(F.col("cost") <= max_cost)
        new = found.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        best = new.groupBy("origin", "node").agg(F.min(F.struct("cost", F.col("previous").isNotNull().alias("p"), "previous")).alias("b"), F.min(F.when(F.col("old"), F.col("cost"))).alias("before"))
        best = _saved(best.select("origin", "node", "b.cost", "b.previous", (F.col("before").isNull() | (F.col("b.cost") < F.col("before"))).alias("fell")))
        found, front = best.drop("fell"), best.where("fell")
        if front.isEmpty():
            return found


def service_area(edges: DataFrame, origin: DataFrame, max_cost: float) -> DataFrame:
    """Nodes within ``max_cost``, the limit included."""
    return shortest_paths(edges, origin, max_cost).select("origin", "node", "cost")


def closest_facility(edges: DataFrame, origins: DataFrame, facilities: DataFrame) -> DataFrame:
    """``origin, facility, cost``; of equally near ones the first by ``pos``. Origins that reach none are left out."""
    reach = shortest_paths(edges, origins).join(facilities.select("node", "pos"), "node")
    return reach.groupBy("origin").agg(F.min(F.struct("cost", "pos", "node")).alias("b")).select("origin", F.col("b.node").alias("facility"), "b.cost")


def route(edges: DataFrame, origin, destination) -> tuple[list, float] | None:
    """The nodes of one shortest way and its cost; None if there is none. The way is short enough for the driver.

    The way back is found by doubling: after n rounds each node knows the nodes up
    to 2**n steps before it.
    """
    spark = edges.sparkSession
    tree = _saved(shortest_paths(edges, spark.createDataFrame([(origin,)], ["node"]).select(F.col("node").cast(edges.schema["src"].dataType))).select("node", "cost", "previous"))
    goal = tree.where(F.col("node") == destination).first()
    if goal is None:
        return None
    kind = tree.schema["node"].dataType.simpleString()
    back = tree.select("node", F.when(F.col("previous").isNotNull(), F.array("previous")).otherwise(F.array().cast(f"array<{kind}>")).alias("way"), F.col("previous").alias("far"))
    while True:
        further = back.select(F.col("node").alias("far"), F.col("way").alias("more"), F.col("far").alias("next"))
        here = back.where(F.col("node") == destination).first()
        if here.far is None:
            return [*here.way[::-1], destination], goal.cost
        back = _saved(back.join(further, "far", "left").select("node", F.concat("way", F.coalesce("more", F.array().cast(f"array<{kind}>"))).alias("way"), F.col("next").alias("far")))


def astar(nodes: dict, adjacency: dict, start, goal, heuristic: Callable | None = None) -> dict:
    """A* on a small graph in memory: ``path, cost, nodes_explored, success``; closed nodes are not opened again."""
    guess = heuristic or (lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5)
    if start not in nodes or goal not in nodes:
        return {"path": [], "cost": float("inf"), "nodes_explored": 0, "success": False}
    best, came, closed, count = {start: 0.0}, {}, set(), 0
    queue = [(guess(nodes[start], nodes[goal]), count, start)]
    while queue:
        _, _, node = heapq.heappop(queue)
        if node in closed:
            continue
        closed.add(node)
        if node == goal:
            path = [node]
            while path[-1] in came:
                path.append(came[path[-1]])
            return {"path": path[::-1], "cost": best[goal], "nodes_explored": len(closed), "success": True}
        for other, cost in adjacency.get(node, []):
            if other not in closed and best[node] + cost < best.get(other, float("inf")):
                best[other], came[other] = best[node] + cost, node
                count += 1
                heapq.heappush(queue, (best[other] + guess(nodes[other], nodes[goal]), count, other))
    return {"path": [], "cost": float("inf"), "nodes_explored": len(closed), "success": False}


class AStarPathfinder:
    """``astar`` on one graph, with a heuristic by name, by function, or the straight line."""

    GUESSES = {
        "euclidean": lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]), "manhattan": lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]), "none": lambda a, b: 0.0,
        "haversine": lambda a, b: 2 * 6371.0 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)),
    }

    def __init__(self, nodes: dict, adjacency: dict, heuristic: str | Callable | None = None):
        if isinstance(heuristic, str) and heuristic not in self.GUESSES:
            raise ValueError(f"Unknown heuristic: {heuristic}")
        self.nodes, self.adjacency = nodes, adjacency
        self.heuristic = self.GUESSES[heuristic] if isinstance(heuristic, str) else heuristic

    def find_path(self, start, goal) -> dict:
        return astar(self.nodes, self.adjacency, start, goal, self.heuristic)

"""Connected components over any number of pairwise links.

:func:`strip_and_compress` removes degree-one vertices and splices degree-two vertices out of their chains, round after
round, solves the small core that is left and hands its labels back to the removed vertices, last round first. Of
neighbouring removable vertices one round takes an independent set (those with the locally least hash), which is list
ranking by random splicing: a chain of any length loses a constant share of its vertices per round.

:func:`hook_and_shortcut` contracts the graph by hooking every vertex onto its least neighbour and shortcutting the parent
table; it solves the core above and whole graphs for splits.

Both run as rounds of joined tables while there are more than ``LOCAL_LINKS`` links. What is left then is handed to one task,
which goes on with the same rounds on arrays (:class:`Arrays`): that bound is checked, and it is of links left, not of the input.

No step gathers a neighbourhood: degrees and neighbours are plain min/max/count aggregates with map-side combining, and
joins on hub vertices go through broadcasts of at most HEAVY_SHARE rows. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellum.operators.skew import HEAVY_ROWS, HEAVY_SHARE, heavy_keys, join_on_unique
from vellum.session import Scratch, rows_of

#: Links that one task takes over: at 60 bytes a name about 60 MB.
LOCAL_LINKS = 500_000


def _tidy(edges: DataFrame) -> DataFrame:
    """Undirected edges a < b, each once, without loops and NULLs."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.v", "e.u")


class Arrays:
    """The rounds of this module on arrays of vertex numbers below ``n``: (root of each vertex)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        self.n, self.pointers = n, []
        self.a, self.b = self._tidy(a, b)

    def _tidy(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.unique(np.minimum(a, b)[a != b] * self.n + np.maximum(a, b)[a != b])
        return key // self.n, key % self.n

    def strip(self) -> None:
        turn = 0
        while len(self.a):
            turn += 1
            v, u = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
            deg, lo, hi = np.bincount(v, minlength=self.n), np.full(self.n, self.n), np.full(self.n, -1)
            np.minimum.at(lo, v, u)
            np.maximum.at(hi, v, u)
            low = (deg == 1) | (deg == 2)
            rank = np.random.default_rng(turn).permutation(self.n)
            rank[~low] = self.n  # vertices that stay hold nobody back
            least = np.full(self.n, self.n)
            np.minimum.at(least, v, rank[u])
            gone = low & (rank < least)
            if not gone.any():
                return
            self.pointers.append((np.flatnonzero(gone), lo[gone]))
            left = ~(gone[self.a] | gone[self.b])
            bridge = gone & (deg == 2)
            self.a, self.b = self._tidy(np.concatenate([self.a[left], lo[bridge]]), np.concatenate([self.b[left], hi[bridge]]))

    def hook(self) -> None:
        while len(self.a):
            parent = np.arange(self.n)
            np.minimum.at(parent, self.a, self.b)
            np.minimum.at(parent, self.b, self.a)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            moved = np.flatnonzero(parent != np.arange(self.n))
            self.pointers.append((moved, parent[moved]))
            self.a, self.b = self._tidy(parent[self.a], parent[self.b])

    def roots(self) -> np.ndarray:
        root = np.arange(self.n)
        for v, to in reversed(self.pointers):
            root[v] = root[to]
        return root


def _solve_in_task(edges: DataFrame, scratch: Scratch, strip: bool) -> DataFrame:
    """(v, root) of the vertices of ``edges`` that aren't their component's representative, solved in one task."""
    kind = edges.schema["a"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        n = t.num_rows
        names = pa.chunked_array([*t["a"].chunks, *t["b"].chunks]).combine_chunks().dictionary_encode()
        ends = names.indices.to_numpy().astype(np.int64)
        graph = Arrays(ends[:n], ends[n:], len(names.dictionary))
        if strip:
            graph.strip()
        graph.hook()
        root = graph.roots()
        away = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(away)).cast(arrow), names.dictionary.take(pa.array(root[away])).cast(arrow)], ["v", "root"])

    return scratch.keep(edges.select("a", "b").coalesce(1).mapInArrow(run, f"v {kind.simpleString()}, root {kind.simpleString()}"))


def _resolve(pointers: list[tuple[DataFrame, list | None]], done: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """(v, root) of all vertices that ever got a pointer, from the last round back to the first; ``done`` has those after the last.

    With each table of pointers (v, to) come its heavy targets, if they are known.
    """
    for step, hubs in reversed(pointers):
        if done is None:
            done = step.select("v", F.col("to").alias("root"))
            continue
        known = done.select(F.col("v").alias("to"), F.col("root").alias("_root"))
        heavy = heavy_keys(step, "to", rows_of(step)) if hubs is None else hubs
        here = join_on_unique(step, known, "to", "left", heavy).select("v", F.coalesce("_root", "to").alias("root"))
        done = scratch.keep(done.unionByName(here))
    return done


def _shortcut(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """Parents replaced by grandparents until all point to a root: as many rounds as the logarithm of the longest path."""
    while True:
        up = parent.select(F.col("v").alias("to"), F.col("to").alias("_up"))
        heavy = heavy_keys(parent, "to", rows_of(parent))
        jumped = scratch.keep(join_on_unique(parent, up, "to", "left", heavy).select("v", F.coalesce("_up", "to").alias("to"), (F.coalesce("_up", "to") != F.col("to")).alias("moved")))
        scratch.drop(parent)
        parent = jumped
        if parent.where("moved").isEmpty():
            return parent


def _hook_rounds(edges: DataFrame, scratch: Scratch) -> tuple[list, DataFrame | None]:
    """Pointer tables (v, to) of the vertices that each round hooks onto another, and the rest solved in one task."""
    pointers = []
    while n := rows_of(edges):
        if n <= LOCAL_LINKS:
            return pointers, _solve_in_task(edges, scratch, False)
        least = _both_ways(edges).groupBy("v").agg(F.min("u").alias("u"))
        parent = _shortcut(scratch.keep(least.select("v", F.least("v", "u").alias("to"))), scratch)
        pointers.append((parent.where("v != to").select("v", "to"), None))
        moved = edges
        for end in ("a", "b"):
            at = parent.select(F.col("v").alias(end), F.col("to").alias("_to"))
            heavy = heavy_keys(moved, end, n)
            moved = join_on_unique(moved, at, end, "left", heavy).drop(end).withColumnRenamed("_to", end)
        old, edges = edges, scratch.keep(_tidy(moved))
        scratch.drop(old)
    return pointers, None


def hook_and_shortcut(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(v, root): every vertex with an edge that isn't its component's representative. None without edges."""
    return _resolve(*_hook_rounds(scratch.keep(_tidy(edges)), scratch), scratch)


def strip_and_compress(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(v, root): every vertex with an edge that isn't its component's representative. None without edges.

    ``edges``: columns a, b of one orderable type; repeated links, loops and NULLs add nothing. The representative is some
    vertex of the component; callers that want the least one take :func:`least_labels`. Stripping ends when no vertex of degree
    one or two is left.
    """
    edges = scratch.keep(_tidy(edges))
    pointers, turn = [], 0
    while n := rows_of(edges):
        if n <= LOCAL_LINKS:
            return _resolve(pointers, _solve_in_task(edges, scratch, True), scratch)
        turn += 1
        stats = _both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        stats = scratch.keep(stats.withColumn("prio", F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v").alias("k"))))
        low = stats.where("deg <= 2")
        best = low.select(F.explode(F.when(F.col("deg") == 1, F.array("lo")).otherwise(F.array("lo", "hi"))).alias("v"), F.col("prio").alias("other")).groupBy("v").agg(F.min("other").alias("other"))
        gone = scratch.keep(low.join(best, "v", "left").where(F.col("other").isNull() | (F.col("prio") < F.col("other"))).select("v", "deg", F.col("lo").alias("to"), "hi"))
        if not rows_of(gone):
            break
        # hubs have more than two links and so are never removed: their edges need no look-up at that end
        least = max(HEAVY_ROWS, n // HEAVY_SHARE)
        hubs = [r[0] for r in stats.where(F.col("deg") >= least).select("v").collect()] if n >= HEAVY_ROWS else []
        pointers.append((gone.select("v", "to"), hubs))  # a vertex has no more pointers to it than links
        left = edges
        for end in ("a", "b"):
            dead = gone.select(F.col("v").alias(end))
            safe = left.where(F.col(end).isin(hubs)) if hubs else None
            left = (left.where(~F.col(end).isin(hubs)) if hubs else left).join(dead, end, "left_anti")
            left = left.unionByName(safe) if safe is not None else left
        bridges = gone.where("deg = 2 and to != hi").select(F.col("to").alias("a"), F.col("hi").alias("b"))
        old, edges = edges, scratch.keep(_tidy(left.select("a", "b").unionByName(bridges)))
        scratch.drop(old)
        scratch.drop(stats)
    core, done = _hook_rounds(edges, scratch)
    return _resolve(pointers + core, done, scratch)


def least_labels(roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) of every vertex in a component of two or more, ``label`` the component's least vertex."""
    least = scratch.keep(roots.groupBy("root").agg(F.least(F.min("v"), F.first("root")).alias("label")))
    heavy = heavy_keys(roots, "root", rows_of(roots))
    inner = join_on_unique(roots, least, "root", "inner", heavy).select("v", "label")
    return inner.unionByName(least.select(F.col("root").alias("v"), "label"))


def link_components(edges: DataFrame, scratch: Scratch, solver: Callable = strip_and_compress) -> DataFrame:
    """(v, label) for every vertex that has a link to another vertex; empty without such links."""
    roots = solver(edges.select("a", "b"), scratch)
    if roots is None:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("label")).where(F.lit(False))
    return scratch.keep(least_labels(roots, scratch))


def group_labels(members: DataFrame, scratch: Scratch, solver: Callable = strip_and_compress) -> tuple[DataFrame, DataFrame]:
    """(item, grp, n) with each item's least group and their number, and (grp, label) of the groups that items link to other groups.

    ``members``: distinct (item, grp). In the graph of items and groups, items in one group are vertices of degree one: they
    are stripped first and get their label back last; items in two are compressed to a link between the groups, items in
    more to a star on their least group. The groups are then solved as a graph of their own. ``label`` is the least group.
    """
    items = scratch.keep(members.groupBy("item").agg(F.min("grp").alias("grp"), F.count(F.lit(1)).alias("n")))
    many = items.where("n > 1").select("item", F.col("grp").alias("a"))
    hot = [r[0] for r in items.where(F.col("n") >= HEAVY_ROWS).orderBy(F.desc("n")).limit(HEAVY_SHARE).select("item").collect()]
    links = join_on_unique(members.withColumnRenamed("grp", "b"), many, "item", "inner", hot).select("a", "b")
    labels = link_components(links, scratch, solver).select(F.col("v").alias("grp"), "label")
    return items, labels


def group_memberships(members: DataFrame, scratch: Scratch, solver: Callable = strip_and_compress) -> DataFrame:
    """(item, label) of every item: items that share a group, directly or through others, share ``label``, their least group."""
    items, labels = group_labels(members, scratch, solver)
    heavy = heavy_keys(items, "grp", rows_of(items))
    return join_on_unique(items, labels, "grp", "left", heavy).select("item", F.coalesce("label", "grp").alias("label"))

"""Connected components by alternating large-star and small-star steps over contracted edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_dir
from .skew import HOT_SHARE, hot_safe_join

#: Bytes of edges that a task contracts at once; edges that a task of a step writes.
BUFFER, EDGES = 1 << 25, 1 << 19


def _star(edges: DataFrame, total: int, tables: list[str]) -> DataFrame:
    """Rows (u, v, m): m is the smallest node among u and its v. A node with much of the edges is no hot key.

    Minima are written first (the path goes to ``tables``), so the plan of a step stays small.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("v_low"), F.count("*").alias("n")).select("u", F.least("u", "v_low").alias("m"), "n")
    low = _kept(low, tables, total)
    most = low.agg(F.max("n")).first()[0] or 0
    if most <= max(1.0, total * HOT_SHARE):
        return edges.join(low.drop("n"), "u")
    return hot_safe_join(edges, low, ["u"], "n", total, "inner")


def _kept(df: DataFrame, tables: list[str], rows: int | None = None) -> DataFrame:
    """``df`` written and read again, by as many tasks as its number of ``rows`` (at most) asks for."""
    path = shared_dir(df.sparkSession, "components")
    (df if rows is None else df.coalesce(1 + rows // EDGES)).write.parquet(path)
    tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component among nodes 0 to n - 1, by passing minima on and jumping pointers."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[src], low[dst])
        new = low.copy()
        for end in (low[src], low[dst]):  # whole trees move, not the node alone
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        new = new[low]
        if (new == low).all():
            return low
        low = new


def contracted(u: pa.Array, v: pa.Array) -> pa.RecordBatch:
    """A star around the smallest node of each component of these edges: the same components with the fewest edges."""
    both = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[both.indices.to_numpy()]
    low = labels(at[: len(u)], at[len(u) :], len(order))
    leaf = np.flatnonzero(low < np.arange(len(low)))
    take = lambda i: both.dictionary.take(pa.array(order[i], pa.int64()))
    return pa.RecordBatch.from_arrays([take(leaf), take(low[leaf])], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)
        return contracted(one(t["u"]), one(t["v"]))

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) > BUFFER:
            out = star()
            if out.nbytes > BUFFER // 2:  # little to gain from holding it any longer
                yield out
                held = []
            else:
                held = [out]
    if held:
        yield star()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def connected_components(edges: DataFrame, max_steps: int = 100, contract: bool = True) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has columns ``src`` and ``dst`` of one orderable type; loops, repeats, both directions and rows with
    a null are allowed and add nothing. Returns ``node, component`` with the smallest node of each component, for
    nodes that have an edge to another node; an empty input gives an empty result.

    Every task first contracts the edges it holds, 32 MB at a time, to stars with the same components (not with
    ``contract=False``; the result is the same). Then large-star and small-star steps alternate until nothing changes,
    whatever the size: each takes shuffles of at most the edges there are and is written to the shared folder, so
    lineage stays short; a node's edges are pre-aggregated to a minimum, and those of nodes with many are joined with
    it where they are.
    """
    spark = edges.sparkSession
    clean = edges.filter("src is not null and dst is not null and src <> dst")
    now = clean.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    kind = now.schema["u"].dataType.simpleString()
    if contract:
        now = now.mapInArrow(_contract, f"u {kind}, v {kind}")
    tables: list[str] = []
    now = _kept(now.distinct(), tables)
    before = _state(now)
    total = before[0]
    for _ in range(max_steps if total else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * total, tables).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(_kept(large, tables, 2 * total), 2 * total, tables)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = _kept(small.filter("u <> v").distinct(), tables, 2 * total)
        while len(tables) > 1:
            remove(spark, tables.pop(0))
        state = _state(now)
        if state == before:  # stars around the smallest nodes stay as they are, nothing else does
            break
        before, total = state, state[0]
    else:
        if total:
            raise RuntimeError(f"components did not settle in {max_steps} steps")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

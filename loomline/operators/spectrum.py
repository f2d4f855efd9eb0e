"""Extreme eigenvalues of graph Laplacians by Lanczos steps whose products are joins and sums of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_dir, written


#: Graphs whose values share a row of a node.
SLOTS = 8


def laplacian_ends(edges: DataFrame, by: str = "graph", most: int = 120, tol: float = 1e-8, every: int = 5, seed: int = 7) -> DataFrame:
    """``by, n_nodes, lambda_2, lambda_max, kappa, steps`` of weighted graphs ``by, a, b, w`` (weights above 0, no loops).

    ``lambda_2`` is the smallest eigenvalue on vectors with sum 0 (the Fiedler value; 0 if the graph is not connected)
    over the nodes that have an edge. All graphs take their steps in the same jobs. A step is one product: a join of the
    edges with the vector and a sum by node; only sums over nodes and two coefficients a step and graph reach the
    driver. Steps end when both ends have moved by less than ``tol`` in ``every`` steps, or after ``most``: the values
    are then bounds from inside. No matrix is made. Up to ``SLOTS``
    graphs share the rows of their nodes and edges, so that nested graphs are joined once a step.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(by).alias("g"), "a", "b", F.col("w").cast("double").alias("w"))
    kind = e.schema["g"].dataType.simpleString()
    names = [r.g for r in e.select("g").distinct().orderBy("g").collect()]
    slots = range(min(SLOTS, len(names)))
    if not names:
        return spark.createDataFrame([], f"`{by}` {kind}, n_nodes long, lambda_2 double, lambda_max double, kappa double, steps int")
    place = F.broadcast(spark.createDataFrame([(g, *divmod(i, len(slots))) for i, g in enumerate(names)], f"g {kind}, p int, s int"))
    e = e.join(place, "g").drop("g")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "p", "s"))
    both = written(both.groupBy("p", "a", "b").agg(*[F.sum(F.when(F.col("s") == i, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i in slots]), "spectrum-edges")
    of = F.broadcast(spark.createDataFrame([(i // len(slots), *[names[i + j] if i + j < len(names) else None for j in slots]) for i in range(0, len(names), len(slots))], ", ".join(["p int", *[f"g{i} {kind}" for i in slots]])))
    start = lambda i: F.when(F.col(f"d{i}") > 0, (F.pmod(F.xxhash64(F.lit(seed), f"g{i}", "a"), F.lit(1 << 20)) + 0.5) / float(1 << 20)).otherwise(0.0)
    nodes = both.groupBy("p", "a").agg(*[F.sum(f"w{i}").alias(f"d{i}") for i in slots]).join(of, "p")
    state = written(nodes.select("p", F.col("a").alias("node"), *[c for i in slots for c in (F.col(f"d{i}"), F.lit(0.0).alias(f"last{i}"), F.lit(0.0).alias(f"cur{i}"), start(i).alias(f"y{i}"))]), "spectrum-start")
    at = {(i // len(slots), i % len(slots)): g for i, g in enumerate(names)}

    def totals(df: DataFrame, **sums) -> list:
        """The sums by graph: (graph, a dictionary of them)."""
        told = df.groupBy("p").agg(*[F.sum(c(i)).alias(f"{k}{i}") for i in slots for k, c in sums.items()]).collect()
        return [(at[r.p, i], {k: r[f"{k}{i}"] for k in sums}) for r in told for i in slots if (r.p, i) in at]

    times = lambda x, y: lambda i: F.col(f"{x}{i}") * F.col(f"{y}{i}")
    sums = totals(state, n=lambda i: (F.col(f"d{i}") > 0).cast("long"), sy=lambda i: F.col(f"y{i}"), yy=times("y", "y"))
    n = {g: t["n"] for g, t in sums}
    alive = {g: (0.0, t["sy"] / t["n"], float(np.sqrt(max(0.0, t["yy"] - t["sy"] ** 2 / t["n"])))) for g, t in sums}  # alpha, mean, beta
    alive = {g: c for g, c in alive.items() if c[2] > 0}
    alphas, betas, ends, steps = {g: [] for g in n}, {g: [] for g in n}, {g: (0.0, 0.0) for g in n}, dict.fromkeys(n, 0)
    path = None
    for step in range(most):
        if not alive:
            break
        # a row a part: its graphs' coefficients, 0 for those that have ended
        told = [(p, *[x for i in slots for x in alive.get(at.get((p, i)), (0.0, 0.0, 0.0))]) for p in sorted({q for q, i in at if at[q, i] in alive})]
        c = F.broadcast(spark.createDataFrame(told, ", ".join(["p int", *[f"{x}{i} double" for i in slots for x in ("alpha", "mean", "beta")]])))
        # the vector of this step: what the last product left after its own direction and the mean are taken away
        left = lambda i: F.when((F.col(f"d{i}") > 0) & (F.col(f"beta{i}") > 0), (F.col(f"y{i}") - F.col(f"alpha{i}") * F.col(f"cur{i}") - F.col(f"mean{i}")) / F.col(f"beta{i}")).otherwise(0.0)
        now = state.join(c, "p").select("p", "node", *[x for i in slots for x in (F.col(f"d{i}"), F.col(f"cur{i}").alias(f"last{i}"), left(i).alias(f"cur{i}"), F.col(f"beta{i}"))])
        met = both.join(now.select("p", F.col("node").alias("b"), *[f"cur{i}" for i in slots]), ["p", "b"]).groupBy("p", F.col("a").alias("node")).agg(*[F.sum(F.col(f"w{i}") * F.col(f"cur{i}")).alias(f"ax{i}") for i in slots])
        before = lambda i: F.col(f"beta{i}") if step else F.lit(0.0)
        new = now.join(met, ["p", "node"]).select("p", "node", *[x for i in slots for x in (F.col(f"d{i}"), F.col(f"last{i}"), F.col(f"cur{i}"), (F.col(f"d{i}") * F.col(f"cur{i}") - F.col(f"ax{i}") - before(i) * F.col(f"last{i}")).alias(f"y{i}"))])
        fresh = shared_dir(spark, "spectrum-step")
        new.write.parquet(fresh)
        state = spark.read.schema(new.schema).parquet(fresh)
        if path:
            remove(spark, path)
        path = fresh
        for g, t in totals(state, cy=times("cur", "y"), cc=times("cur", "cur"), yy=times("y", "y"), sy=lambda i: F.col(f"y{i}"), sc=lambda i: F.col(f"cur{i}")):
            if g not in alive:
                continue
            cy, cc, yy, sy, sc = t["cy"], t["cc"], t["yy"], t["sy"], t["sc"]
            alpha = cy / cc
            mean = (sy - alpha * sc) / n[g]
            beta = float(np.sqrt(max(0.0, yy - 2 * alpha * cy + alpha**2 * cc - n[g] * mean**2)))
            alphas[g].append(alpha)
            betas[g].append(beta)
            steps[g] = step + 1
            over = beta < 1e-9 * max(1.0, abs(alpha)) or step + 1 >= most
            if over or (step + 1) % every == 0:
                t = np.diag(alphas[g]) + np.diag(betas[g][:-1], 1) + np.diag(betas[g][:-1], -1)
                ev = np.linalg.eigvalsh(t)
                low, high = float(max(ev[0], 0.0)), float(ev[-1])
                over = over or max(abs(low - ends[g][0]), abs(high - ends[g][1])) < tol
                ends[g] = low, high
            if over:
                alive.pop(g)
            else:
                alive[g] = alpha, mean, beta
    rows = [(g, n[g], low if n[g] > 1 else None, high, high / low if low > 1e-12 * max(1.0, high) else float("inf"), steps[g]) for g, (low, high) in ends.items()]
    return spark.createDataFrame(rows, f"`{by}` {kind}, n_nodes long, lambda_2 double, lambda_max double, kappa double, steps int")

"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, release


def _star(edges: DataFrame, salts: int) -> DataFrame:
    """edges: a > b, for the step in question keyed by `a`: adds the least neighbour of `a`.

    Minima are taken by (a, salt of b) and then by a; they come back by (a, salt), so that a hub's edges lie in as
    many tasks as there are salts.
    """
    salted = edges.withColumn("salt", F.expr(f"pmod(xxhash64(b), {salts})").cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("low"))
    least = parts.groupBy("a").agg(F.min("low").alias("least"), F.collect_set("salt").alias("salts"))  # `salts` values at most
    return salted.join(least.select("a", "least", F.explode("salts").alias("salt")), ["a", "salt"]).drop("salt")


def contracted(edges: DataFrame, tasks: int, most: int) -> DataFrame:
    """The edges of each task as stars around the least node of what is connected within the task.

    Works on the table's own partitions, joined to `tasks` of them, so nothing is shuffled. A task holds `most` nodes
    at most: more are sent on and begun anew, which leaves the components as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            far = [(x, r) for x in list(up) if (r := root(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in far], kind), pa.array([r for _, r in far], kind)], names=["a", "b"])

        for batch in batches:
            kind = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > most:
                yield stars()
        if up:
            yield stars()
        release()

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def connected(edges: DataFrame, work: Workspace, name: str = "components", rounds: int = 60, per_task: int = 200_000) -> DataFrame:
    """edges: a, b of one orderable type. node, root for each node of an edge; root is the component's least node.

    Each round first contracts what lies in one task (`per_task` edges or so), then takes large-star and small-star
    steps over all. Nodes' neighbours are never gathered: a step takes minima with partial sums and joins them back. The
    number of rounds grows with the logarithm of the component size; each round's edges are a table in the shared
    folder. Edges that fit one task are contracted there once and for all.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = work.save(now, f"{name}-0")
    count = now.count()
    salts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    before = None
    for k in range(1, rounds):
        tasks = max(1, -(-count // per_task))
        # a task of a small table may hold all its edges, twice as many nodes at most
        local = contracted(now, tasks, 1_000_000 if tasks > 1 else 2 * per_task + 1)
        if tasks == 1:
            now = work.save(local, f"{name}-{k}")
            work.drop(f"{name}-{k - 1}")
            break
        both = local.unionByName(local.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, salts).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        small = _star(large, salts)
        nxt = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(small.select("a", F.col("least").alias("b"))).distinct()
        nxt = work.save(nxt, f"{name}-{k}")
        sign = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        now, count = nxt, sign[0]
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

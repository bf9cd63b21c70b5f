"""Samples and shuffles by one sequential 64-bit xorshift generator, reproduced without running through all records.

The generator is linear over bits, so its state after any number of steps is a product with a power of one bit matrix:
each sampled record gets the state at which its own shuffle begins, and executors shuffle records independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.graph import in_order
from evidra.operators.lineage import cut

_WORD = (1 << 64) - 1
#: The shifts of the generator.
LEFT, RIGHT, AGAIN = 13, 7, 17


def step(state: int) -> int:
    state ^= (state << LEFT) & _WORD
    state ^= state >> RIGHT
    return state ^ ((state << AGAIN) & _WORD)


def _apply(matrix: list[int], state: int) -> int:
    out = 0
    while state:
        low = state & -state
        out ^= matrix[low.bit_length() - 1]
        state ^= low
    return out


class Jumps:
    """Powers of the generator's matrix, made as they are needed."""

    def __init__(self):
        self.powers = [[step(1 << b) for b in range(64)]]

    def ahead(self, state: int, steps: int) -> int:
        """The state after `steps` steps."""
        k = 0
        while steps:
            if len(self.powers) == k:
                last = self.powers[-1]
                self.powers.append([_apply(last, column) for column in last])
            if steps & 1:
                state = _apply(self.powers[k], state)
            steps >>= 1
            k += 1
        return state


def seeded(seed: int) -> int:
    if not 0 < seed <= _WORD:
        raise ValueError("the seed is a 64-bit number above 0, at which the generator stands still")
    return seed


def partial_shuffle(total: int, count: int, seed: int) -> tuple[list[int], int]:
    """The first `count` places of a Fisher-Yates shuffle of 0 to total - 1 and the generator's state after it.

    Only places that were moved are held: 2 * count of them at most.
    """
    state, moved, found = seeded(seed), {}, []
    for i in range(min(count, total)):
        state = step(state)
        j = i + state % (total - i)
        found.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
        moved.pop(i, None)
    return found, state


def shuffled_letters(text: str, state: int) -> str:
    """A Fisher-Yates shuffle from the last place to the second."""
    letters = list(text)
    for i in range(len(letters) - 1, 0, -1):
        state = step(state)
        j = state % (i + 1)
        letters[i], letters[j] = letters[j], letters[i]
    return "".join(letters)


def sampled(records: DataFrame, order: list, count: int, seed: int) -> tuple[DataFrame, int]:
    """The sampled records with `draw`, from 0 in order of the draws, and the generator's state after the sample.

    order: a total order of the records; it takes the place of their order in a file. Only the sample's places are on
    the driver and broadcast. Nulls and repeated records are records like others.
    """
    numbered = cut(in_order(records, order, "__rank"))
    places, state = partial_shuffle(numbered.count(), count, seed)
    drawn = records.sparkSession.createDataFrame([(p, k) for k, p in enumerate(places)], "__rank bigint, draw bigint")
    return numbered.join(F.broadcast(drawn), "__rank").drop("__rank"), state


def shuffled_sample(records: DataFrame, order: list, count: int, seed: int, sequence: str = "sequence", prefix: str = "ENTRAP_SHUFFLED_") -> DataFrame:
    """control (prefix and a number of five digits), sequence (shuffled) and the other columns of sampled records.

    One generator makes the sample and then shuffles record after record. Records share nothing but the states at
    which they begin, which follow from the lengths of the records before. Null sequences are empty.
    """
    spark = records.sparkSession
    own, state = sampled(records.withColumn(sequence, F.coalesce(sequence, F.lit(""))), order, count, seed)
    own = cut(own)
    jumps, starts = Jumps(), []
    for draw, n in sorted((r.draw, r.n) for r in own.select("draw", F.length(sequence).alias("n")).collect()):  # the sample
        starts.append((draw, state - (1 << 64) if state >> 63 else state))
        state = jumps.ahead(state, max(0, n - 1))
    begun = own.join(F.broadcast(spark.createDataFrame(starts, "draw bigint, __state bigint")), "draw")
    rest = [c for c in records.columns if c != sequence]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shuffled_letters(t, s & _WORD) for t, s in zip(batch.column(sequence).to_pylist(), batch.column("__state").to_pylist(), strict=True)]
            names = [f"{prefix}{d:05d}" for d in batch.column("draw").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), *(batch.column(c) for c in rest)], names=["control", sequence, *rest])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != sequence)
    return begun.mapInArrow(run, f"control string, `{sequence}` string, {kinds}")


def matched_controls(patterns: DataFrame, controls: DataFrame, pattern: str = "peptide", seed: int = 8) -> DataFrame:
    """Which controls hold patterns: control, n_hits (overlapping places). controls: control, sequence. I counts as L."""
    from evidra.operators.matching import substring_join

    folded = patterns.select(F.translate(pattern, "I", "L").alias("p")).distinct()
    hits = substring_join(folded, controls.select("control", F.translate("sequence", "I", "L").alias("s")), "p", "s", seed=seed)
    return hits.groupBy("control").agg(F.count(F.lit(1)).alias("n_hits"))


def control_rate(patterns: DataFrame, controls: DataFrame, pattern: str = "peptide", seed: int = 8) -> DataFrame:
    """One row: n_controls (those with a sequence), n_matched, n_hits, rate. No controls with a sequence is an error."""
    own = controls.where("sequence <> ''")
    found = matched_controls(patterns, own, pattern, seed).agg(F.count(F.lit(1)).alias("n_matched"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_hits"))
    total = own.agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("no control has a sequence")).cast("bigint")).otherwise(F.col("n"))
    return total.crossJoin(found).select(n.alias("n_controls"), "n_matched", "n_hits", (F.col("n_matched") / F.col("n")).alias("rate"))  # one row each

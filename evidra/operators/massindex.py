"""Mass-tolerant search over an index of k-mer masses.

Masses are whole numbers of millionths of a dalton, so that no rounding depends on how sums are formed. The index is
the sequences in overlapping pieces and the number of k-mers of each bin. A table of (bin, salt, target, place), bucketed
and sorted by bin and salt so that `places` joins it without a shuffle, is written when it is first asked for: it takes
some ten times the room of the sequences. A frequent bin is dealt out over salts there.

A place with `least` votes out of a query's n k-mers is met by any n - least + 1 of them, so each query asks with its
rarest bins only: common k-mers never multiply. Searches of many queries take groups of pieces against blocks of queries:
a task makes the bins of a group, meets the block's rarest bins, counts all votes on the residues and, where one row of
each query is wanted, hands on the best of the group. No k-mer and no place is a row of a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions.sequence import RESIDUE_MASS, characters
from evidra.operators.lineage import cut
from evidra.session import shared_dir

UNIT = 1_000_000
#: Bin width and least mass of the index in daltons, water and proton, tolerance, extra lengths tried.
WIDTH, LEAST_MASS, WATER, PROTON, PPM, EXTRA = 0.001, 280.0, 18.010565, 1.007276, 20.0, 2
#: Lengths of predictions that are searched.
SHORTEST, LONGEST = 8, 50
PIECE = 1024
#: Pieces of a group, queries of a block, blocks of a task, meetings looked at at once.
GROUP, BLOCK, BLOCKS, MEETINGS = 1024, 4096, 32, 1 << 16
_MASS = np.zeros(256, np.int64)
for _residue, _mass in RESIDUE_MASS.items():
    _MASS[ord(_residue)] = round(_mass * UNIT)


@dataclass(frozen=True)
class MassIndex:
    """name: the bucketed table, see `rows`; counts: bin, n, salts; pieces: target, piece, residues; rule: see `bins`."""

    name: str
    k: int
    rule: str
    counts: DataFrame
    pieces: DataFrame
    targets: DataFrame
    root: str
    buckets: int | None

    def rows(self, spark: SparkSession) -> DataFrame:
        """bin, salt, target, place; writes the table the first time."""
        if not spark.catalog.tableExists(self.name):
            buckets = self.buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(self.counts.agg(F.sum("n")).first()[0] or 0) // 5_000_000))
            frequent = self.counts.where("salts > 1").select("bin", "salts")  # less than rows / hot of them, and no more than there are bins
            salted = kmers(self.targets, "target", self.k, self.rule).join(F.broadcast(frequent), "bin", "left").withColumn("salt", F.coalesce(F.expr("pmod(xxhash64(target, place), salts)"), F.lit(0)).cast("int")).drop("salts")
            dealt = salted.select("bin", "salt", "target", "place").repartition(buckets, "bin", "salt").sortWithinPartitions("bin", "salt")
            dealt.write.bucketBy(buckets, "bin", "salt").sortBy("bin", "salt").option("path", f"{self.root}/index").saveAsTable(self.name)
        return spark.table(self.name)


def bins(mass: np.ndarray, rule: str) -> np.ndarray:
    """nearest: the nearest multiple of the width; from_least: whole widths above the least mass, 0 below it."""
    width = round(WIDTH * UNIT)
    if rule == "nearest":
        return (mass + width // 2) // width
    if rule == "from_least":
        return np.maximum(mass - round(LEAST_MASS * UNIT), 0) // width
    raise ValueError("rule is nearest or from_least")


def _residues(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of ASCII strings; nulls are empty."""
    texts = [x or "" for x in column.to_pylist()]
    return np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def kmers(df: DataFrame, key: str, k: int, rule: str) -> DataFrame:
    """df: the key and `sequence`. key, place, bin of every k-mer; a letter that is no residue weighs nothing."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _residues(batch.column(1))
            total = np.concatenate([[0], np.cumsum(_MASS[data])])
            n = np.maximum(np.diff(offsets) - k + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = offsets[:-1][row] + place
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(bins(total[at + k] - total[at], rule), pa.int32())], names=[key, "place", "bin"])

    return df.select(key, "sequence").mapInArrow(run, f"`{key}` {kind}, place int, bin int")


def _counted(pieces: DataFrame, k: int, rule: str) -> DataFrame:
    """bin, n of the k-mers that start in the first PIECE residues of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            made, local, _, _ = _laid_out(batch.column(0), k, rule)
            own = np.bincount(made[(made >= 0) & (local < PIECE)], minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bin", "n"])

    return pieces.select("residues").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def write_index(targets: DataFrame, k: int = 5, rule: str = "from_least", buckets: int | None = None, hot: int = 1_000_000) -> MassIndex:
    """targets: target, sequence (upper-case residues). Writes pieces and counts to the shared folder, see the module."""
    spark = targets.sparkSession
    root = f"{shared_dir(spark)}/evidra/mass-index-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    starts = F.sequence(F.lit(0), F.greatest(F.length("sequence") - 1, F.lit(0)), F.lit(PIECE))
    pieces = targets.where("sequence is not null").select("target", "sequence", F.explode(starts).alias("at"))
    pieces = pieces.select("target", F.expr(f"at div {PIECE}").cast("int").alias("piece"), F.expr(f"substr(sequence, at + 1, {PIECE + LONGEST + EXTRA})").alias("residues"))
    pieces = save(pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "target", "piece"), "pieces")
    counts = save(_counted(pieces, k, rule).withColumn("salts", F.ceil(F.col("n") / hot).cast("int")), "counts")
    return MassIndex(f"evidra_mass_index_{uuid.uuid4().hex}", k, rule, counts, pieces, targets, root, buckets)


def anchors(predictions: DataFrame) -> DataFrame:
    """Searchable predictions: query (its sequence), sequence, score, mass, mass_source, by best score.

    predictions: sequence, score and, where known, mz and charge. Sequences are trimmed and upper-cased; they hold
    residues only, 8 to 50 of them, and none more often than in half of their places. A missing score is 0. The mass
    is the measured one if m/z and charge are above 0, else the theoretical one. Ties of scores go to the measured
    row of smallest mass.
    """
    for column in ("mz", "charge"):
        if column not in predictions.columns:
            predictions = predictions.withColumn(column, F.lit(None).cast("double"))
    own = predictions.select(F.upper(F.trim("sequence")).alias("sequence"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "mz", "charge").where(searchable("sequence"))
    measured = F.when((F.col("mz") > 0) & (F.col("charge") > 0), F.col("mz") * F.col("charge") - F.col("charge") * PROTON)
    measured = F.when(measured > 0, measured)
    weights = F.create_map(*[F.lit(x) for r, m in RESIDUE_MASS.items() for x in (r, round(m * UNIT))])
    theoretical = F.aggregate(characters(F.col("sequence")), F.lit(0).cast("bigint"), lambda a, x: a + weights[x]) / UNIT + WATER
    row = F.struct(F.col("score"), measured.isNotNull().alias("known"), (-F.coalesce(measured, theoretical)).alias("minus"), F.when(measured.isNotNull(), "measured").otherwise("theoretical").alias("source"))
    best = own.groupBy("sequence").agg(F.max(row).alias("b"))
    return best.select(F.col("sequence").alias("query"), "sequence", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("mass"), F.col("b.source").alias("mass_source"))


def searchable(sequence: str):
    """8 to 50 residues, none in more than half of the places."""
    letters = characters(F.col(sequence))
    common = F.array_max(F.transform(F.array_distinct(letters), lambda r: F.size(F.filter(letters, lambda x: x == r))))
    return F.coalesce(F.col(sequence).rlike(f"^[{''.join(RESIDUE_MASS)}]{{{SHORTEST},{LONGEST}}}$") & (common * 2 <= F.length(sequence)), F.lit(False))


def _rarest(index: MassIndex, queries: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """query, place of the k-mers that a query asks with, and query, place, bin, salts of all that may vote."""
    own = cut(kmers(queries, "query", index.k, index.rule))
    near = own.select("query", "place", F.explode(F.expr("sequence(bin - 1, bin + 1)")).alias("bin"))
    known = cut(near.join(index.counts, "bin"))  # bins that the index lacks can't vote
    load = known.groupBy("query", "place").agg(F.sum("n").alias("load"))
    # k-mers without a row in the index can't vote, so a place needs `least` of the others
    needed = load.groupBy("query").agg((F.count(F.lit(1)) - least + 1).alias("needed"))
    rarest = load.join(needed, "query").withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("load", "place"))).where("rn <= needed")
    return rarest.select("query", "place"), known


def places(index: MassIndex, queries: DataFrame, least: int) -> DataFrame:
    """queries: query, sequence. query, target, start that can have `least` votes; start is from 0. Joins the bucketed
    table, for a few queries on an index that is kept; `voted` takes many."""
    rarest, known = _rarest(index, queries, least)
    asking = known.join(rarest, ["query", "place"]).select("query", F.col("place").alias("offset"), "bin", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    hits = index.rows(queries.sparkSession).join(asking.hint("shuffle_hash"), ["bin", "salt"]).where("place >= offset")
    return hits.select("query", "target", (F.col("place") - F.col("offset")).alias("start")).distinct()


def _laid_out(residues: pa.Array, k: int, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins (-9 where no k-mer starts), places in their row, running masses and first places of texts laid out in one
    array, each with room after it for the longest window."""
    room = LONGEST + EXTRA + k
    texts = [x or "" for x in residues.to_pylist()]
    n = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer("".join(t + "\0" * room for t in texts).encode("ascii", "replace"), np.uint8)
    base = np.cumsum(n + room) - n - room
    total = np.concatenate([[0], np.cumsum(_MASS[data])])
    local = np.arange(len(data)) - np.repeat(base, n + room)
    made = np.full(len(data), -9, np.int32)
    at = np.flatnonzero(local + k <= np.repeat(n, n + room))
    made[at] = bins(total[at + k] - total[at], rule)
    return made, local, total, base


def _best(found: list[np.ndarray], order: list[int]) -> list[np.ndarray]:
    """The first row of each query (column 0) in the order of some columns."""
    if not len(found[0]):
        return found
    at = np.lexsort([found[c] for c in reversed(order)] + [found[0]])
    own = found[0][at]
    at = at[np.concatenate([[True], own[1:] != own[:-1]])]
    return [c[at] for c in found]


def _meet(residues: pa.Array, numbers: np.ndarray, rank: np.ndarray, block: pa.StructArray, n: int, k: int, rule: str, least: int, ppm: float | None, one: bool) -> list[np.ndarray]:
    """Places of a group of pieces with `least` votes of a block of queries of n residues: query, rank of the target,
    start, votes and row; with `ppm` length, error and its hundredths as well. `one`: of each query the best.

    A place is counted at the first of the query's asking k-mers that votes for it.
    """
    width = n - k + 1
    made, local, total, base = _laid_out(residues, k, rule)
    size = pc.utf8_length(residues).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, _ = _residues(block.field("sequence"))
    masses = np.concatenate([np.zeros((len(block), 1), np.int64), np.cumsum(_MASS[data].reshape(len(block), n), 1)], 1)
    own = bins(masses[:, k:] - masses[:, :-k], rule).astype(np.int32)
    # so many k-mers are looked at first that a place without two votes among them can't have `least`
    columns, early = np.ascontiguousarray(own.T), min(width, max(width - least + 2, 0))
    asked = block.field("asked")
    who = np.repeat(np.arange(len(block)), np.diff(asked.offsets.to_numpy()))
    what = asked.flatten().to_numpy(zero_copy_only=False)
    asks = np.zeros((len(block), width), bool)
    asks[who, what] = True
    key = (own[who, what][:, None] + np.array([-1, 0, 1])).ravel()
    order = np.argsort(key, kind="stable")
    order = order[key[order] >= 0]
    most = max(int(made.max(initial=0)), int(key.max(initial=0))) + 1
    first = np.concatenate([[0], np.cumsum(np.bincount(key[order], minlength=most))])
    who, what = np.repeat(who, 3)[order], np.repeat(what, 3)[order]
    at = np.flatnonzero(made >= 0)
    n_met = first[made[at] + 1] - first[made[at]]
    at, n_met = at[n_met > 0], n_met[n_met > 0]
    done = np.cumsum(n_met)
    row_of = np.repeat(np.arange(len(size)), np.diff(np.append(base, len(made))))
    mass = block.field("mass").to_numpy(zero_copy_only=False).astype(np.float64)
    order = [3, 1, 2] if ppm is None else [3, 7, 1, 2, 5]
    kinds = [np.int64] * (5 if ppm is None else 6) + ([] if ppm is None else [np.float64, np.int64])
    parts, low = [], 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + MEETINGS, "right")))
        count = n_met[low:high]
        place = np.repeat(at[low:high], count)
        entry = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + first[made[place]]
        low = high
        query, offset = who[entry], what[entry]
        here = local[place] - offset
        inside = (here >= 0) & (here < PIECE)
        query, offset, start = query[inside], offset[inside], place[inside] - offset[inside]
        few = np.zeros(len(query), np.uint8)
        for c in range(early):
            few += (made.take(start + c) - columns[c].take(query) + np.int32(1)).view(np.uint32) <= 2
        some = np.flatnonzero(few >= least - (width - early))
        query, offset, start = query[some], offset[some], start[some]
        both = np.abs(made[start[:, None] + np.arange(width)] - own[query]) <= 1
        votes = both.sum(1)
        kept = np.flatnonzero(votes >= least)
        kept = kept[np.argmax(both[kept] & asks[query[kept]], 1) == offset[kept]]
        query, start, votes = query[kept], start[kept], votes[kept]
        row = row_of[start]
        found = [query, rank[row], numbers[row] * PIECE + local[start], -votes, row]
        if ppm is not None:
            lengths = np.arange(max(n - EXTRA, k), n + EXTRA + 1)
            error = np.abs((total[start[:, None] + lengths] - total[start][:, None]) / UNIT + WATER - mass[query][:, None]) / mass[query][:, None] * 1e6
            i, j = np.nonzero((error <= ppm) & (local[start][:, None] + lengths <= size[row][:, None]))
            error = error[i, j]
            whole = np.floor(error * 100)
            found = [*[c[i] for c in found], lengths[j], error, (whole + (error * 100 - whole >= 0.5)).astype(np.int64)]
        parts.append(_best(found, order) if one else found)
    found = [np.concatenate([p[c] for p in parts] or [np.zeros(0, kind)]) for c, kind in enumerate(kinds)]
    return _best(found, order) if one else found


def _search(index: MassIndex, queries: DataFrame, least: int, ppm: float | None = None, one: bool = False) -> DataFrame:
    """query, target, start, votes, n_kmers and window of places, or length and error_ppm with `ppm`. `one`: the best of
    each query in a group of pieces only."""
    spark, k, rule = queries.sparkSession, index.k, index.rule
    rarest, _ = _rarest(index, queries, least)
    asked = rarest.groupBy("query").agg(F.collect_list("place").alias("asked"))  # the k-mers of one query
    mass = F.col("mass").cast("double") if ppm is not None else F.lit(None).cast("double")
    own = cut(queries.select("query", "sequence", mass.alias("mass"), F.length("sequence").alias("n")).join(asked, "query"))
    sizes = own.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts"))  # a row for each length
    salted = own.join(F.broadcast(sizes), "n").groupBy("n", F.expr("pmod(xxhash64(query), salts)").alias("salt"))
    blocks = cut(salted.agg(F.collect_list(F.struct("query", "sequence", "mass", "asked")).alias("block")).drop("salt"))  # some BLOCK queries
    blocks = blocks.repartition(max(1, -(-blocks.count() // BLOCKS)))
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.pieces.schema]}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays([c])) for c in part.columns], names=["targets", "pieces", "residues"])

    groups = index.pieces.select("target", "piece", "residues").mapInArrow(pack, f"targets array<{kinds['target']}>, pieces array<int>, residues array<string>")
    rows = groups.crossJoin(blocks.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                targets, numbers, residues, n, block = (c[at] for c in batch.columns)
                targets, numbers, residues, n, block = targets.values, numbers.values.to_numpy(zero_copy_only=False).astype(np.int64), residues.values, n.as_py(), block.values
                if n < k:
                    continue
                coded = targets.dictionary_encode()
                rank = np.empty(len(coded.dictionary), np.int64)
                rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
                found = _meet(residues, numbers, rank[coded.indices.to_numpy(zero_copy_only=False)], block, n, k, rule, least, ppm, one)
                for low in range(0, len(found[0]), 1 << 16):
                    query, _, start, votes, row, *rest = (c[low : low + (1 << 16)] for c in found)
                    out = [block.field("query").take(pa.array(query)), targets.take(pa.array(row)), pa.array(start, pa.int32()), pa.array(-votes, pa.int64()), pa.array(np.full(len(query), n - k + 1), pa.int64())]
                    if ppm is None:
                        local = (start - numbers[row] * PIECE).tolist()
                        out.append(pa.array([t[a : a + n + EXTRA] for t, a in zip(residues.take(pa.array(row)).to_pylist(), local, strict=True)], pa.string()))
                    else:
                        out += [pa.array(rest[0], pa.int32()), pa.array(rest[1], pa.float64())]
                    yield pa.RecordBatch.from_arrays(out, names=["query", "target", "start", "votes", "n_kmers", *(["window"] if ppm is None else ["length", "error_ppm"])])

    last = "window string" if ppm is None else "length int, error_ppm double"
    return rows.select("targets", "pieces", "residues", "n", "block").mapInArrow(run, f"query {kinds['query']}, target {kinds['target']}, start int, votes bigint, n_kmers bigint, {last}")


def voted(index: MassIndex, queries: DataFrame, least: int) -> DataFrame:
    """query, target, start, votes, n_kmers and window (residues from the start on, two more than the query has)."""
    return _search(index, queries, least)


def anchored(index: MassIndex, queries: DataFrame, least: int = 1, ppm: float = PPM) -> DataFrame:
    """Best anchor of each query: query, target, start, length, votes, n_kmers, error_ppm.

    queries: query, sequence, mass. Of windows at most two residues shorter or longer than the query whose mass is
    within `ppm` of its mass: most votes, least error in hundredths, then target, start, length.
    """
    checked = _search(index, queries, least, ppm, True)
    order = F.struct(-F.col("votes"), F.round(F.col("error_ppm") * 100).cast("bigint"), "target", "start", "length")
    best = checked.groupBy("query").agg(F.min_by(F.struct("target", "start", "length", "votes", "n_kmers", "error_ppm"), order).alias("b"))
    return best.select("query", "b.*")


@dataclass(frozen=True)
class Prepared:
    """manifest: sample, n_peptides. pooled: peptide, score. matched: peptide. evidence: target. samples: sample, peptide, score."""

    manifest: DataFrame
    samples: DataFrame
    pooled: DataFrame
    matched: DataFrame
    evidence: DataFrame


def prepare(predictions: DataFrame, targets: DataFrame, top: float = 0.3) -> Prepared:
    """First phase of a rescue: searchable predictions of each sample, the best `top` of them, exact matches.

    predictions: sample, peptide, score. A share is rounded up; ties of scores go to the lesser peptide. Exact
    matches don't tell I from L. targets: target, sequence.
    """
    from evidra.operators.matching import substring_join

    own = predictions.select("sample", F.upper(F.trim("peptide")).alias("peptide"), F.coalesce("score", F.lit(0.0)).alias("score")).where(searchable("peptide"))
    manifest = own.groupBy("sample").agg(F.count(F.lit(1)).alias("n_peptides"))
    order = Window.partitionBy("sample").orderBy(F.desc("score"), "peptide")
    best = own.withColumn("rn", F.row_number().over(order)).join(manifest, "sample").where(F.col("rn") <= F.ceil(F.col("n_peptides") * F.lit(top)))
    samples = cut(best.groupBy("sample", "peptide").agg(F.max("score").alias("score")))
    pooled = samples.groupBy("peptide").agg(F.max("score").alias("score"))
    folded = lambda c: F.translate(c, "I", "L")
    hits = cut(substring_join(pooled.select(folded("peptide").alias("folded")).distinct(), targets.select("target", folded("sequence").alias("folded")), "folded", "folded", seed=SHORTEST).select("folded", "target").distinct())
    matched = pooled.withColumn("folded", folded("peptide")).join(hits.select("folded").distinct(), "folded", "left_semi").select("peptide")
    return Prepared(manifest, samples, pooled, cut(matched), hits.select("target").distinct())


def rescue(index: MassIndex, prepared: Prepared, least: int) -> DataFrame:
    """Second phase: of each sample's unmatched peptides the target with most votes, ties to the lesser target.

    sample, peptide, target, votes, n_kmers, score. A peptide is searched once, however many samples have it.
    """
    missing = prepared.pooled.join(prepared.matched, "peptide", "left_anti").select(F.col("peptide").alias("query"), F.col("peptide").alias("sequence"))
    votes = _search(index, cut(missing), least, one=True)
    best = votes.groupBy("query").agg(F.min_by(F.struct("target", "votes", "n_kmers"), F.struct(-F.col("votes"), "target")).alias("b")).select(F.col("query").alias("peptide"), "b.*")
    return prepared.samples.join(best, "peptide").select("sample", "peptide", "target", "votes", "n_kmers", "score")


def merged(*rescued: DataFrame) -> DataFrame:
    """Third phase: of each peptide the row with most votes over samples and parts of the targets: peptide, target,
    votes, score; ties to the lesser target, then to the first sample."""
    whole = rescued[0]
    for part in rescued[1:]:
        whole = whole.unionByName(part)
    best = whole.groupBy("peptide").agg(F.min_by(F.struct("target", "votes", "score"), F.struct(-F.col("votes"), "target", "sample")).alias("b"))
    return best.select("peptide", "b.*")


def enhanced(prepared: Prepared, union: DataFrame) -> DataFrame:
    """target, origin (exact, rescued or both) of the evidence lake with what was rescued."""
    exact = prepared.evidence.select("target", F.lit(1).alias("exact"))
    found = union.select("target").distinct().withColumn("found", F.lit(1))
    origin = F.when(F.col("found").isNull(), "exact").when(F.col("exact").isNull(), "rescued").otherwise("both")
    return exact.join(found, "target", "full").select("target", origin.alias("origin"))

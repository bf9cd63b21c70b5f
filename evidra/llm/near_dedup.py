"""MinHash near-dedup: fast similarity sketches, banding, exact verification.

1. A sketch has `rows * bands` coordinates. In round k each element of the set is hashed to one of them, with a value
   that begins with k; a coordinate keeps its least value. After as many rounds as there are coordinates, round k puts
   all elements into coordinate k modulo their number, so that every coordinate is filled, whatever the set's size.
   A set needs no further round once its coordinates are full: large ones take one round, small ones several, and the
   share of equal coordinates is concentrated around the similarity as with independent hashes.
2. `rows` consecutive coordinates make a band. Classes (distinct sets) with an equal band are joined to the least of
   them, already within a map task; connected components of these links are the groups of candidates.
3. In each group full sets are compared: a link stands only where 100 * intersection >= percent * union. Candidates
   that are connected already are not compared again, so that no group is expanded into its pairs.

With 8 rows and 80 bands a pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 8) ** 80 = 4e-7, one of
similarity 0.9 with less than 1e-19; a pair of similarity 0.1 meets with one of 8e-7. Verification decides all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import Signer, blocking_links, confirmed, sized_rows
from .sqltext import similarity_sql
from .storage import Workspace, partitions_for
from .textops import mix

SHINGLE, PERCENT = 2, 80
ROWS, BANDS = 8, 80
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_SEED = 20240817


def sketches(offsets: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Sketches of `width` coordinates of sets given by offsets and 64-bit hashes; those of empty sets are all ones."""
    sizes = np.diff(offsets)
    found = np.full((len(sizes), width), _EMPTY)
    flat = found.reshape(-1)
    rng = np.random.default_rng(_SEED)
    active = np.flatnonzero(sizes > 0)
    base = np.repeat(active * width, sizes[active])
    for k in range(2 * width):
        seed, odd, again = rng.integers(0, 1 << 63, 3, dtype=np.int64).view(np.uint64) | np.uint64(1)
        hashed = values ^ seed
        hashed *= odd
        hashed ^= hashed >> _HALF
        hashed *= again
        if k < width:
            cells = base + (((hashed >> _HALF) * np.uint64(width)) >> _HALF).view(np.int64)
        else:
            cells = base + (k - width)
        np.minimum.at(flat, cells, (np.uint64(k) << _HALF) | (hashed ^ (hashed >> _HALF)) & _VALUE)
        if k < 2 or k % 4 == 3:  # later rounds never change a full sketch, so it may take part in a few more
            open_ = (found[active] == _EMPTY).any(1)
            if not open_.all():
                values = values[np.repeat(open_, sizes[active])]
                active = active[open_]
                base = np.repeat(active * width, sizes[active])
                if not len(active):
                    break
    return found


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each sketch: one row for each sketch."""
    parts = sketch.reshape(len(sketch), sketch.shape[1] // rows, rows)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E6C63D0676A9A99) + parts[:, :, r])
    return keys


def band_signatures(rows: int, bands: int) -> Signer:
    def sign(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.flatnonzero(np.diff(offsets) > 0)
        return np.repeat(full, bands), band_keys(sketches(offsets, values, rows * bands)[full], rows).reshape(-1)

    return sign


def join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, block_limit: int = 2000, block_tokens: int = 2_000_000, carry: str | None = None) -> DataFrame:
    """Links documents whose sets of distinct `size`-word shingles have a Jaccard similarity of `percent` / 100 or more.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer than `size` words make one shingle. Returns one row
    for each row of `docs`: id, n_shingles, cls (16 bytes, the same for equal sets, empty for none), component_id (the
    least id reachable by links). Null and empty texts have no set and are linked with nothing; repeated rows are
    linked; null ids count only where a group has no other; very long texts are read whole. With `carry`, that column
    comes along as `carried`, and `root` tells the group. An empty table gives an empty result. Other columns,
    whatever their names, are not read. Groups of over `block_limit` classes or `block_tokens` shingles are dealt out
    over tasks and compared completely.
    """
    work = Workspace(spark, "near-dedup")
    own, sized = sized_rows(work, docs, id_col, text_col, size, carry)
    keys = (sized.where("n > 0").count()) * bands
    links = blocking_links(own.select("text"), partitions_for(spark, keys, 1_000_000), size, band_signatures(rows, bands), target=1 << 20)
    return confirmed(work, own, sized, links, size, percent, block_limit, block_tokens, carry)


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of two words, similarity of 0.8: see `join`. A row without an id is kept if its group has none."""
    got = join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), size=SHINGLE, percent=PERCENT)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = similarity_sql(SHINGLE, PERCENT, ", docs.doc_id = least.component_id AS kept")

"""Byte-level BPE by backtracking over longest matches, with exact merges and in linear time.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds all vocabulary entries in one pass over a piece.
An encoding is the one that merges give if and only if each two adjacent tokens are compatible, that is, merging the
bytes of the two gives the two again. The encoder therefore takes the longest match at a place that is compatible with
the token before it, backtracks where there is none, and never visits a dead place twice. Compatibility is memoised.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches
from .textops import text_blocks

#: Encoded pieces and token pairs that a worker remembers at most; beyond that it starts afresh.
MEMORY = 600_000
#: The pattern for which a single space between other characters starts a match.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_SPACE = re.compile(r" \s|\s ").search


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merges, for short pieces: joins the adjacent pair of least rank, leftmost first, as long as there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Codec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        size = max(self.token) + 1
        self.lengths = np.zeros(size, np.int64)
        for rank, token in self.token.items():
            self.lengths[rank] = len(token)
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or merged(token, ranks) == [rank]:  # others never come out of merges
                self.machine.add_word(token.decode("latin-1"), (len(token), rank))
        self.machine.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.by_runs = pattern == SPACED_PATTERN

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            known = self.pairs[left, right] = merged(self.token[left] + self.token[right], self.ranks) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (length, rank) in self.machine.iter(piece.decode("latin-1")):
            starts[end - length + 1].append((length, rank))  # ever longer ones, as ends only grow
        size, ids, tried, at = len(piece), [], [], 0
        dead = bytearray(size + 1)
        choice = len(starts[0]) - 1
        while at < size:
            own, found = starts[at], False
            while choice >= 0:
                length, rank = own[choice]
                if not dead[at + length] and (not ids or self.compatible(ids[-1], rank)):
                    found = True
                    break
                choice -= 1
            if found:
                ids.append(rank)
                tried.append((at, choice))
                at += length
                choice = len(starts[at]) - 1 if at < size else -1
            else:
                dead[at] = 1
                at, choice = tried.pop()
                ids.pop()
                choice -= 1
        return ids

    def _encode_run(self, text: str) -> bytes:
        known, out = self.pieces, []
        for piece in self.split(text):
            own = known.get(piece)
            if own is None:
                own = known[piece] = array("I", self.encode_piece(piece.encode())).tobytes()
            out.append(own)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers.

        A single space between two characters that are no white space starts a match of the pattern, whatever stands
        around it; runs between such spaces are therefore encoded, and remembered, one by one.
        """
        if len(self.pieces) > MEMORY or len(self.runs) > MEMORY:
            self.pieces.clear()
            self.runs.clear()
        if not self.by_runs or not text or text[0].isspace() or text[-1].isspace() or _WIDE_SPACE(text):
            return self._encode_run(text)
        first, *runs = text.split(" ")
        known = self.runs
        try:
            return self._encode_run(first) + b"".join([known[r] for r in runs])
        except KeyError:
            for r in runs:
                if r not in known:
                    known[r] = self._encode_run(" " + r)
            return self._encode_run(first) + b"".join([known[r] for r in runs])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(ranks), pattern)


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text (null: empty) and decodes the ids again: id, n_tokens, ids (little-endian uint32), decoded.

    Returns one row for each row of `docs`, equal and empty ones too; an empty table gives an empty result. The
    vocabulary file is read on the driver and sent to the executors, about 1 MB. Other columns are not read.
    """
    bounded_batches(spark)
    with open(ranks_path, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            for begin, offsets, data in text_blocks(batch.column("text"), 1 << 19):
                memory = data.tobytes()
                ids = [codec.encode(memory[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[begin : begin + len(ids)], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(list(map(codec.decode, ids)), pa.binary())], names=["id", "n_tokens", "ids", "decoded"])

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id bigint, n_tokens bigint, ids binary, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

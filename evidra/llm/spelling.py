"""Spelling variants: pairs of words at one error, by forward and backward minimal acyclic automata.

1. `word_counts` counts the words of all documents, with partial sums in map tasks.
2. Two words at one error, the shorter of c code points, agree in their first c // 2 code points (the error is behind
   them) or in their last c - c // 2 (it is before). So each word goes by hash of its first half to a forward unit and
   by hash of its last half to a backward one; words with one more code point also go with their shorter half. A unit
   holds words of three neighbouring lengths, some ten thousands of them; a half with more words than `hot` is dealt
   out over several units, each of which meets all its queries.
3. A unit builds the minimal acyclic automaton of its words (reversed ones in a backward unit). Transitions carry how
   many words come before, so that a walk also sums up the number of its word: a perfect hash to counts and spellings.
   Queries walk their half exactly, then go on with one code point inserted or replaced, all queries of a unit at once
   in arrays. The shorter word of a pair asks, so that nothing needs to be deleted; of pairs that agree in both halves
   the forward unit reports alone, and several ways to one word count once.
4. `variants` takes each word's near word of largest count and follows such forms to the last by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqltext import LOWER, UPPER, crc32_sql
from .storage import Workspace, partitions_for, release

#: The contract's figures: runs of letters, where a code point is left out, words' least length and count, the ratio.
LETTERS = "A-Za-zÀ-ÿ"
ERROR_EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
_LOWER = str.maketrans(UPPER, LOWER)
NEAR_SCHEMA = "word string, n bigint, other string, other_n bigint"


def spelled(doc_id: int | None, run: str, every: int = ERROR_EVERY) -> str:
    """A lower-cased run as it counts in a document: where `every` divides the crc32 h of `<doc_id>:<run>`, the code
    point h % length is left out. A null id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, every: int, flush: int = 200_000) -> DataFrame:
    """word, n of all words of at least `least` code points; shorter runs can't become such words and aren't read."""
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter[str] = Counter()
                for found, n in Counter(pattern.findall(text.as_py() or "")).items():
                    own[found.translate(_LOWER)] += n
                doc_id = doc_id.as_py()
                for found, n in own.items():
                    held[spelled(doc_id, found, every)] += n
                if len(held) > flush:
                    yield done()
        if held:
            yield done()
        release()

    counted = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


def code_matrix(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word as a row of 1 + the place of its code points in the sorted alphabet, with zeros behind; lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    found = np.zeros((len(words), int(sizes.max(initial=0))), np.int32)
    rows = np.repeat(np.arange(len(words)), sizes)
    found[rows, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.searchsorted(alphabet, codes) + 1
    return found, sizes


@dataclass
class Automaton:
    """A minimal acyclic automaton; `skip` of a transition: the words of its state that come before those behind it."""

    start: int
    final: np.ndarray
    begin: np.ndarray
    symbol: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, codes: np.ndarray, sizes: np.ndarray, symbols: int) -> Automaton:
        """codes: distinct words in lexicographic order, see `code_matrix`; the number of a word is its row."""
        n, width = codes.shape
        common = np.zeros(n, np.int64)  # code points shared with the word before
        if n > 1:
            differ = codes[1:] != codes[:-1]
            common[1:] = differ.argmax(1)
        known: dict[bytes, int] = {}
        finals, counts, symbol, target, skip, begin = [], [], [], [], [], [0]
        below = np.zeros(0, np.int64)  # states of the nodes one level further down
        for depth in range(width, -1, -1):
            new = (sizes >= depth) & ((common < depth) | (np.arange(n) == 0))
            rows = np.flatnonzero(new)
            ends = np.flatnonzero((sizes > depth) & ((common < depth + 1) | (np.arange(n) == 0))) if depth < width else np.zeros(0, np.int64)
            parent = np.searchsorted(rows, ends, "right") - 1
            first = np.searchsorted(parent, np.arange(len(rows) + 1)).tolist()
            arcs = (codes[ends, depth].astype(np.int64) << 32) | below if len(ends) else np.zeros(0, np.int64)
            packed, plain = arcs.tobytes(), arcs.tolist()
            states = []
            for k, is_final in enumerate((sizes[rows] == depth).tolist()):
                a, b = first[k], first[k + 1]
                key = packed[a * 8 : b * 8] + (b"\1" if is_final else b"")
                state = known.get(key)
                if state is None:
                    state = known[key] = len(finals)
                    total = int(is_final)
                    for arc in plain[a:b]:
                        symbol.append(arc >> 32)
                        target.append(arc & 0xFFFFFFFF)
                        skip.append(total)
                        total += counts[arc & 0xFFFFFFFF]
                    finals.append(is_final)
                    counts.append(total)
                    begin.append(len(symbol))
                states.append(state)
            below = np.array(states, np.int64)
        table = np.full((len(finals), symbols + 1), -1, np.int32)
        out = cls(int(below[0]), np.array(finals, bool), np.array(begin), np.array(symbol, np.int64), np.array(target, np.int64), np.array(skip, np.int64), table)
        table[np.repeat(np.arange(len(finals)), np.diff(out.begin)), out.symbol] = np.arange(len(out.symbol))
        return out

    def one_error(self, codes: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `codes` and numbers of the automaton's words that differ from them by one code point inserted into
        the row or replaced in it, behind its first `exact` ones. Each pair comes once."""
        none = np.zeros(0, np.int64)
        rows = np.arange(len(codes))
        state, number = np.full(len(codes), self.start), np.zeros(len(codes), np.int64)
        wrong = (none, none, none)  # rows, states, numbers of walks that have made their error
        out_rows, out_numbers = [], []

        def step(rows: np.ndarray, state: np.ndarray, number: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            arc = self.table[state, codes[rows, at]]
            ok = arc >= 0
            return rows[ok], self.target[arc[ok]], number[ok] + self.skip[arc[ok]]

        for at in range(codes.shape[1] + 1):
            open_ = exact[rows] <= at
            degree = np.where(open_, self.begin[state + 1] - self.begin[state], 0)
            arc = np.arange(degree.sum()) + np.repeat(self.begin[state] - (np.cumsum(degree) - degree), degree)
            far_rows, far = np.repeat(rows, degree), (self.target[arc], np.repeat(number, degree) + self.skip[arc])
            wrong = tuple(np.concatenate([x, y]) for x, y in zip(wrong, (far_rows, *far), strict=True))  # inserted
            ended = sizes[wrong[0]] == at
            hit = ended & self.final[wrong[1]]
            out_rows.append(wrong[0][hit])
            out_numbers.append(wrong[2][hit])
            if at == codes.shape[1]:
                break
            wrong = step(*(x[~ended] for x in wrong), at)
            other = (sizes[far_rows] > at) & (self.symbol[arc] != codes[far_rows, at])
            wrong = tuple(np.concatenate([x, y[other]]) for x, y in zip(wrong, (far_rows, *far), strict=True))  # replaced
            going = sizes[rows] > at
            rows, state, number = step(rows[going], state[going], number[going], at)
        total = max(int(x.max(initial=0)) for x in out_numbers) + 1
        both = np.unique(np.concatenate(out_rows) * total + np.concatenate(out_numbers))
        return both // total, both % total


def near_in_unit(words: list[str], counts: list[int], asks: list[bool], held: list[bool], backward: bool) -> tuple[list, list, list, list]:
    """Pairs of a unit, from the shorter word; held: words of the automaton, asks: queries. Columns of NEAR_SCHEMA."""
    index = list({words[i]: i for i, own in enumerate(held) if own}.values())
    queries = list({words[i]: i for i, own in enumerate(asks) if own}.values())  # a dealt-out half's queries may come twice
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not index or not queries:
        return out
    facing = [w[::-1] for w in words] if backward else words
    index.sort(key=facing.__getitem__)
    alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"))
    automaton = Automaton.build(*code_matrix([facing[i] for i in index], alphabet), len(alphabet))
    codes, sizes = code_matrix([facing[i] for i in queries], alphabet)
    rows, numbers = automaton.one_error(codes, sizes, sizes - sizes // 2 if backward else sizes // 2)
    for q, w in zip(rows.tolist(), numbers.tolist(), strict=True):
        q, w = queries[q], index[w]
        asking, found = words[q], words[w]
        if backward and found.startswith(asking[: len(asking) // 2]):
            continue  # the forward unit has it
        both = ((q, w),) if len(asking) == len(found) else ((q, w), (w, q))
        for a, b in both:
            for column, value in zip(out, (words[a], counts[a], words[b], counts[b]), strict=True):
                column.append(value)
    return out


def routed(words: DataFrame) -> DataFrame:
    """words: word, n, of at least two code points. unit, backward, level, asks, held, word, n: a row for each unit."""
    own, lesser = F.expr("length(word) div 2"), F.expr("length(word) div 2 - 1")
    places = F.array(
        *[F.struct(F.lit(back).alias("backward"), level.alias("level"), F.lit(level is own).alias("asks")) for back in (False, True) for level in (own, lesser)]
    )
    rows = words.select("word", "n", F.explode(F.filter(places, lambda p: p["asks"] | ((F.expr("length(word) % 2") == 0) & (p["level"] > 0)))).alias("p")).select("word", "n", "p.*")
    half = F.when(F.col("backward"), F.expr("right(word, level)")).otherwise(F.expr("left(word, level)"))
    return rows.select(F.xxhash64("backward", "level", half).alias("unit"), "backward", "level", "asks", F.lit(True).alias("held"), "word", "n")


def near_words(words: DataFrame, work: Workspace, per_unit: int = 40_000, hot: int = 50_000) -> DataFrame:
    """words: word, n (distinct, two code points or more). Both directions of each pair of words at one error:
    word, n, other, other_n. A half of more than `hot` words is dealt out over units that each meet all its queries."""
    spark = work.spark
    rows = work.save(routed(words), "routed")
    frequent = work.save(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("unit", F.ceil(F.col("k") / hot).cast("int").alias("chunks")), "frequent-halves")
    if not frequent.isEmpty():
        spread = rows.join(frequent, "unit", "left")
        many = spread.where("chunks is not null")
        index = many.withColumn("unit", F.expr("xxhash64(unit, pmod(xxhash64(word), chunks))")).withColumn("asks", F.lit(False))
        asking = many.where("asks").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("unit", F.expr("xxhash64(unit, cast(chunk as bigint))")).withColumn("held", F.lit(False)).drop("chunk")
        rows = work.save(spread.where("chunks is null").drop("chunks").unionByName(index.drop("chunks")).unionByName(asking.drop("chunks")), "dealt-halves")
    partitions = partitions_for(spark, rows.count(), per_unit)
    placed = rows.withColumn("part", F.expr(f"pmod(unit, {partitions * 4})")).repartition(partitions, "part").sortWithinPartitions("backward", "level", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held)
                held.clear()
                words, counts, asks, own = (whole.column(c).to_pylist() for c in ("word", "n", "asks", "held"))
                found = near_in_unit(words, counts, asks, own, now[0])
                for a in range(0, len(found[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000], t) for x, t in zip(found, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])

        for batch in batches:
            keys = [(b, v, p) for b, v, p in zip(*(batch.column(c).to_pylist() for c in ("backward", "level", "part")), strict=True)]
            first = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[first]:
                    if keys[first] != now:
                        yield from done()
                        now = keys[first]
                    held.append(batch.slice(first, i - first))
                    first = i
        yield from done()
        release()

    return placed.select("backward", "level", "part", "word", "n", "asks", "held").mapInArrow(run, NEAR_SCHEMA)


def variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = ERROR_EVERY, per_unit: int = 40_000, hot: int = 50_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least `least` code points and `least_count` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with the errors that `spelled` makes.
    form: the near word of largest n (ties: the smallest in code-point order) if that is at least `ratio` times the
    word's n, else null; root: the last of the forms that follow from the word. Null and empty texts have no words;
    a null id is written as nothing; repeated rows count again; very long texts and words are read whole; an empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    if least < 2:
        raise ValueError("words need at least two code points")
    work = Workspace(spark, "spelling")
    words = work.save(word_counts(docs, id_col, text_col, least, every).where(F.col("n") >= least_count), "words")
    pairs = near_words(words, work, per_unit, hot)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("form"))).alias("best"))
    close = F.col("n") * ratio <= -F.col("best.k")
    best = work.save(best.select("word", "n_near", F.when(close, F.col("best.form")).alias("form"), F.when(close, -F.col("best.k")).alias("form_n")), "best")
    step = work.save(best.where("form is not null").select("word", F.col("form").alias("root")), "root-0")
    for k in range(1, 64):  # each form has `ratio` times the count of its word, so few rounds are needed
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = work.save(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"root-{k}")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return words.join(best, "word", "left").join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: One error by places: words of one length that agree without the code point at the same place, or a word that is
#: another one without a code point.
OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents)
), owned AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
), marked AS (SELECT run, k, {crc32_sql("name")} AS h FROM owned),
spelt AS (SELECT CASE WHEN h % {ERROR_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM marked),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), cuts AS (SELECT word, n, spot, left(word, spot) || substr(word, spot + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS spot FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION ALL SELECT DISTINCT a.word, w.word, w.n FROM cuts a JOIN words w ON a.rest = w.word
  UNION ALL SELECT DISTINCT w.word, a.word, a.n FROM cuts a JOIN words w ON a.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * words.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word
), walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.next
)
SELECT formed.word, formed.form, walk.root, formed.n, formed.n_near, formed.form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.next IS NULL
"""

"""Writers. Ordered text goes through one sorted range at a time; wide matrices are made here only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions.sequence import wrap_fasta


def write_fasta(df: DataFrame, path: str, header: str = "accession", sequence: str = "sequence", ordered: bool = True, single: bool = False) -> None:
    """FASTA with lines of 60; ordered by header over all part files. `single` makes one file, for small results."""
    own = df.orderBy(header) if ordered else df
    lines = own.select(wrap_fasta(F.col(header), F.col(sequence)).alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("errorifexists").text(path)


def write_sorted_fasta(df: DataFrame, path: str, accession: str = "accession", header: str | None = None, sequence: str = "sequence", allow_duplicates: bool = False) -> DataFrame:
    """FASTA in byte order of the accession over all part files, and an index of its records.

    The index is accession, part (name of the file), offset and bytes, as a table beside the parts. Order follows from
    accessions alone, not from the order or the partitions of the input. A null or repeated accession is an error that
    names the first one and how many there are; no records at all is one too.
    """
    from evidra.operators.lineage import cut

    spark = df.sparkSession
    own = cut(df.select(F.col(accession).cast("string").alias("accession"), F.coalesce(F.col(header or accession).cast("string"), F.col(accession).cast("string")).alias("header"), F.coalesce(F.col(sequence), F.lit("")).alias("sequence")))
    names = own.groupBy("accession").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or accession is null")
    bad = names.agg(F.count(F.lit(1)), F.min("accession"), F.count_if(F.col("accession").isNull())).first()
    if bad[2] or (bad[0] and not allow_duplicates):
        raise ValueError(f"{bad[0]} accessions are missing or not unique, the first is {bad[1]!r}")
    if own.isEmpty():
        raise ValueError("no records")
    # equal accessions, where allowed, stay in one range and are told apart by their content
    order = ["accession", "header", "sequence"]
    placed = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "accession").sortWithinPartitions(*order)
    lines = placed.select("accession", wrap_fasta(F.col("header"), F.col("sequence")).alias("value"))
    numbered = cut(lines.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    # part files are numbered by the ranges that have rows, so that each range is one file whatever the writer does
    numbered.repartition(F.col("range")).sortWithinPartitions("range", "at").select("range", "value").write.mode("errorifexists").partitionBy("range").text(f"{path}/parts")
    width = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("value") + 1
    index = numbered.select("accession", F.concat(F.lit("range="), F.col("range").cast("string")).alias("part"), F.coalesce(F.sum(size).over(width), F.lit(0)).alias("offset"), size.cast("bigint").alias("bytes"))
    index.write.mode("errorifexists").parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def write_table(df: DataFrame, path: str, order: list[str] | None = None, decimals: dict[str, int] | None = None, single: bool = False) -> None:
    """A TSV with a header; `decimals` prints columns with that many places."""
    own = df.orderBy(*order) if order else df
    for name, places in (decimals or {}).items():
        own = own.withColumn(name, F.format_string(f"%.{places}f", F.col(name)))
    (own.coalesce(1) if single else own).write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


def write_hits(hits: DataFrame, path: str, protein: str = "protein", order: str | None = None) -> None:
    """peptide, protein_id, position as a TSV: by protein (or by the column `order`, its place in a file), position,
    peptide."""
    keys = [F.col(order or protein), F.col("position"), F.col("peptide")]
    hits.orderBy(*keys).select("peptide", F.col(protein).alias("protein_id"), "position").write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


#: Columns of an evidence file and their decimals.
EVIDENCE = {"protein_id": None, "n_peptides": None, "n_unique_peptides": None, "n_samples": None, "mean_score": 4, "max_score": 4, "support_score": 4}


def write_evidence(evidence: DataFrame, path: str) -> None:
    """The seven columns of EVIDENCE, ordered by protein, scores rounded half to even; a missing column is an error."""
    missing = sorted(set(EVIDENCE) - set(evidence.columns))
    if missing:
        raise ValueError(f"missing columns {', '.join(missing)}")
    own = evidence.select(*[F.bround(c, d).alias(c) if d else F.col(c) for c, d in EVIDENCE.items()])
    write_table(own, path, ["protein_id"], {c: d for c, d in EVIDENCE.items() if d})


def write_statistics(df: DataFrame, path: str, settings: dict | None = None) -> None:
    """One row of figures as a JSON object, with the settings that made it; any other number of rows is an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"statistics are one row, not {'none' if not rows else 'several'}")
    record = df.select(*[F.lit(v).alias(k) for k, v in sorted((settings or {}).items())], *df.columns)
    record.coalesce(1).write.mode("errorifexists").json(path)


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).json(path)


def write_matrix(df: DataFrame, path: str, row: str, column: str, value: str, columns: list[str], fill: float | None = None) -> str:
    """A wide matrix with the given columns; the folder's name tells rows and columns. Missing is blank, or `fill`."""
    own = df.groupBy(row).pivot(column, columns).agg(F.sum(value))
    own = own if fill is None else own.na.fill(fill)
    target = f"{path}_{df.select(row).distinct().count()}x{len(columns)}"
    write_table(own, target, [row])
    return target


def write_bundle(tables: dict[str, DataFrame], path: str, settings: dict | None = None) -> None:
    """Parquet tables of a study under one folder, which appears whole or not at all.

    Everything is written to a folder beside it. The record of the tables, with number of rows and a digest blind to
    order as they were read back, is written last; then the folder gets its name. `settings` go into each record as
    text. A folder of that name is an error, before and after the work.
    """
    from evidra.operators.pieces import digest

    spark = next(iter(tables.values())).sparkSession
    hidden = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    files = _files(spark, path)
    if files.exists(_hadoop_path(spark, path)):
        raise FileExistsError(path)
    records = []
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{hidden}/{name}")
        rows, total = digest(spark.read.schema(df.schema).parquet(f"{hidden}/{name}"))
        records.append((name, rows, total, json.dumps(settings or {}, sort_keys=True)))
    spark.createDataFrame(records, BUNDLE).coalesce(1).write.mode("errorifexists").json(f"{hidden}/_bundle")
    if files.exists(_hadoop_path(spark, path)) or not files.rename(_hadoop_path(spark, hidden), _hadoop_path(spark, path)):
        raise FileExistsError(path)


BUNDLE = "name string, rows bigint, digest string, settings string"


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def hash_table(df: DataFrame, accession: str = "accession", sequence: str = "sequence") -> DataFrame:
    from evidra.functions.sequence import normalize_sequence

    made = normalize_sequence(sequence)
    return df.select(F.sha2(made, 256).alias("sha256"), accession, F.length(made).alias("length"))

"""Names of proteins and groups: descriptions from several headers, written headers, classes from a host list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("gene", "protein_name", "organism", "source")


def described(headers: DataFrame, accession: str = "accession", header: str = "header", place: str = "place") -> DataFrame:
    """headers: accession, header, place, gene, protein_name, organism, source. One row for each accession.

    Distinct values of a field in order of their first place, joined by `; `. A gene that repeats the accession, a
    source `unknown`, empty and null values say nothing. n_source_headers counts distinct headers.

    Equal values meet in the first aggregation, so that the second holds distinct ones only.
    """
    says = {c: F.col(c) for c in FIELDS}
    says["gene"] = F.when(F.col("gene") != F.col(accession), F.col("gene"))
    says["source"] = F.when(F.col("source") != "unknown", F.col("source"))
    said = F.array(*[F.struct(F.lit(c).alias("field"), v.cast("string").alias("value")) for c, v in says.items()], F.struct(F.lit("header").alias("field"), F.col(header).alias("value")))
    parts = headers.select(accession, F.col(place).alias("at"), F.explode(said).alias("p")).where("p.field = 'header' OR p.value <> ''")
    once = parts.groupBy(accession, "p").agg(F.min("at").alias("at"))
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p.field") == c, F.struct("at", "p.value")))), lambda x: x["value"]), "; ").alias(c) for c in FIELDS]
    return once.groupBy(accession).agg(*joined, F.count_if(F.col("p.field") == "header").alias("n_source_headers"))


def written_header(label: str | None = None) -> Column:
    """Header of a merged record (tag, accession, entry_name, description, organism, primary_organism, tax_ids,
    primary_tax, gene, evidence, version, sources), empty parts left out.

    The primary record's organism and taxon go first; else the merged ones, unless the organism is `ambiguous`.
    With a label, `[label:sources=...;tax=...]` follows, sources sorted, `-` for no taxa.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    marked = lambda mark, value: F.concat(F.lit(mark), value.cast("string"))
    head = F.concat_ws("|", F.lower("tag"), "accession", some("entry_name"))
    organism = F.coalesce(some("primary_organism"), F.when(F.col("organism") != "ambiguous", some("organism")))
    parts = [head, some("description"), marked("OS=", organism), marked("OX=", F.coalesce("primary_tax", F.get("tax_ids", F.lit(0)))), marked("GN=", some("gene")), marked("PE=", F.col("evidence")), marked("SV=", F.col("version"))]
    if label:
        taxa = F.array_join(F.col("tax_ids").cast("array<string>"), ",")
        sources = F.array_join(F.array_sort(F.array_distinct("sources")), ",")
        parts.append(F.concat(F.lit(f"[{label}:sources="), sources, F.lit(";tax="), F.coalesce(F.nullif(taxa, F.lit("")), F.lit("-")), F.lit("]")))
    return F.concat_ws(" ", *parts)


def classify_with_hosts(groups: DataFrame, hosts: DataFrame, key: str = "protein_group") -> DataFrame:
    """Adds class to groups of members joined by `;`. hosts: accession, class (null or empty: Human), all hosts there are.

    A member of class Mixed makes its group Mixed, as do a host and a member that isn't listed; hosts alone are Human,
    none Microbial. Distinct groups are split once; of two rows of an accession the one of the greater class counts.
    """
    listed = hosts.groupBy(F.col("accession").alias("member")).agg(F.max(F.coalesce(F.nullif("class", F.lit("")), F.lit("Human"))).alias("kind"))
    members = groups.select(key).distinct().select(key, F.explode(F.split(key, ";")).alias("member")).join(listed, "member", "left")
    found = members.groupBy(key).agg(F.bool_or(F.coalesce(F.col("kind") == "Mixed", F.lit(False))).alias("m"), F.bool_or(F.col("kind").isNotNull()).alias("h"), F.bool_or(F.col("kind").isNull()).alias("o"))
    kind = F.when(F.col("m") | (F.col("h") & F.col("o")), "Mixed").when(F.col("h"), "Human").otherwise("Microbial")
    return groups.join(found.select(key, kind.alias("class")), key, "left")


def level_file_name(level: Column | str) -> Column:
    """A level as part of a file name: what is no letter, digit or underscore becomes an underscore."""
    return F.regexp_replace(level, r"[^\p{IsAlphabetic}\p{N}_]", "_")


def base_name(path: Column | str) -> Column:
    """The last part of a path, whichever slash it has."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)

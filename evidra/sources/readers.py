"""Readers with fixed schemas, checked by column name. All return DataFrames; files are listed by Spark only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import sequence as S

#: Columns of prediction tables: those that tell a dialect, its sequence and its score.
DIALECTS = {
    "detokenized": ("peptide_prediction_detokenized_unmodified", "score"),
    "vector": ("pred_seq", "pred_prob"),
    "generic": ("sequence", "score"),
}
LFQ_FIXED = {"peptide", "charge", "proteins", "q_value", "score", "spectral_angle"}


def require_columns(df: DataFrame, columns: list[str], where: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{where}: missing columns {', '.join(missing)}")
    return df


def table(spark: SparkSession, path: str, columns: list[str], separator: str = "\t") -> DataFrame:
    """A text table with a header, all columns as text; ragged rows are an error."""
    df = spark.read.option("header", True).option("sep", separator).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return require_columns(df, columns, path)


def fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """header, accession, sequence of FASTA records (gzip too); records without a sequence are left out.

    Records are split by Spark's line reader at `\\n>`, so one large file is read by many tasks. Strict: an empty
    header, an empty sequence or two records of one accession are errors.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    record = F.regexp_replace(F.col("value"), "^>", "")
    head = F.trim(F.regexp_extract(record, r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"[\r\n]", "")
    df = raw.select(head.alias("header"), F.regexp_extract(head, r"^(\S+)", 1).alias("accession"), body.alias("sequence"))
    if not strict:
        return df.where("sequence <> ''")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("header"))).cast("string")
    checked = df.withColumn("sequence", F.when(F.col("accession") == "", fail("empty header ")).when(F.col("sequence") == "", fail("empty sequence ")).otherwise(F.col("sequence")))
    counted = checked.groupBy("accession").agg(F.count(F.lit(1)).alias("n"), F.first("header").alias("header"), F.first("sequence").alias("sequence"))
    return counted.withColumn("sequence", F.when(F.col("n") > 1, fail("two records of ")).otherwise(F.col("sequence"))).select("header", "accession", "sequence")


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vector_prediction(sequence: Column, probabilities: Column) -> Column:
    """Peptide and mean probability of a vector of residue probabilities; null if they do not fit.

    Comma lists, with or without brackets, and space lists; the latter may begin with one 0 for the path.
    """
    text = F.trim(F.regexp_replace(probabilities, r"[\[\]]", ""))
    residues = F.filter(F.split(sequence, r"[\s,]*"), lambda x: x != "")

    def parts(text: Column) -> Column:
        commas = F.contains(text, F.lit(","))
        return F.struct(commas.alias("commas"), F.transform(F.when(commas, F.split(text, r"\s*,\s*")).otherwise(F.split(text, r"\s+")), lambda x: x.try_cast("double")).alias("values"), residues.alias("residues"))

    def marked(p: Column) -> Column:
        n, values = F.size(p["residues"]), p["values"]
        marker = ~p["commas"] & (F.size(values) == n + 1) & (F.element_at(values, 1) == 0)
        return F.struct(p["residues"].alias("residues"), n.alias("n"), F.when(marker, F.slice(values, F.lit(2), n)).otherwise(values).alias("own"))

    def judged(p: Column) -> Column:
        fits = (p["n"] > 0) & (F.size(p["own"]) == p["n"]) & F.forall(p["own"], lambda v: F.coalesce(v.between(0, 1), F.lit(False)))
        mean = F.aggregate(p["own"], F.lit(0.0), lambda a, v: a + v) / p["n"]
        return F.when(fits, F.struct(F.array_join(p["residues"], "").alias("peptide"), mean.alias("score")))

    return _once(_once(_once(text, parts), marked), judged)


def predictions(spark: SparkSession, path: str, low: int = 7, high: int = 30, folder: str | None = None) -> DataFrame:
    """sample, peptide, score of prediction tables below a path; the dialect is told by the header.

    The sample is the file's name, or with `folder`, what that pattern's first group finds in the file's path.
    Only upper-case letters count; eligible are finite scores above 0, lengths from `low` to `high`, no low complexity.
    """
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    for name, (seq, score) in DIALECTS.items():
        if {seq, score} <= set(df.columns):
            break
    else:
        raise ValueError(f"{path}: no known prediction columns among {', '.join(df.columns)}")
    file = F.col("_metadata.file_path")
    sample = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.csv$", "") if folder is None else F.regexp_extract(file, folder, 1)
    if name == "vector":
        parsed = df.select(sample.alias("sample"), vector_prediction(F.col(seq), F.col(score)).alias("p"))
    else:
        parsed = df.select(sample.alias("sample"), F.struct(F.col(seq).alias("peptide"), F.col(score).try_cast("double").alias("score")).alias("p"))
    own = F.transform(F.filter(F.array("p"), lambda p: p.isNotNull()), lambda p: F.struct(F.regexp_replace(p["peptide"], "[^A-Z]", "").alias("peptide"), p["score"].alias("score")))
    parsed = parsed.select("sample", F.inline(own))  # what is filtered by is made once, not once for each condition
    finite = (F.col("score") > 0) & (F.col("score") < float("inf")) & ~F.isnan("score")
    return parsed.where(finite & F.length("peptide").between(low, high) & ~S.is_low_complexity("peptide"))


def peptides_text(spark: SparkSession, path: str) -> DataFrame:
    """One peptide in each line, score 1; complexity is not looked at."""
    return spark.read.text(path).select(F.regexp_replace("value", "[^A-Z]", "").alias("peptide"), F.lit(1.0).alias("score")).where("peptide <> ''")


def psms(spark: SparkSession, path: str) -> DataFrame:
    """First-rank target matches of a search result: peptide, proteins (array), peptide_q and what else there is."""
    df = table(spark, path, ["peptide", "proteins", "label", "rank", "peptide_q"])
    own = df.where((F.col("rank").try_cast("int") == 1) & (F.col("label").try_cast("int") == 1))
    return own.withColumns({"proteins": S.member_set("proteins"), "peptide_q": S.q_value("peptide_q"), "canonical": S.canonical_peptide("peptide")})


def lfq(spark: SparkSession, path: str) -> DataFrame:
    """peptide, charge, proteins (array), q_value, intensity; the intensity is the one column with a name of its own."""
    df = table(spark, path, ["peptide", "charge", "proteins", "q_value"])
    own = [c for c in df.columns if c not in LFQ_FIXED]
    if len(own) != 1:
        raise ValueError(f"{path}: one intensity column expected, found {', '.join(own) or 'none'}")
    charge = F.when(F.col("charge").rlike(r"^(0*[1-9]\d*|-1)$"), F.col("charge").cast("int")).otherwise(F.raise_error(F.concat(F.lit("charge "), "charge")).cast("int"))
    value = F.col(f"`{own[0]}`").try_cast("double")
    return df.select("peptide", charge.alias("charge"), S.member_set("proteins").alias("proteins"), S.q_value("q_value").alias("q_value"), S.intensity(value).alias("intensity"))


def report(spark: SparkSession, path: str, q: float = 0.01) -> DataFrame:
    """Precursors of a data-independent report at or under q."""
    columns = {"Q.Value": "q", "Stripped.Sequence": "peptide", "Genes": "genes", "Protein.Group": "protein_group", "Precursor.Quantity": "quantity"}
    df = table(spark, path, list(columns))
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    return own.withColumns({"q": S.q_value("q"), "quantity": F.col("quantity").try_cast("double")}).where(F.col("q") <= q)


def abundances(spark: SparkSession, path: str, gene: str = "gene_id") -> DataFrame:
    """Gene abundances by the rules of `tpm`; two rows of one gene are an error."""
    df = table(spark, path, [gene])
    values = [c for c in df.columns if c != gene]
    own = df.select(F.col(gene).alias("gene"), *[S.tpm(c).alias(c) for c in values])
    merged = own.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in values])
    return merged.withColumn("gene", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two rows of "), "gene")).cast("string")).otherwise(F.col("gene"))).drop("n")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation table whose header is the comment line that begins with #query; that line is a small read."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("#query"))).first()
    if head is None:
        raise ValueError(f"{path}: no #query header")
    names = head[0].lstrip("#").split("\t")
    fields = F.split("value", "\t")
    own = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return own.select(*[F.try_element_at(fields, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def functional_levels(df: DataFrame, accession: str, levels: list[str]) -> DataFrame:
    """accession, level, value in long form; levels without a column are left out."""
    known = [c for c in levels if c in df.columns]
    long = df.select(F.col(accession).alias("accession"), F.explode(F.create_map(*[x for c in known for x in (F.lit(c), F.col(c))])).alias("level", "raw")) if known else df.sparkSession.createDataFrame([], "accession string, level string, raw string")
    return long.select("accession", "level", F.explode(S.functional_values("raw")).alias("value"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    schema = "seq_hash string, length bigint, accession string, gene string, description string, organism string, tax_ids array<int>, sources array<struct<tag: string, accession: string, description: string>>, conflicts map<string, array<string>>"
    return spark.read.schema(schema).json(path)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """seq_hash, tag, header: the joined headers of a lake, one row each."""
    df = table(spark, path, ["sha256_hash", "all_source_headers"])
    return df.select(F.col("sha256_hash").alias("seq_hash"), F.explode(F.split("all_source_headers", r"\|\|\|")).alias("h")).select("seq_hash", F.substring_index("h", " ", 1).alias("tag"), F.regexp_replace("h", r"^\S+\s*", "").alias("header"))


def substitution_matrix(spark: SparkSession, path: str) -> DataFrame:
    """residue, target, score of a text matrix: a header of residues, a row for each residue, `#` comments; pairs of
    equal residues are left out. The header is a small read; a row of another length is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit("#")))
    # the header holds no number, rows do
    head = lines.where(~F.col("v").rlike("[0-9]")).first()
    if head is None:
        raise ValueError(f"{path}: no header of residues")
    names = head.v.split()
    fields = F.split("v", r"\s+")
    fits = F.when(F.size(fields) == len(names) + 1, fields).otherwise(F.raise_error(F.concat(F.lit("a row does not fit the header: "), "v")).cast("array<string>"))
    rows = lines.where(F.col("v").rlike("[0-9]")).select(fits.alias("f"))
    each = rows.select(F.element_at("f", 1).alias("residue"), F.posexplode(F.slice("f", 2, len(names))).alias("k", "score"))
    target = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
    return each.select("residue", target.alias("target"), F.col("score").cast("int").alias("score")).where("residue <> target")


#: Ranks of a lineage from the root on.
RANKS = (
    "domain", "realm", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass", "class", "subclass", "infraclass", "superorder", "order",
    "suborder", "infraorder", "parvorder", "superfamily", "family", "subfamily", "tribe", "subtribe", "genus", "subgenus", "species_group", "species_subgroup",
    "species", "subspecies", "strain", "varietas", "forma",
)


def lineage_answers(spark: SparkSession, path: str, peptides: DataFrame, form: str = "json") -> DataFrame:
    """peptide, status, taxon_id, lineage (array of struct id, name, rank) of a lowest-common-ancestor lookup.

    form: json (a list in each file), lines (an object in each line) or csv. peptides: peptide, those asked for, with
    I as L; those without an answer get the status not_returned. The other statuses are assigned, lookup_cutoff,
    cutoff_not_reported and unresolved (no taxon, or the root). Errors, each naming a peptide: one that wasn't asked
    for or is answered twice, ids that are no whole numbers above 0, ids without names, a rank below that of the
    ancestor or anything behind it, an ancestor that differs from the lineage at its rank, other flags than true and
    false. An ancestor at a rank that has no column of its own ends the lineage.
    """
    if form == "csv":
        raw = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    else:
        raw = spark.read.option("multiLine", form == "json").option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
    require_columns(raw, ["peptide", "taxon_id", "taxon_name", "taxon_rank", "genus_id", "species_id", "phylum_id"], path)
    text = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    none = lambda c: c.isNull() | c.isin("", "0")
    entries = []
    for k, rank in enumerate(RANKS):
        key = "superkingdom" if rank == "domain" and "domain_id" not in raw.columns else rank
        taxon, name = text(f"{key}_id"), text(f"{key}_name")
        entries.append(F.when(~none(taxon), F.struct(taxon.alias("id"), name.alias("name"), F.lit(rank).alias("rank"), F.lit(k).alias("k"))))
    place = F.create_map(*[F.lit(x) for k, rank in enumerate(RANKS) for x in (rank, k)])
    lca_rank = F.when(text("taxon_rank") == "superkingdom", "domain").otherwise(text("taxon_rank"))
    cutoff = F.lower(text("cutoff_used"))
    letters = text("peptide")
    made = raw.select(
        F.when(letters.rlike(f"^[{''.join(S.RESIDUE_MASS)}]+$"), F.translate(letters, "I", "L")).alias("peptide"), letters.alias("given"),
        F.when(~none(text("taxon_id")), text("taxon_id")).alias("lca"), lca_rank.alias("lca_rank"), text("taxon_name").alias("lca_name"), cutoff.alias("cutoff"),
        F.filter(F.array(*entries), lambda e: e.isNotNull()).alias("e"),
    )
    limit = F.try_element_at(place, F.col("lca_rank"))
    at = F.array_position(F.transform("e", lambda e: e["id"]), F.coalesce("lca", F.lit("")))
    whole = lambda c: c.rlike(r"^[1-9][0-9]{0,17}$")
    problem = (
        F.when(F.col("peptide").isNull(), "not a plain peptide")
        .when(~F.coalesce(F.col("cutoff").isin("true", "1", "false", "0", ""), F.lit(True)), "unknown flag")
        .when(~F.coalesce(whole(F.col("lca")), F.lit(True)) | F.exists("e", lambda e: ~whole(e["id"])), "an id is no whole number above 0")
        .when(F.exists("e", lambda e: F.coalesce(e["name"], F.lit("")) == ""), "an id has no name")
        .when(((at > 0) & (at < F.size("e"))) | F.exists("e", lambda e: F.coalesce(e["k"] > limit, F.lit(False))), "descendants below the ancestor")
        .when(F.exists("e", lambda e: (e["rank"] == F.coalesce("lca_rank", F.lit(""))) & (e["id"] != F.coalesce("lca", F.lit("")))), "the ancestor differs from the lineage")
        .when(F.col("lca").isNotNull() & (F.col("lca") != "1") & (at == 0) & ((F.coalesce("lca_name", F.lit("")) == "") | (F.coalesce("lca_rank", F.lit("")) == "")), "the ancestor has no name or rank")
    )
    node = lambda i, n, r: F.struct(i.try_cast("bigint").alias("id"), n.alias("name"), r.alias("rank"))
    shown = F.transform("e", lambda e: node(e["id"], e["name"], e["rank"]))
    own_end = F.col("lca").isNotNull() & (F.col("lca") != "1") & (at == 0)
    lineage = F.when(own_end, F.concat(shown, F.array(node(F.col("lca"), F.col("lca_name"), F.col("lca_rank"))))).otherwise(shown)
    flag = F.when(F.col("cutoff").isNull(), "cutoff_not_reported").when(F.col("cutoff").isin("true", "1"), "lookup_cutoff").otherwise("assigned")
    status = F.when((flag == "assigned") & (F.col("lca").isNull() | (F.col("lca") == "1")), "unresolved").otherwise(flag)
    answers = made.select("peptide", "given", problem.alias("problem"), status.alias("status"), F.col("lca").try_cast("bigint").alias("taxon_id"), lineage.alias("lineage"))
    asked = peptides.select("peptide").distinct().withColumn("asked", F.lit(True))
    one = answers.groupBy(F.coalesce("peptide", "given").alias("peptide")).agg(F.count(F.lit(1)).alias("n"), F.max("problem").alias("problem"), F.first(F.struct("status", "taxon_id", "lineage")).alias("a"))
    joined = one.join(asked, "peptide", "full")
    problem = F.coalesce("problem", F.when(F.col("n") > 1, "answered twice").when(F.col("asked").isNull(), "not asked for"))
    kind = one.schema["a"].dataType
    found = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.coalesce("peptide", F.lit("null")))).cast(kind)).otherwise(F.col("a"))
    empty = F.array().cast(kind["lineage"].dataType)
    return joined.withColumn("a", found).select("peptide", F.coalesce("a.status", F.lit("not_returned")).alias("status"), "a.taxon_id", F.coalesce("a.lineage", empty).alias("lineage"))


def bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a bundle by name; one that is missing or differs from its record is an error."""
    from evidra.operators.pieces import digest
    from evidra.sources.sinks import BUNDLE

    found = {}
    for r in spark.read.schema(BUNDLE).json(f"{path}/_bundle").collect():  # one for each table
        found[r.name] = spark.read.parquet(f"{path}/{r.name}")
        if digest(found[r.name]) != (r.rows, r.digest):
            raise ValueError(f"{path}: {r.name} differs from its record")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Acquisitions: unique ids of letters, digits, dot, dash and underscore."""
    df = table(spark, path, ["sample", "predictions"])
    rows = df.select("sample").collect()  # a manifest is written by hand
    seen: set[str] = set()
    for row in rows:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", row.sample or "") or row.sample in seen:
            raise ValueError(f"{path}: sample {row.sample!r} is not a new, plain name")
        seen.add(row.sample)
    return df


def source_spec(text: str) -> tuple[str, int, str]:
    """TAG:PRIORITY:PATH[:GLOB] as tag, priority and a path that Spark reads."""
    parts = text.split(":", 2)
    if len(parts) < 3 or not parts[1].isdigit() or not parts[0]:
        raise ValueError(f"not TAG:PRIORITY:PATH: {text}")
    path, _, glob = parts[2].partition(":") if "://" not in parts[2] else (parts[2], "", "")
    return parts[0], int(parts[1]), f"{path}/{glob}" if glob else path

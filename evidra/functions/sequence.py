"""Column expressions on sequences, identifiers and headers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Monoisotopic residue masses, in natural order.
RESIDUE_MASS = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891,
    "I": 113.08406, "K": 128.09496, "L": 113.08406, "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858,
    "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER, PROTON = 18.01056, 1.00728


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """`body` of a value that is written and computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_il(s: Column | str) -> Column:
    """Folds I to L."""
    return F.translate(_c(s), "I", "L")


def clean_sequence(s: Column | str) -> Column:
    """Upper case without stop signs."""
    return F.replace(F.upper(_c(s)), F.lit("*"), F.lit(""))


def normalize_sequence(s: Column | str) -> Column:
    """ASCII letters only, upper case; no folding."""
    return F.upper(F.regexp_replace(_c(s), "[^A-Za-z]", ""))


def sequence_hash(s: Column | str) -> Column:
    return F.sha2(normalize_sequence(s), 256)


def canonical_peptide(s: Column | str) -> Column:
    """Without bracketed modifications and dashes, I folded to L."""
    return F.translate(F.regexp_replace(F.regexp_replace(_c(s), r"\[[^\]]*\]", ""), "-", ""), "I", "L")


def strict_peptide(s: Column | str) -> Column:
    """Canonical and upper case; an error unless only A-Z is left."""
    made = F.upper(canonical_peptide(s))
    return F.when(made.rlike("^[A-Z]+$"), made).otherwise(F.raise_error(F.concat(F.lit("not a peptide: "), _c(s))))


def strip_modifications(s: Column | str) -> Column:
    return F.regexp_replace(F.upper(_c(s)), "[^A-Z]", "")


def clean_annotated(s: Column | str) -> Column:
    """Drops bracketed parts and underscores, keeps upper case."""
    return F.regexp_replace(F.regexp_replace(F.replace(_c(s), F.lit("_"), F.lit("")), r"\[.*?\]", ""), "[^A-Z]", "")


def strip_source_tags(s: Column | str, strict: bool = True) -> Column:
    """Drops two leading tags. Strict: three parts at least, both tags of `[A-Z0-9_]+`; else only the first is checked."""
    return F.regexp_replace(_c(s), r"^[A-Z0-9_]+\|[A-Z0-9_]+\|" if strict else r"^[A-Z0-9_]*\|[^|]*\|", "")


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def max_residue_count(s: Column | str, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    s = _c(s)
    return F.greatest(*[F.length(s) - F.length(F.replace(s, F.lit(a), F.lit(""))) for a in alphabet])


def is_low_complexity(s: Column | str) -> Column:
    """One residue over 60 %; or 12 and longer with two residues at most; or 10 and longer and a repeated pair."""
    s = _c(s)
    n = F.length(s)
    one = max_residue_count(s) > 0.6 * n
    two = (n >= 12) & (F.size(F.array_distinct(characters(s))) <= 2)
    pair = F.substring(s, 1, 2)
    periodic = (n >= 10) & (F.substring(F.repeat(pair, 64), F.lit(1), n) == s)
    return one | two | periodic


def is_valid_peptide(s: Column | str) -> Column:
    s = _c(s)
    n = F.length(s)
    return n.between(8, 50) & s.rlike(f"^[{RESIDUES}]+$") & (max_residue_count(s, RESIDUES) <= 0.5 * n)


def normalise_residues(s: Column | str) -> Column:
    """The residues, and how many were replaced: a trailing stop goes; B, J, Z and inner stops become X."""
    bare = F.regexp_replace(F.upper(_c(s)), r"\*+$", "")
    made = F.translate(bare, "BJZ*", "XXXX")
    return F.struct(made.alias("sequence"), (F.length(bare) - F.length(F.regexp_replace(bare, r"[BJZ*]", ""))).alias("replaced"))


def noncanonical_fraction(s: Column | str) -> Column:
    s = _c(s)
    return F.try_divide(F.length(F.regexp_replace(s, "[ACDEFGHIKLMNPQRSTVWYUO]", "")), F.length(s))


def has_poly_run(s: Column | str, n: int) -> Column:
    return F.lit(False) if n < 2 else F.coalesce(_c(s).rlike(rf"(.)\1{{{n - 1},}}"), F.lit(False))


def sequence_entropy(s: Column | str) -> Column:
    """Shannon entropy of the letters, by the entropy of 20 equal ones; less than two letters have 0."""
    s = _c(s)
    n = F.length(s)
    letters = F.array_sort(F.array_distinct(characters(s)))
    shares = F.transform(letters, lambda x: (n - F.length(F.replace(s, x, F.lit("")))) / n)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, x: acc - x * F.log2(x))
    return F.when(n < 2, 0.0).otherwise(total / F.log2(F.lit(20.0)))


def is_fragment(s: Column | str, least: int) -> Column:
    s = _c(s)
    return (F.length(s) == 0) | (~s.startswith("M") & (F.length(s) < least))


def member_set(s: Column | str, separator: str = ";") -> Column:
    """Distinct trimmed members, sorted by bytes."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(_c(s), separator), lambda x: F.trim(x)), lambda x: x != "")))


def member_set_key(s: Column | str, separator: str = ";") -> Column:
    return F.array_join(member_set(s, separator), ";")


def representative(s: Column | str, separator: str = ";") -> Column:
    return F.array_min(member_set(s, separator))


def classify_group(members: Column, is_host) -> Column:
    """Human, Microbial, Mixed or Unknown, by a predicate on members."""
    host, other = F.exists(members, is_host), F.exists(members, lambda x: ~is_host(x))
    return F.when(F.size(members) < 1, "Unknown").when(host & other, "Mixed").when(host, "Human").otherwise("Microbial")


#: Signs for nothing in annotation tables.
MISSING_TERMS = ("", "-", "--", "NA", "None", "null", "NULL")


def functional_values(s: Column | str) -> Column:
    """Parts between `;` and `,`, trimmed, without the signs for nothing; repeated parts stay."""
    parts = F.transform(F.split(_c(s), "[;,]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: ~x.isin(*MISSING_TERMS))


def function_terms(s: Column | str, field: str) -> Column:
    """Validated terms of an annotation field: KO, EC, GO; COG letters count one by one."""
    if field == "COG":
        return F.array_distinct(F.filter(F.split(_c(s), ""), lambda x: x.rlike("^[A-Z]$")))
    parts = F.array_distinct(F.transform(functional_values(s), lambda x: F.regexp_replace(x, "^ko:", "")))
    rule = {"KO": r"^K\d{5}$", "EC": r"^\d+(\.(\d+|-)){1,3}$", "GO": r"^GO:\d{7}$"}.get(field)
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(rule))) if rule else parts


def fnv1a64(s: Column | str) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as DECIMAL(20, 0); arithmetic in two halves, as 64 bits would overflow."""
    octets = F.transform(characters(F.decode(F.encode(_c(s), "UTF-8"), "ISO-8859-1")), lambda x: F.ascii(x).cast("bigint"))
    octets = F.coalesce(octets, F.array().cast("array<bigint>"))
    low = F.lit(0xFFFFFFFF).cast("bigint")

    def step(h: Column, b: Column) -> Column:
        # the prime is 2**40 + 435: the lower half goes times 435 to its place and times 2**8 to the upper half
        mixed = h["lo"].bitwiseXOR(b)
        product = mixed * 435
        upper = h["hi"] * 435 + F.shiftright(product, 32) + mixed * 256
        return F.struct(upper.bitwiseAND(low).alias("hi"), product.bitwiseAND(low).alias("lo"))

    start = 14695981039346656037
    first = F.struct(F.lit(start >> 32).cast("bigint").alias("hi"), F.lit(start & 0xFFFFFFFF).cast("bigint").alias("lo"))
    whole = lambda h: (h["hi"].cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h["lo"].cast("decimal(10,0)")).cast("decimal(20,0)")
    return F.aggregate(octets, first, step, whole)


def tryptic(s: Column | str) -> Column:
    """Pieces after K or R, not before P, without missed cleavages and without unclean ones."""
    return F.filter(F.split(_c(s), "(?<=[KR])(?!P)"), lambda x: x.rlike(f"^[{RESIDUES}]+$"))


def digest_folded(s: Column | str, low: int = 7, high: int = 40) -> Column:
    """Pieces after each K or R with one missed cleavage at most, I for L, of `low` to `high` residues, distinct."""
    cut = F.filter(F.split(F.translate(_c(s), "L", "I"), "(?<=[KR])"), lambda x: x != "")
    pair = lambda a, b: F.concat(a, b)  # noqa: E731 - null behind the last piece
    joined = lambda parts: F.filter(F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), pair), lambda x: x.isNotNull())
    fits = lambda x: F.length(x).between(low, high)
    return _let(cut, lambda parts: F.array_distinct(F.filter(F.concat(parts, joined(parts)), fits)))


def residue_mass(s: Column | str) -> Column:
    """Mass of the residues; null if one is unknown."""
    masses = F.create_map(*[F.lit(x) for pair in RESIDUE_MASS.items() for x in pair])
    return F.aggregate(characters(_c(s)), F.lit(0.0), lambda acc, x: acc + F.try_element_at(masses, x))


def theoretical_mass(s: Column | str) -> Column:
    return residue_mass(s) + WATER


def mass_bin(mass: Column | str, width: float = 0.001) -> Column:
    return F.round(_c(mass) / width).cast("bigint")


def windows(s: Column | str, n: int) -> Column:
    """Consecutive pieces of n characters that cover the string, in one pass over it."""
    return F.coalesce(F.regexp_extract_all(_c(s), F.lit(f"(?s).{{1,{n}}}"), 0), F.array().cast("array<string>"))


def q_value(q: Column | str) -> Column:
    """A q-value; what cannot be read, is NaN or outside 0 to 1 is infinite."""
    value = F.expr(f"try_cast({q} AS DOUBLE)") if isinstance(q, str) else q
    return F.when(value.between(0, 1) & ~F.isnan(value), value).otherwise(float("inf"))


def intensity(x: Column | str) -> Column:
    """An intensity; what cannot be read, is not finite or negative is 0."""
    value = F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x
    return F.when((value > 0) & (value < float("inf")) & ~F.isnan(value), value).otherwise(0.0)


def tpm(x: str, nan_is_missing: bool = False) -> Column:
    """An abundance: null for signs of missing, an error for negative or infinite ones."""
    text, value = F.lower(F.trim(F.col(x))), F.expr(f"try_cast({x} AS DOUBLE)")
    missing = text.isin("", "na", "n/a", "null", "none", *(["nan"] if nan_is_missing else [])) | F.col(x).isNull()
    wrong = value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    return F.when(missing, F.lit(None)).when(wrong, F.raise_error(F.concat(F.lit("not an abundance: "), F.col(x))).cast("double")).otherwise(value)


def wrap_fasta(header: Column, sequence: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))


def header_fields(h: Column | str) -> Column:
    """accession, gene, description, organism, source of a sequence header, by one ladder of patterns."""
    h = _c(h)
    get = lambda pattern, k=1: F.nullif(F.regexp_extract(h, pattern, k), F.lit(""))
    first = F.regexp_extract(h, r"^(\S+)", 1)
    rest = F.regexp_extract(h, r"^\S+\s+(.*)$", 1)
    entry = h.rlike(r"^(sp|tr)\|[^|]+\|\S+")
    ensembl = h.rlike(r"^ENS\w*P\d+")
    genome = h.rlike(r"^MGYG\d+_\d+")
    gmgc = h.rlike(r"^GMGC\w*\.")
    small = h.rlike(r"(?i)^smorf|^GMSC")
    refseq = h.rlike(r"^[NXYW]P_\d+")
    prodigal = rest.rlike(r"^# \d+ # \d+ # -?1 #")
    digest = h.rlike(r"^[0-9a-f]{32}\b")
    source = (
        F.when(entry & h.startswith("sp|"), "reviewed").when(entry, "unreviewed").when(ensembl, "ensembl").when(genome, "genome").when(gmgc, "catalogue")
        .when(small, "small_orf").when(refseq, "reference").when(prodigal, "gene_caller").when(digest, "digest").otherwise("other")
    )
    return F.struct(
        F.when(entry, get(r"^\w\w\|([^|]+)\|")).otherwise(first).alias("accession"),
        F.when(entry, get(r"\bGN=(\S+)")).when(ensembl, get(r"gene_symbol:(\S+)")).otherwise(get(r"\bgene=(\S+)")).alias("gene"),
        F.when(entry, F.trim(F.regexp_extract(h, r"^\S+\s+(.*?)(?=\s+OS=|$)", 1))).when(prodigal, None).otherwise(F.nullif(F.trim(F.regexp_replace(rest, r"\s*\[[^\]]*\]\s*$", "")), F.lit(""))).alias("description"),
        F.when(entry, get(r"OS=(.*?)(?=\s+OX=|\s+GN=|\s+PE=|$)")).otherwise(get(r"\[([^\]]+)\]\s*$")).alias("organism"),
        source.alias("source"),
    )


def engine_header(accession: Column, gene: Column, description: Column, style: str = "append") -> Column:
    """A header for a search engine: `append` adds GN=, `gene_first` puts the gene before the description."""
    if style == "gene_first":
        return F.concat_ws(" ", accession, gene, description)
    return F.concat_ws(" ", accession, description, F.concat(F.lit("GN="), gene))


def catalogue(identifier: Column | str, fallback: str = "smORF") -> Column:
    """The source catalogue of an identifier by its prefix."""
    x = _c(identifier)
    return (
        F.when(x.rlike(r"^(sp|tr)\|"), "Human").when(x.startswith("MGYG"), "UHGG").when(x.startswith("GMGC"), "GMGC")
        .when(x.startswith("MuPr_Assembly_"), "Assembly").otherwise(fallback)
    )


def species_of(identifier: Column | str) -> Column:
    x = strip_source_tags(identifier)
    entry = F.regexp_extract(x, r"^(?:sp|tr)\|[^|]+\|\w+_(\w+)", 1)
    genome = F.regexp_extract(x, r"^(MGYG\d+)", 1)
    return F.coalesce(F.nullif(entry, F.lit("")), F.nullif(genome, F.lit("")))


def is_gene_symbol(s: Column | str) -> Column:
    """A gene's symbol: not empty, 20 characters at most, no `|`, neither an accession nor an Ensembl identifier."""
    s = _c(s)
    wrong = s.contains("|") | (F.length(s) > 20) | s.rlike(r"^[A-Z][0-9][A-Z0-9]{3,}$") | s.rlike("^ENS[PTG]")
    return F.coalesce((s != "") & ~wrong, F.lit(False))


def is_accession_gene(s: Column | str) -> Column:
    """A gene name that is a protein accession."""
    return F.coalesce(_c(s).rlike(r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"), F.lit(False))


def gene_tag(h: Column | str) -> Column:
    """The first GN= of a header."""
    return F.nullif(F.regexp_extract(_c(h), r"\bGN=(\S+)", 1), F.lit(""))


def with_gene(h: Column | str, gene: Column) -> Column:
    """The header with its first GN= replaced, or one appended; unchanged where `gene` is null."""
    h = _c(h)
    at = F.regexp_instr(h, F.lit(r"\bGN=\S+"))
    rest = F.regexp_replace(F.substring(h, at, F.length(h)), r"^GN=\S+", "")
    return F.when(gene.isNull(), h).when(at > 0, F.concat(F.substring(h, F.lit(1), at - 1), F.lit("GN="), gene, rest)).otherwise(F.concat(h, F.lit(" GN="), gene))


def protein_name(h: Column | str) -> Column:
    """What stands between the first word of a header and its first KEY= tag, without qualifiers of fragments and isoforms, in lower case."""
    rest = F.regexp_replace(F.regexp_extract(_c(h), r"(?s)^\s*\S+\s+(.*)$", 1), r"(?s)\s+[A-Z][A-Za-z]*=.*$", "")
    return F.nullif(F.lower(F.trim(F.regexp_replace(rest, r"(?i)\s*\((fragment|isoform[^)]*)\)\s*", ""))), F.lit(""))


def is_immunoglobulin(h: Column | str) -> Column:
    return _c(h).rlike(r"(?i)(immunoglobulin|\bIg[- ](?:like|heavy|kappa|lambda|gamma|mu|alpha)|\bIg heavy chain|variable region|\bIG[HKL][VDJ]?\b)")


def ladder_source(h: Column | str) -> Column:
    """The kind of a header by the first pattern that fits."""
    return _let(F.trim(_c(h)), lambda t: _let(F.regexp_extract(t, r"^(\S+)", 1), lambda first: _ladder_source(t, first)))


def _ladder_source(h: Column, first: Column) -> Column:
    field = lambda k: F.try_element_at(F.split(first, r"\|"), F.lit(k))
    rules = [
        ("disease_variant", h.startswith("sp|") & first.contains("_VAR")), ("swissprot", h.startswith("sp|")), ("trembl", h.startswith("tr|")),
        ("gnomad", h.startswith("var-")), ("ensembl_pep", h.rlike("^ENS(MUS)?P") & h.contains(" pep ")), ("gencode", h.startswith("ENSP") & first.contains("|")),
        ("personal_variant", h.startswith("ens|")), ("ncbi_microbe", F.coalesce(field(2).rlike("^[WYN]P_"), F.lit(False))), ("uhgp", h.startswith("MGYG")),
        ("gmgc", h.startswith("GMGC")), ("smorf", h.rlike("^(SMORF|smORF)")), ("assembly", h.startswith("MuPr_Assembly")), ("genscan", h.startswith("GENSCAN")),
        ("prodigal", h.contains(" # ") & h.contains("ID=")), ("sample_ref", first.contains("|REF|")), ("lake_hybrid", h.rlike(r"\[(SWISSPROT|UHGG|GMGC)\]")),
        ("md5_hash", first.rlike("^[0-9a-f]{32}$")), ("isoform_db", (F.size(F.split(first, r"\|")) >= 3) & F.coalesce(field(2).rlike("^[A-Z][A-Z0-9]{1,14}$"), F.lit(False))),
    ]
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit("unknown"))


def ladder_fields(h: Column | str) -> Column:
    """accession, gene, description, organism, variant, source of a header of any known kind.

    A header behind a sample prefix, or embedded in a lake header, is read as itself; its accession stays whole.
    """
    read = lambda t: F.struct(t.alias("h"), F.regexp_extract(t, r"^(\S+)", 1).alias("accession"), ladder_source(t).alias("outer"))
    return _let(F.trim(_c(h)), lambda t: _let(read(t), lambda whole: _let(_ladder_body(whole), lambda part: _ladder_fields(whole, part))))


def _ladder_body(whole: Column) -> Column:
    """What the header is read as: body, its first word, kind and rest."""
    h, accession, outer = whole["h"], whole["accession"], whole["outer"]
    embedded = F.regexp_extract(h, r"((?:sp|tr)\|\S+\|\S+\s+.*?)(?:\s+md5=|\s*$)", 1)
    behind = F.concat(F.regexp_replace(accession, r"^[^|]*\|[^|]*\|", ""), F.substring(h, F.length(accession) + 1, F.length(h)))
    body = F.when(outer == "sample_ref", behind).when((outer == "lake_hybrid") & (embedded != ""), embedded).otherwise(h)
    rest = lambda t, own: F.nullif(F.trim(F.substring(t, F.length(own) + 1, F.length(t))), F.lit(""))
    parts = lambda t: _let(F.regexp_extract(t, r"^(\S+)", 1), lambda own: F.struct(t.alias("body"), own.alias("own"), ladder_source(t).alias("kind"), rest(t, own).alias("rest")))
    return _let(body, parts)


def _ladder_fields(whole: Column, part: Column) -> Column:
    accession, outer, body, own, kind, rest = whole["accession"], whole["outer"], part["body"], part["own"], part["kind"], part["rest"]
    get = lambda text, pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    field = lambda k: F.nullif(F.try_element_at(F.split(own, r"\|"), F.lit(k)), F.lit(""))
    tag = get(body, r"GN=(\S+)")
    uniprot = kind.isin("swissprot", "trembl")
    gene = (
        F.when(uniprot, tag)
        .when(kind == "disease_variant", F.coalesce(tag, F.replace(field(3), F.lit("_VAR"), F.lit(""))))
        .when(kind == "gnomad", F.coalesce(tag, get(field(3), r"^([A-Z][A-Z0-9]+)(?:_|$)")))
        .when(kind == "ensembl_pep", F.coalesce(get(body, r"gene_symbol:(\S+)"), get(body, r"gene:(\S+)")))
        .when(kind == "gencode", F.nullif(field(7), F.lit("-")))
        .when(kind == "personal_variant", F.coalesce(tag, field(3)))
        .when(kind == "ncbi_microbe", F.coalesce(get(rest, r"gene=(\S+)"), field(3)))
        .when(kind == "isoform_db", field(2)).when(kind == "genscan", None)
        .when(kind.isin("lake_hybrid", "unknown"), F.coalesce(tag, own)).otherwise(own)
    )
    description = (
        F.when(uniprot, get(body, r"\|\S+_\S+\s+(.*?)(?:\s+OS=|\s*$)"))
        .when(kind == "gnomad", F.nullif(F.trim(_gnomad_text(F.coalesce(rest, F.lit("")))), F.lit("")))
        .when(kind == "ensembl_pep", get(body, r"description:(.+?)(?:\s+\[Source:|\s*$)"))
        .when(kind == "gencode", F.concat(F.lit("isoform "), field(6)))
        .when(kind == "ncbi_microbe", F.nullif(F.trim(F.regexp_replace(F.regexp_replace(rest, r"gene=\S+\s*", ""), "OS=.*$", "")), F.lit("")))
        .when(kind == "genscan", "computational prediction").when(kind == "md5_hash", None).otherwise(rest)
    )
    organism = F.when(uniprot | (kind == "gnomad"), get(body, r"OS=(.+?)(?:\s+OX=|\s+GN=|\s+PE=|\s*$)")).when(kind == "ncbi_microbe", get(rest, r"OS=(.+?)\s*$"))
    variant = (
        F.when(kind == "disease_variant", get(field(2), "_v(.+)$"))
        .when(kind == "gnomad", F.coalesce(get(body, r"\[VARIANT:\s*(.*?)\]"), F.concat(F.lit("p."), get(field(3), "^[^_]*_(.+)$"))))
        .when(kind == "personal_variant", F.concat(F.lit("p."), get(field(2), "^[^_]*_(.+)$")))
    )
    source = F.when(outer == "lake_hybrid", outer).otherwise(kind)
    return F.struct(accession.alias("accession"), gene.alias("gene"), description.alias("description"), organism.alias("organism"), variant.alias("variant"), source.alias("source"))


def _gnomad_text(s: Column) -> Column:
    for pattern in (r"^(?:sp|tr)\|\S+\|\S+_\S+\s+", r"\s*GN=\S+", r"\s*\[VARIANT:.*?\]", r"\s*\[AF_\w+:.*?\]", r"\s*PE=\d+\s*SV=\d+", r"\s*OS=.*?(?=\s+PE=|\s+GN=|\s*$)"):
        s = F.regexp_replace(s, pattern, "")
    return s


def accession_of(identifier: Column | str) -> Column:
    """The bare accession of an identifier: behind CON_, rev_ and DECOY_, in sp| or tr|, or plain; else null."""
    x = F.trim(_c(identifier))
    for prefix in ("CON_", "rev_", "DECOY_"):
        x = F.regexp_replace(x, f"^{prefix}", "")
    tagged = x.rlike(r"^(sp|tr)\|")
    return F.when(tagged, F.element_at(F.split(x, r"\|"), 2)).when(x.rlike("^[A-Za-z][A-Za-z0-9]{5,9}$"), x)


def ion_completeness(b_ions: Column, y_ions: Column, length: Column) -> Column:
    return F.when(length > 1, F.least((b_ions + y_ions) / (2 * (length - 1)), F.lit(1.0))).otherwise(0.0)

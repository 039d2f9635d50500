"""Headers, names, lineages and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degenerate base codes with their complements, and phylum synonyms.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]",
    "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]",
}
CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
PHYLUM_SYNONYMS = {
    "bacillota": "firmicutes", "pseudomonadota": "proteobacteria", "actinomycetota": "actinobacteria",
    "bacteroidota": "bacteroidetes", "verrucomicrobiota": "verrucomicrobia", "spirochaetota": "spirochaetes",
    "chloroflexota": "chloroflexi", "synergistota": "synergistetes", "fusobacteriota": "fusobacteria",
    "deinococcota": "deinococcus-thermus", "lentisphaerota": "lentisphaerae", "planctomycetota": "planctomycetes",
    "campylobacterota": "campylobacterota", "thermodesulfobacteriota": "thermodesulfobacteriota",
    "methanobacteriota": "euryarchaeota", "halobacteriota": "euryarchaeota", "thermoplasmatota": "euryarchaeota",
    "methanobacteriati": "euryarchaeota",
}
UNCULTURED = r"(?i)uncultured|metagenome|environmental sample|unidentified|unclassified|^\s*$"
NAME_PREFIX = r"(?i)^(Candidatus\s+|Ca[._]\s*|midas_[a-z]_)\s*"
BINOMIAL = r"^[A-Z][a-z]+ [a-z]{3,}$"
MAG = r"(?i)\b(MAG|metagenome|bin[_.\s-]?\d|UBA\d|SRR\d|sludge|enrichment)\b"
GENOME_ID = r"^\d+\.\d+$"


def none_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def clean_sequence(c: Column) -> Column:
    """Upper case (A-Z) without white space at the ends."""
    return F.translate(strip(c), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reverse_complement(c: Column, unknown: str = "keep") -> Column:
    """Of an upper-case sequence; other letters stay, or become N with unknown="N"."""
    turned = F.reverse(F.translate(c, CODES, COMPLEMENTS))
    return turned if unknown == "keep" else F.regexp_replace(turned, f"[^{CODES}]", "N")


def primer_pattern(primer: str) -> str:
    """A regular expression for a degenerate primer."""
    primer = primer.strip().upper()
    bad = [b for b in primer if b not in IUPAC]
    if bad:
        raise ValueError(f"{bad[0]!r} in primer {primer!r} is no base code")
    return "".join(IUPAC[b] for b in primer)


def reversed_primer(primer: str) -> str:
    return primer.strip().upper().translate(str.maketrans(CODES, COMPLEMENTS))[::-1]


def header_fields(h: Column) -> dict[str, Column]:
    """feature_id, organism and genome_id of a bar-separated header with a bracketed tail."""
    feature = F.when(F.size(F.split(h, r"\|")) > 1, strip(F.element_at(F.split(h, r"\|"), 2))).otherwise(strip(h))
    body = strip(F.regexp_extract(h, r"\[([^\[\]]*)\]\s*$", 1))
    pair = F.instr(body, " | ") > 0
    tail = F.element_at(F.split(body, r" \| "), -1)
    organism = F.when(pair, strip(F.substring(body, F.lit(1), F.length(body) - F.length(tail) - 3))).otherwise(body)
    fallback = F.when(F.instr(feature, ".") > 0, F.substring_index(feature, ".", 2))
    return {"feature_id": feature, "organism": none_if_blank(organism), "genome_id": F.when(pair, strip(tail)).otherwise(fallback)}


def strict_header_fields(h: Column) -> dict[str, Column]:
    """Organism, genome and feature only where the header has the full form; taxon_id is the genome id's first part."""
    tail = r"\[(.+?)\s*\|\s*([0-9]+\.[0-9]+)\]\s*$"
    genome = none_if_blank(F.regexp_extract(h, tail, 2))
    return {
        "organism": none_if_blank(F.regexp_extract(h, tail, 1)),
        "genome_id": genome,
        "feature_id": none_if_blank(F.regexp_extract(h, r"^fig\|([^|]+)\|", 1)),
        "taxon_id": F.substring_index(genome, ".", 1).cast("long"),
    }


def genome_of_feature(feature: Column) -> Column:
    return F.substring_index(feature, ".", 2)


def genome_of_header(h: Column) -> Column:
    fig = none_if_blank(F.regexp_extract(h, r"^(fig\|[^|]+)", 1))
    token = F.regexp_extract(h, r"^\s*([^\s]*)", 1)
    return F.coalesce(fig, F.substring_index(token, "|", 1))


def domain_of_header(h: Column) -> Column:
    found = F.regexp_extract(h, r"(?i)\b(Bacteria|Archaea)\b", 1)
    return F.when(found != "", F.initcap(found)).otherwise(F.lit("Unknown"))


def genus_of(organism: Column) -> Column:
    """First usable word in lower case; words such as candidatus and uncultured are skipped."""
    words = F.filter(F.split(F.lower(F.regexp_replace(organism, r"[\[\]]", "")), r"\s+"), lambda w: (w != "") & ~w.isin("candidatus", "uncultured", "unclassified"))
    return F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))


def normal_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), NAME_PREFIX, ""))


def normal_phylum(c: Column) -> Column:
    name = F.lower(strip(F.coalesce(c, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in PHYLUM_SYNONYMS.items() for x in pair])
    return F.coalesce(table[name], name)


def is_placeholder(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return s.isin("", "nan") | s.startswith("midas") | s.startswith("unclassified")


def is_uncultured(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(UNCULTURED)


def is_bin(genome: Column, organism: Column) -> Column:
    """Metagenome bins: ids of another shape than number.number, or names that tell."""
    return ~genome.rlike(GENOME_ID) | F.coalesce(organism, F.lit("")).rlike(MAG)


def is_named(species: Column) -> Column:
    s = strip(F.coalesce(species, F.lit("")))
    return s.rlike(BINOMIAL) & ~F.lower(s).contains("bacterium")


def is_unnamed(species: Column) -> Column:
    s = F.lower(F.coalesce(species, F.lit("")))
    return (s == "") | s.contains("sp.") | s.contains("bacterium")


def taxonomy_tokens(c: Column) -> Column:
    return F.transform(F.split(strip(F.coalesce(c, F.lit(""))), r"\s+"), normal_name)


def lineage_rank(c: Column, letter: str) -> Column:
    """One rank of a prefixed lineage such as d__A;p__B."""
    return F.regexp_extract(c, rf"(?:^|;)\s*{letter}__([^;]*)", 1)


def accession(path: Column) -> Column:
    """A reference's accession from its path, else the file name without its suffix."""
    found = F.regexp_extract(path, r"(GC[AF]_\d+\.\d+)", 1)
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.(fna|fasta|fa)(\.gz)?$", "")
    return F.when(found != "", found).otherwise(name)


def bare_accession(c: Column) -> Column:
    return F.regexp_replace(c, "^(GB_|RS_)", "")


def key_head(c: Column, last: bool = False) -> Column:
    """Left part of a composite key cut at its first (or last) double underscore."""
    return F.regexp_extract(c, r"^(.*)__" if last else r"^(.*?)__", 1)


def key_tail(c: Column, last: bool = False) -> Column:
    return F.regexp_extract(c, r"^.*__(.*)$" if last else r"^.*?__(.*)$", 1)


def taxon_of_genome(genome: Column, strict: bool = True) -> Column:
    """The number before the dot; strict needs number.number, else any integer prefix counts."""
    head = F.regexp_extract(genome, r"^(\d+)", 1)
    return F.when(genome.rlike(GENOME_ID) if strict else head != "", head.cast("long"))


def int_or_null(c: Column) -> Column:
    """int(float(text)), null where it is no number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d.try_cast("long"))


def json_number(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("long")


def aliases(pairs: dict[str, Column]) -> Column:
    """Array of (name, value) without empty values, in the order given."""
    every = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.filter(every, lambda x: x["value"].isNotNull() & (x["value"] != ""))


def ontology_terms(m: Column) -> Column:
    """Map of source to terms, rewritten as source to (term to positions)."""
    return F.transform_values(m, lambda _, terms: F.map_from_entries(F.transform(terms, lambda t, i: F.struct(t, F.array(i)))))


def study_token(line: Column, place: int) -> Column:
    """A word of a study's taxonomy line by place (negative: from the end) in lower case, or empty."""
    words = F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: w != "")
    return F.coalesce(F.lower(F.try_element_at(words, F.lit(place))), F.lit(""))


def study_rank(name: Column) -> Column:
    """A study's name of a rank in lower case; nan and null are empty."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low == "nan", "").otherwise(low)


def study_genus(genus: Column, line: Column) -> Column:
    """The genus column, or else the last word of the taxonomy line."""
    known = study_rank(genus)
    return F.when(known != "", known).otherwise(study_token(line, -1))

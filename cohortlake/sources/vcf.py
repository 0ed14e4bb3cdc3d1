"""VCF text: candidate lines and their two sinks of the filter, and the header of genotype files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import chrom_name, chrom_number, tokens

CONTIGS = (*range(1, 23), "X", "Y")
#: Fields of a genotype file: section, name, number, type, description.
FIELDS = (
    ("INFO", "AC", "1", "Integer", "Alternative alleles"),
    ("INFO", "NS", "1", "Integer", "Samples with data"),
    ("INFO", "AF", "A", "Float", "Allele frequency"),
    ("INFO", "CALLRATE", "1", "Float", "Share of samples with data"),
    ("INFO", "END", "1", "Integer", "End of the variant"),
    ("INFO", "SVLEN", "1", "Integer", "Length, negative for deletions"),
    ("INFO", "SVTYPE", "1", "String", "Type of the variant"),
    ("INFO", "N_MISS", "1", "Integer", "Missing genotypes"),
    ("INFO", "N_HOMREF", "1", "Integer", "Homozygous reference genotypes"),
    ("INFO", "N_HET", "1", "Integer", "Heterozygous genotypes"),
    ("INFO", "N_HOMALT", "1", "Integer", "Homozygous alternative genotypes"),
    ("INFO", "HWECHISQ", "1", "Float", "Chi-square of Hardy-Weinberg proportions"),
    ("INFO", "PRE", "1", "String", "Mean and deviation of depth before the variant"),
    ("INFO", "POST", "1", "String", "Mean and deviation of depth after the variant"),
    ("INFO", "DP", "1", "String", "Clusters of depth"),
    ("INFO", "DPOverlap", "1", "Float", "Overlap of the clusters of depth"),
    ("INFO", "DP2", "1", "String", "Clusters of depth in two segments"),
    ("INFO", "DP2Overlap", "1", "Float", "Overlap of the clusters in two segments"),
    ("INFO", "DPCNT", "1", "String", "Clusters of depth and read count"),
    ("INFO", "DPCNTOverlap", "1", "Float", "Overlap of the clusters of depth and read count"),
    ("INFO", "CNT", "1", "String", "Clusters of read count"),
    ("INFO", "CNTOverlap", "1", "Float", "Overlap of the clusters of read count"),
    ("INFO", "SPLIT", "1", "String", "Breakpoints by split reads"),
    ("INFO", "CLIP", "1", "String", "Breakpoints by soft clips"),
    ("INFO", "READPAIR", "0", "Flag", "Genotyped at the given breakpoints"),
    ("INFO", "Biallelic", "0", "Flag", "Biallelic variant"),
    ("FORMAT", "GT", "1", "String", "Genotype"),
    ("FORMAT", "CN", "1", "Integer", "Copy number"),
    ("FORMAT", "ND", "1", "Float", "Depth as a share of the sample's mean"),
    ("FORMAT", "DP", "1", "Float", "Depth"),
    ("FORMAT", "DD", "4", "Float", "Depth before, in the first and the second half, and after"),
    ("FORMAT", "SP", "1", "Integer", "Split reads"),
    ("FORMAT", "RP", "1", "Integer", "Read pairs"),
    ("FORMAT", "SC", "1", "Integer", "Soft clips at the start"),
    ("FORMAT", "EC", "1", "Integer", "Soft clips at the end"),
)
ALTERNATIVES = (("DEL", "Deletion"), ("DUP", "Duplication"), ("CNV", "Copy number variant"), ("INV", "Inversion"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a (gzipped) VCF text file."""
    return parse(spark.read.text(path).withColumnRenamed("value", "line"))


def info_value(info: Column, key: str) -> Column:
    """The value of a key; the last one where it is repeated, null where it is missing or empty."""
    return F.nullif(F.regexp_extract(info, rf"^(?:.*;)?{key}=([^;]*)", 1), F.lit(""))


def parse(lines: DataFrame) -> DataFrame:
    """sv_id, chrnum, pos, end, svtype, supp, mate_chrnum, supp_vec from a column ``line``; headers, blank and unreadable lines go.

    Columns split at blanks, tabs and line ends; what follows pos comes from the eighth.
    Without CHR2 the mate is on the same chromosome.
    """
    rows = lines.where(F.col("line").isNotNull() & ~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).select(tokens(F.col("line")).alias("t"))
    rows = rows.where(F.size("t") >= 8).select(*[F.get("t", F.lit(i)).alias(n) for i, n in ((2, "id"), (0, "name"), (1, "p"), (7, "info"))])
    values = {k: info_value(F.col("info"), k) for k in ("END", "SVTYPE", "SUPP", "CHR2", "SUPP_VEC")}
    rows = rows.select("id", "p", chrom_number(F.col("name")).alias("chrnum"), *[v.alias(k) for k, v in values.items()])
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return rows.select(
        F.expr("try_cast(id as bigint)").alias("sv_id"), "chrnum", number("p").alias("pos"), number("END").alias("end"), F.col("SVTYPE").alias("svtype"), number("SUPP").alias("supp"),
        F.when(F.col("CHR2").isNull(), F.col("chrnum")).otherwise(chrom_number(F.col("CHR2"))).alias("mate_chrnum"), F.col("SUPP_VEC").alias("supp_vec"),
    )


def filter_candidates(rows: DataFrame, most: int = 10_000_000) -> DataFrame:
    """What the filter takes from parsed lines: chromosomes 1 to 24, both ends on one, start below end, at most ``most`` bases."""
    n = F.col("end") - F.col("pos")
    return rows.where(F.col("chrnum").between(1, 24) & (F.col("mate_chrnum") == F.col("chrnum")) & (F.col("pos") > 0) & (n > 0) & (n <= most))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _line(name: Column, info: list[Column]) -> Column:
    return F.concat_ws("\t", name, _text("pos"), _text("sv_id"), F.lit("."), F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("."), F.lit("PASS"), F.concat_ws(";", *info)).alias("line")


def _field(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}="), value)


def with_line(sv: DataFrame) -> DataFrame:
    """``sv`` and as ``line`` its VCF line (without sample columns); CHR2 and SUPP_VEC where ``sv`` has them."""
    info = [_field("SVTYPE", F.col("svtype")), _field("END", _text("end")), _field("SVLEN", (F.col("end") - F.col("pos") + 1).cast("string")), _field("SUPP", _text("supp"))]
    if "mate_chrnum" in sv.columns:
        info.append(_field("CHR2", chrom_name(F.col("mate_chrnum"))))
    if "supp_vec" in sv.columns:
        info.append(_field("SUPP_VEC", F.col("supp_vec")))
    return sv.select("*", _line(chrom_name(F.col("chrnum")), info))


def to_lines(sv: DataFrame) -> DataFrame:
    """One VCF line per candidate."""
    return with_line(sv).select("line")


def merged_lines(sv: DataFrame) -> DataFrame:
    """Lines of merged candidates: SUPP, SVTYPE, END."""
    return sv.select(_line(_text("chrnum"), [_field("SUPP", _text("supp")), _field("SVTYPE", F.col("svtype")), _field("END", _text("end"))]))


def supported_lines(rows: DataFrame) -> DataFrame:
    """Lines of candidates with their best overlapping support (sup_chrnum, sup_pos, sup_end, sup_supp; nulls without): SVTYPE, OVERLAP, SUPP, N, END, SUPP_VEC.

    N is the candidate's own support; without an overlap SUPP is 1 and OVERLAP is left out.
    """
    place = F.concat(_text("sup_chrnum"), F.lit(":"), _text("sup_pos"), F.lit("-"), _text("sup_end"))
    info = [
        _field("SVTYPE", F.col("svtype")), _field("OVERLAP", place), _field("SUPP", F.coalesce(_text("sup_supp"), F.lit("1"))), _field("N", F.coalesce(_text("supp"), F.lit("0"))),
        _field("END", _text("end")), _field("SUPP_VEC", F.coalesce("supp_vec", F.lit(""))),
    ]
    return rows.select(_line(_text("chrnum"), info))


def reheader(lines: DataFrame, header: DataFrame, meta: str = "#") -> DataFrame:
    """``header``'s lines, then the body: ``lines`` (place, line) without those of its head, the run of ``meta`` lines it begins with. Columns place, line.

    The header's places are counted below the body's, so that sorting by place gives the file.
    """
    body = lines.where(~F.startswith("line", F.lit(meta))).agg(F.min("place").alias("_first"))
    kept = lines.crossJoin(body).where(F.col("place") >= F.col("_first")).select("place", "line")
    count = header.agg(F.max("place").alias("_last"))
    low = kept.agg(F.min("place").alias("_low"))
    head = header.crossJoin(count).crossJoin(low).select((F.col("place") - F.col("_last") - 1 + F.coalesce("_low", F.lit(0))).alias("place"), "line")
    return head.unionByName(kept)


def header(samples: list[str], lengths: dict | None = None, exclude: set | frozenset = frozenset()) -> str:
    """Header lines of a genotype file: contigs (with their ``lengths``, by number or name), fields, and the samples that aren't excluded."""
    sizes = {str(k).replace("23", "X").replace("24", "Y") if k in (23, 24) else str(k): v for k, v in (lengths or {}).items()}
    contigs = [f"##contig=<ID=chr{c}" + (f",length={sizes[str(c)]}" if str(c) in sizes else "") + ">" for c in CONTIGS]
    fields = [f'##{where}=<ID={name},Number={n},Type={kind},Description="{text}">' for where, name, n, kind, text in FIELDS]
    kinds = [f'##ALT=<ID={name},Description="{text}">' for name, text in ALTERNATIVES]
    at = next(i for i, f in enumerate(FIELDS) if f[0] == "FORMAT")
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[s for s in samples if s not in exclude]])
    return "\n".join(["##fileformat=VCFv4.1", *contigs, *fields[:at], *kinds, *fields[at:], columns])

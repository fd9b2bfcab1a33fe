"""Parsers of the texts in result tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.numeric import col

#: One piece of a path: ``10-15 -> 22-27``.
PIECE = r"(\d+)\s*-\s*(\d+)\s*->\s*(\d+)\s*-\s*(\d+)"
# Three-letter to one-letter residue codes.
RESIDUES = dict(
    zip(
        "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL".split(),
        "A R N D C Q E G H I L K M F P S T W Y V M U O".split(),
    )
)


def parse_pieces(c: Column | str, separator: str = ";") -> Column:
    """``a-b -> c-d; ...`` as ARRAY<STRUCT<ms, me, ss, se>>; parts that don't match are left out, null gives an empty array."""
    part = lambda p, g: F.regexp_extract(p, PIECE, g).try_cast("int")
    made = F.transform(F.split(col(c), separator), lambda p: F.struct(part(p, 1).alias("ms"), part(p, 2).alias("me"), part(p, 3).alias("ss"), part(p, 4).alias("se")))
    return F.coalesce(F.filter(made, lambda s: s["ms"].isNotNull()), F.array().cast("array<struct<ms:int,me:int,ss:int,se:int>>"))


def parse_interval(c: Column | str) -> Column:
    """STRUCT<s, e> of ``10-15``, ``(1, 30)`` or ``7``, in order; null if there is no number."""
    a = F.regexp_extract(col(c), r"(\d+)", 1).try_cast("int")
    b = F.regexp_extract(col(c), r"(\d+)\D+(\d+)", 2).try_cast("int")
    end = F.coalesce(b, a)
    return F.when(a.isNotNull(), F.struct(F.least(a, end).alias("s"), F.greatest(a, end).alias("e")))


def parse_residues(c: Column | str) -> Column:
    """``1,2;5-8`` as a sorted ARRAY<INT> without repeats; what is no number is left out."""
    parts = F.filter(F.split(col(c), r"[,;\s]+"), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    first = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
    last = lambda p: F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2))).otherwise(p).cast("int")
    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.least(first(p), last(p)), F.greatest(first(p), last(p)))))))


def parse_int_list(c: Column | str) -> Column:
    """A literal list ``[1, 2, 3]`` as ARRAY<INT>; null if it isn't one."""
    return F.from_json(col(c), "array<int>")


def base_accession(c: Column | str) -> Column:
    """Accession without version: what stands before the first point."""
    return F.split_part(F.trim(col(c)), F.lit("."), F.lit(1))


def uniprot_accession(c: Column | str) -> Column:
    """The first UniProt accession in a header; null if there is none."""
    found = F.regexp_extract(col(c), r"\b([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})\b", 1)
    return F.when(found != "", found)


def safe_name(c: Column | str) -> Column:
    """A name fit for files: slashes and colons to ``__``, other odd characters to ``_``; ``record`` if nothing is left."""
    s = F.regexp_replace(F.trim(col(c)), r"[\\/:]+", "__")
    s = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._+-]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", "record").otherwise(s)


def number_tag(c: Column | str) -> Column:
    """1.0 as ``1p0``, 0.25 as ``0p25``."""
    return F.replace(col(c).cast("double").cast("string"), F.lit("."), F.lit("p"))


def parse_combination(c: Column | str) -> Column:
    """``F1p0_S8p0`` as STRUCT<first, second>."""
    num = lambda g: F.replace(F.regexp_extract(col(c), r"F(\d+p\d+)_S(\d+p\d+)", g), F.lit("p"), F.lit(".")).try_cast("double")
    return F.struct(num(1).alias("first"), num(2).alias("second"))


def parse_pipe_header(c: Column | str) -> Column:
    """``id|key=value|...`` as a map; parts without ``=`` are left out."""
    parts = F.filter(F.split(col(c), r"\|"), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.trim(F.substring_index(p, "=", -1)))))


def ungap(c: Column | str) -> Column:
    """Residues of an aligned sequence, upper case, without gaps (``-`` and ``.``)."""
    return F.upper(F.translate(col(c), "-.", ""))


def residues_before(c: Column | str, column: Column | str) -> Column:
    """Number of residues in the first ``column`` columns of an aligned sequence."""
    return F.length(F.translate(F.substring(col(c), F.lit(1), col(column)), "-.", ""))


def one_letter(c: Column | str) -> Column:
    """Three-letter residue code to one letter, ``X`` if unknown."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(col(c)))), F.lit("X"))


def hash_number(*keys: Column | str, bits: int = 52) -> Column:
    """A stable number below 2**bits from the MD5 of the keys joined by ``|`` (the same in any engine)."""
    joined = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, bits // 4), 16, 10).cast("bigint")


#: The same as SQL text for DuckDB; {k} is the joined key.
HASH_SQL = "('0x' || substr(md5({k}), 1, 13))::BIGINT"

"""Readers of the files of the analysis, each giving a flat table.

Texts are read as lines or whole small files and parsed by column
expressions; binary and fixed-layout files by one vectorised function per
batch of files. Every reader takes a path or glob Spark can read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.text import base_accession
from strandloom.session import ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): numbered lines of whole files (files are units of bounded size here)."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "line"))
    return t.withColumn("file", F.url_decode("file"))


def scan_files(spark: SparkSession, root: str, pattern: str = "*.hhm", exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """(path, length): files below ``root`` by glob, without those whose path matches an excluded pattern (SQL LIKE)."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    for e in exclude:
        t = t.where(~F.col("path").like(e))
    return t


def dense_ids(files: DataFrame, root: str, name: str = "name") -> DataFrame:
    """(family_id, name, path): dense ids from 0, names PFnnnnn by number first, the others by path.

    A name that occurs twice is an error. Ids are row numbers of a range
    partitioned order, shifted by the partitions before.
    """
    from strandloom.operators.windows import ordered_buckets, running_total

    rel = F.regexp_replace("path", "^.*?" + root.strip("/").split("/")[-1] + "/", "")
    t = files.withColumn(name, F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).withColumn("_rel", rel)
    twice = t.groupBy(name).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"names that occur more than once: {[r[name] for r in twice]}")
    num = F.regexp_extract(name, r"^PF(\d{5})$", 1)
    t = t.withColumn("_key", F.struct((num == "").alias("other"), F.when(num != "", num.cast("int")).otherwise(0).alias("num"), F.col("_rel").alias("rel")))
    t = ordered_buckets(t.withColumn("_one", F.lit(1)), ["_key"])
    return running_total(t, [F.asc("_key")], "_one", "_n", ["_p"]).select((F.col("_n") - 1).cast("int").alias("family_id"), name, "path")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, family_id, problem): lines ``name: int``, split at the first colon; bad numbers and repeats are marked, not dropped."""
    t = spark.read.text(path).where("trim(value) != '' AND value NOT LIKE '#%'")
    t = t.select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("name"), F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)).try_cast("int").alias("family_id"))
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    problem = F.when(F.col("family_id").isNull(), "bad number").when(n("name") > 1, "name repeated").when(n("family_id") > 1, "id repeated")
    return t.withColumn("problem", problem)


def resolve_paths(paths: DataFrame, mapping: DataFrame, path: str, root: str) -> DataFrame:
    """(path, family_id): the first candidate of a path (relative, without suffix, file name, stem) that the mapping knows."""
    rel = F.regexp_replace(path, "^.*?" + root.strip("/") + "/", "")
    name = F.element_at(F.split(path, "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    c = paths.select(path, F.posexplode(F.array(rel, bare(rel), name, bare(name))).alias("_k", "name"))
    best = c.join(mapping.select("name", "family_id"), "name").groupBy(path).agg(F.min_by("family_id", "_k").alias("family_id"))
    return paths.select(path).distinct().join(best, path, "left")


def _units(c: Column) -> Column:
    """A number in -1000 log2 units; ``*`` is infinite."""
    return F.when(c == "*", F.lit(float("inf"))).otherwise(c.try_cast("double"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Match states of profile files: (family, state, aa, emissions, transitions, msa_column).

    After the line that starts with NULL come a header of three lines and
    three lines per state: letter, number, 20 emissions, alignment column;
    7 transitions; a blank. State 0 holds the begin transitions, the null
    emissions come with every row as ``null_emissions``. The parse of a
    file ends at ``//``.
    """
    t = _lines(spark, path)
    w = Window.partitionBy("file").orderBy("n")
    t = t.withColumn("_end", F.max(F.when(F.col("line").startswith("//"), 1)).over(w)).where("_end IS NULL")
    t = t.withColumn("family", F.first(F.when(F.col("line").startswith("NAME"), F.split(F.trim("line"), r"\s+")[1]), True).over(Window.partitionBy("file")))
    t = t.withColumn("_null", F.max(F.when(F.col("line").startswith("NULL"), F.col("n"))).over(Window.partitionBy("file")))
    t = t.withColumn("_k", F.col("n") - F.col("_null"))
    cells = F.split(F.trim("line"), r"\s+")
    values = lambda s, n: F.transform(F.slice(s, 1, n), _units)
    null = t.where("_k = 0").select("file", values(F.slice(cells, 2, 20), 20).alias("null_emissions"))
    begin = t.where("_k = 3").select("file", "family", F.lit(0).alias("state"), F.lit(None).cast("string").alias("aa"), F.lit(None).cast("array<double>").alias("emissions"), values(cells, 7).alias("transitions"), F.lit(None).cast("int").alias("msa_column"))
    body = t.where("_k > 3 AND trim(line) != ''").withColumn("_c", cells)
    emit = body.withColumn("_next", F.lead("_c").over(w)).where(F.size("_c") >= 22)
    states = emit.select("file", "family", F.col("_c")[1].cast("int").alias("state"), F.col("_c")[0].alias("aa"), values(F.slice("_c", 3, 20), 20).alias("emissions"), values(F.col("_next"), 7).alias("transitions"), F.element_at("_c", -1).try_cast("int").alias("msa_column"))
    return begin.unionByName(states).join(null, "file", "left")


def profile_dumps(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family, state, aa, emissions) of profile dumps inside texts: ``HMM name LENG n``, then letter, number and 20 values."""
    t = df.where(F.col(text).startswith("HMM ")).select(key, F.split(text, r"\r\n|\n|\r").alias("_l"))
    t = t.select(key, F.split(F.get("_l", F.lit(0)), r"\s+")[1].alias("family"), F.explode(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))).alias("line"))
    c = F.split("line", r"\s+")
    t = t.withColumn("_c", c).where((F.size("_c") == 22) & F.get("_c", F.lit(1)).rlike(r"^\d+$"))
    return t.select(key, "family", F.get("_c", F.lit(1)).cast("int").alias("state"), F.get("_c", F.lit(0)).alias("aa"), F.transform(F.slice("_c", 3, 20), _units).alias("emissions"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, sequence) of FASTA or Stockholm files; interleaved blocks are joined in order."""
    t = _lines(spark, path)
    w = Window.partitionBy("file").orderBy("n")
    fasta = t.withColumn("_h", F.last(F.when(F.col("line").startswith(">"), F.trim(F.substr("line", F.lit(2)))), True).over(w)).withColumn("_fa", F.max(F.col("line").startswith(">")).over(Window.partitionBy("file")))
    rows = fasta.where(F.col("_fa") & ~F.col("line").startswith(">")).select("file", "n", F.col("_h").alias("header"), F.trim("line").alias("part"))
    sto = fasta.where(~F.col("_fa") & F.col("line").rlike(r"^[^#/\s]\S*\s+\S+")).select("file", "n", F.split("line", r"\s+")[0].alias("header"), F.split("line", r"\s+")[1].alias("part"))
    g = rows.unionByName(sto).where("header IS NOT NULL").groupBy("file", "header").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("_p"))
    return g.select("file", "header", F.array_join(F.transform("_p", lambda p: p["part"]), "").alias("sequence"))


def sequence_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, header, sequence) of FASTA records inside texts."""
    t = df.where(F.col(text).startswith(">")).select(key, F.posexplode(F.split(F.substr(text, F.lit(2)), r"(?:\r\n|\n|\r)>")).alias("n", "rec"))
    first = F.regexp_extract("rec", r"^([^\r\n]*)", 1)
    return t.select(key, "n", first.alias("header"), F.regexp_replace(F.substr("rec", F.length(first) + 1), r"\s", "").alias("sequence"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, row, col, value) of dense matrix files named ``<name>_<i>_<j>.npy``; 0-based."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                m = re.search(r"_(\d+)_(\d+)\.npy$", p)
                if m:
                    a = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                    r, c = np.indices(a.shape).reshape(2, -1)
                    yield pd.DataFrame({"i": int(m[1]), "j": int(m[2]), "row": r, "col": c, "value": a.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "i int, j int, row int, col int, value double")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, row, col, value) of sparse archives: i, meta (j, rows, cols, offset, count), rows, cols, vals; checked."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    meta, rows, cols, vals = z["meta"].reshape(-1, 5), z["rows"], z["cols"], z["vals"]
                    if not len(rows) == len(cols) == len(vals) == meta[:, 4].sum():
                        raise ValueError(f"{p}: lengths don't fit")
                    out = pd.DataFrame({"i": int(z["i"]), "j": np.repeat(meta[:, 0], meta[:, 4]), "row": rows, "col": cols, "value": vals.astype(float)})
                    if (out["row"] >= np.repeat(meta[:, 1], meta[:, 4])).any() or (out["col"] >= np.repeat(meta[:, 2], meta[:, 4])).any():
                        raise ValueError(f"{p}: a point lies outside of its matrix")
                    yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "i int, j int, row int, col int, value double")


def write_points(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Points as Parquet, partitioned by a bucket of i and sorted, so a query of one family reads few row groups."""
    points.withColumn("bucket", F.pmod(F.hash("i"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("i", "j", "row", "col").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_points(spark: SparkSession, path: str, i: int | None = None, buckets: int = 64) -> DataFrame:
    """Points written by ``write_points``; with ``i`` only that family's bucket and row groups are read."""
    t = spark.read.parquet(path)
    if i is not None:
        bucket = spark.range(1).select(F.pmod(F.hash(F.lit(i).cast("int")), F.lit(buckets))).first()[0]
        t = t.where((F.col("bucket") == bucket) & (F.col("i") == i))
    return t.drop("bucket")


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(i, j) of a pair list with commas, tabs or blanks, ``#`` comments, a header under several names; repeats once, in order.

    Columns are found by the header's names, the first two without one.
    """
    t = _lines(spark, path).where("trim(line) != '' AND line NOT LIKE '#%'").withColumn("_c", F.split(F.trim("line"), r"[,\t\s]+"))
    w = Window.partitionBy("file").orderBy("n")
    t = t.withColumn("_head", F.first("_c").over(w))
    at = lambda names, other: F.coalesce(*[F.nullif(F.array_position(F.transform("_head", F.lower), n), F.lit(0)) for n in names], F.lit(other))
    i = F.get("_c", (at(["i", "family_i", "idx_i", "start_i"], 1) - 1).cast("int")).try_cast("int")
    j = F.get("_c", (at(["j", "family_j", "idx_j", "start_j"], 2) - 1).cast("int")).try_cast("int")
    t = t.select("file", "n", i.alias("i"), j.alias("j")).where("i IS NOT NULL AND j IS NOT NULL")
    return t.groupBy("i", "j").agg(F.min(F.struct("file", "n")).alias("at")).orderBy("at").select("i", "j")


def expand_ranges(spark: SparkSession, si: int, ei: int, sj: int, ej: int, symmetric: bool = False) -> DataFrame:
    """Pairs of two closed ranges, row by row; of symmetric ones the upper triangle (diagonal included)."""
    rows = spark.range(si, ei + 1).withColumnRenamed("id", "i")
    low = F.greatest(F.lit(sj).cast("bigint"), F.col("i")) if symmetric else F.lit(sj).cast("bigint")
    return rows.where(low <= ej).select("i", F.explode(F.sequence(low, F.lit(ej).cast("bigint"))).alias("j"))


def missing_outputs(expected: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without an output."""
    return expected.select(*keys).distinct().join(written.select(*keys).distinct(), keys, "left_anti")


def read_backgrounds(spark: SparkSession, path: str, mapping: DataFrame | None = None) -> DataFrame:
    """(family, pos, bg FLOAT) of a JSON of arrays by name or id; pos from 1; names resolved by the mapping, numbers as ids."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("family", "v"))
    t = t.select("family", F.posexplode("v").alias("p", "bg")).select("family", (F.col("p") + 1).alias("pos"), F.col("bg").cast("float").alias("bg"))
    if mapping is None:
        return t
    m = mapping.select(F.col("name").alias("family"), "family_id")
    t = t.join(m, "family", "left").withColumn("family_id", F.coalesce("family_id", F.col("family").try_cast("int")))
    return t.where("family_id IS NOT NULL").select(F.col("family_id").alias("family"), "pos", "bg")


def read_coverage(spark: SparkSession, root: str) -> DataFrame:
    """(family, pos, frac) of all coverage files below ``root`` (``<family>_coverage.csv``); percent as a share."""
    t = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_coverage.csv").csv(root)
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)_coverage\.csv$", 1)
    t = t.select(name.alias("family"), F.col("Match_State").try_cast("int").alias("pos"), (F.col("Completeness_Percent").try_cast("double") / 100).alias("frac"))
    return t.dropna().groupBy("family", "pos").agg(F.max("frac").alias("frac"))


def read_csv_fallback(spark: SparkSession, path: str) -> DataFrame:
    """A CSV in UTF-8 (with or without BOM) or, where that doesn't decode, GBK; header names trimmed; all text."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    tidy = lambda cs: [c.strip().lstrip("\ufeff").strip() for c in cs]
    if raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).isEmpty():
        t = spark.read.option("header", "true").csv(path)
        return t.toDF(*tidy(t.columns))
    ship(spark)
    first = raw.select(F.expr("substring(content, 1, 65536)").alias("head")).first()["head"]
    import csv

    names = next(csv.reader([bytes(first).split(b"\n")[0].decode("gbk").rstrip("\r")]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                body = list(csv.reader(io.StringIO(content.decode("gbk"), newline="")))[1:]
                yield pd.DataFrame([(r + [None] * len(names))[: len(names)] for r in body], columns=names)

    t = raw.mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    return t.toDF(*tidy(names))


def write_observations(hits: DataFrame, windows: DataFrame, path: str) -> None:
    """The two related tables (observations and their random windows) as Parquet, joined by ``obs_id``."""
    hits.write.mode("overwrite").parquet(f"{path}/hit_obs")
    windows.write.mode("overwrite").parquet(f"{path}/null_win")


def read_observations(spark: SparkSession, path: str, status: str | None = "OK") -> tuple[DataFrame, DataFrame]:
    """Observations (of a status) and the random windows of those, by SQL over the two tables."""
    spark.read.parquet(f"{path}/hit_obs").createOrReplaceTempView("hit_obs")
    spark.read.parquet(f"{path}/null_win").createOrReplaceTempView("null_win")
    hits = spark.sql("SELECT * FROM hit_obs" + (f" WHERE status = '{status}'" if status else ""))
    return hits, spark.table("null_win").join(hits.select("obs_id"), "obs_id", "left_semi")


def read_interfaces(spark: SparkSession, path: str, exclude_same: bool = False) -> DataFrame:
    """(pfam_a, pfam_b, pdb, chain, side, residues) of a flat interface file (plain or gz).

    ``#=ID`` names the two families, ``#=3D`` an instance with two chains,
    contact lines hold two residues. Headers are carried down the lines.
    """
    t = _lines(spark, path)
    w = Window.partitionBy("file").orderBy("n")
    last = lambda c: F.last(c, True).over(w)
    cell = F.split(F.trim("line"), r"\s+")
    t = t.withColumns({"_id": last(F.when(F.col("line").startswith("#=ID"), cell)), "_3d": last(F.when(F.col("line").startswith("#=3D"), cell)), "_c": cell})
    t = t.where(~F.col("line").startswith("#") & ~F.col("line").startswith("//") & (F.trim("line") != "") & (F.size("_c") >= 4))
    fam = lambda n: F.regexp_extract(F.col("_id")[n], r"(PF\d{5})", 1)
    side = lambda a, b, ch, r: F.struct(a.alias("pfam_a"), b.alias("pfam_b"), F.split_part(F.col("_3d")[ch], F.lit(":"), F.lit(1)).alias("chain"), F.col("_c")[r].try_cast("int").alias("residue"))
    ids = F.size("_id")
    a, b = F.regexp_extract(F.array_join("_id", " "), r"(PF\d{5}).*?(PF\d{5})", 1), F.regexp_extract(F.array_join("_id", " "), r"(PF\d{5}).*?(PF\d{5})", 2)
    t = t.where(ids > 0).select(F.col("_3d")[1].alias("pdb"), F.explode(F.array(side(a, b, 2, 2), side(b, a, 3, 3))).alias("s")).select("pdb", "s.*").where("residue IS NOT NULL")
    if exclude_same:
        t = t.where("pfam_a != pfam_b")
    return t.groupBy("pfam_a", "pfam_b", "pdb", "chain").agg(F.sort_array(F.collect_set("residue")).alias("residues"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(acc, region_id, start, end, term) of a TSV of annotated regions; version off, numbers checked, ends in order."""
    t = spark.read.option("header", "true").option("sep", "\t").csv(path)
    from strandloom.sources.tables import resolve_columns

    t = resolve_columns(t, {"acc": ["UniProt ACC"], "region_id": ["Region ID"], "s": ["Start"], "e": ["End"], "term": ["Term name"]}, {"term": "string"})
    s, e = F.col("s").try_cast("int"), F.col("e").try_cast("int")
    t = t.select(base_accession("acc").alias("acc"), "region_id", s.alias("s"), e.alias("e"), "term").where("s IS NOT NULL AND e IS NOT NULL")
    return t.select("acc", "region_id", F.least("s", "e").alias("start"), F.greatest("s", "e").alias("end"), "term")


def read_seed_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, seed_name, acc, start, end) of the ``#=GS name AC accession`` lines of alignments."""
    t = spark.read.text(path).select(F.url_decode(F.input_file_name()).alias("file"), F.regexp_extract("value", r"^#=GS\s+(\S+)\s+AC\s+(\S+)", 1).alias("name"), F.regexp_extract("value", r"^#=GS\s+(\S+)\s+AC\s+(\S+)", 2).alias("ac"))
    span = lambda n: F.regexp_extract("name", r"/(\d+)-(\d+)$", n).try_cast("int")
    return t.where("name != ''").select("file", F.split_part("name", F.lit("/"), F.lit(1)).alias("seed_name"), base_accession("ac").alias("acc"), span(1).alias("start"), span(2).alias("end"))


def read_experiments(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """(protein, class, residues) of XML experiments: residues of each (kind, strength) class."""
    t = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema("_id string, residue array<struct<_VALUE:int,_kind:string,_strength:string>>").load(path)
    t = t.select(F.col("_id").alias("protein"), F.explode("residue").alias("r"))
    return t.groupBy("protein", F.concat_ws("_", F.initcap("r._kind"), F.upper("r._strength")).alias("class")).agg(F.sort_array(F.collect_set("r._VALUE")).alias("residues"))


def read_residue_mappings(spark: SparkSession, path: str) -> DataFrame:
    """One row per mapped segment of a JSON of structures: {pdb: {"UniProt": {acc: {"mappings": [...]}}}}; both numberings."""
    return flatten_residue_mappings(spark.read.text(path, wholetext=True))


def flatten_residue_mappings(texts: DataFrame, value: str = "value") -> DataFrame:
    """The same of a column of JSON texts."""
    m = "struct<entity_id:int,chain_id:string,unp_start:int,unp_end:int,start:struct<author_residue_number:int,residue_number:int,author_insertion_code:string>,end:struct<author_residue_number:int,residue_number:int,author_insertion_code:string>>"
    t = texts.select(F.explode(F.from_json(value, f"map<string,struct<UniProt:map<string,struct<mappings:array<{m}>>>>>")).alias("pdb_id", "p"))
    t = t.select("pdb_id", F.explode("p.UniProt").alias("uniprot_ac_raw", "u")).select("pdb_id", "uniprot_ac_raw", F.explode("u.mappings").alias("m"))
    return t.select("pdb_id", "uniprot_ac_raw", F.split_part("uniprot_ac_raw", F.lit("-"), F.lit(1)).alias("uniprot_ac_base"), "m.entity_id", "m.chain_id", F.col("m.start.author_residue_number").alias("auth_start"), F.col("m.end.author_residue_number").alias("auth_end"), F.col("m.start.residue_number").alias("res_start"), F.col("m.end.residue_number").alias("res_end"), "m.unp_start", "m.unp_end")


def read_hit_tables(spark: SparkSession, path: str, min_probability: float) -> DataFrame:
    """(main, sub, probability, main_segment, sub_segment) of the summary tables of search results.

    From the line after the header up to the first blank one: number, hit,
    ..., probability and the last two ``a-b`` ranges. Hits from
    ``min_probability`` on; self hits dropped; of a pair found both ways
    the first by file and line stays.
    """
    from strandloom.functions.numeric import unordered

    t = _lines(spark, path)
    w = Window.partitionBy("file").orderBy("n")
    t = t.withColumn("main", F.first(F.when(F.col("line").startswith("Query"), F.split(F.trim("line"), r"\s+")[1]), True).over(Window.partitionBy("file")))
    t = t.withColumn("_head", F.last(F.when(F.trim("line").startswith("No Hit"), F.col("n")), True).over(w)).withColumn("_blank", F.last(F.when(F.trim("line") == "", F.col("n")), True).over(w))
    t = t.where("_head IS NOT NULL AND n > _head AND (_blank IS NULL OR _blank < _head)")
    x = r"^\s*\d+\s+(\S+).*?\s(\d+(?:\.\d+)?)\s+\S+\s+\S+\s+\S+\s+\S+\s+\d+\s+(\d+-\d+)\s+(\d+-\d+)"
    g = lambda n: F.regexp_extract("line", x, n)
    t = t.select("file", "n", "main", g(1).alias("sub"), g(2).try_cast("double").alias("probability"), g(3).alias("main_segment"), g(4).alias("sub_segment"))
    t = t.where((F.col("probability") >= min_probability) & (F.col("sub") != F.col("main")) & (F.col("sub") != ""))
    k1, k2 = unordered("main", "sub")
    first = Window.partitionBy("_a", "_b").orderBy("file", "n")
    return t.withColumns({"_a": k1, "_b": k2}).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_a", "_b", "_r", "file", "n")


def read_fragment_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, fragments, sequence) of records of three lines: ``>header``, ``frag_dom=...``, sequence (plain or gz)."""
    t = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    line = lambda n: F.trim(F.get(F.split("value", r"\r\n|\n"), F.lit(n)))
    return t.select(line(0).alias("header"), F.regexp_extract(line(1), r"frag_dom=(.*)$", 1).alias("fragments"), line(2).alias("sequence"))


def read_position_probabilities(spark: SparkSession, path: str, policy: str = "first") -> DataFrame:
    """(header, position, wt, probabilities) of TSV lines; for repeats the first, the last or an error."""
    t = _lines(spark, path).withColumn("_c", F.split("line", "\t")).where(F.size("_c") >= 23)
    t = t.select("file", "n", F.col("_c")[0].alias("header"), F.col("_c")[1].try_cast("int").alias("position"), F.col("_c")[2].alias("wt"), F.transform(F.slice("_c", 4, 20), lambda x: x.try_cast("double")).alias("probabilities")).where("position IS NOT NULL")
    if policy == "error":
        if not t.groupBy("header", "position").count().where("count > 1").isEmpty():
            raise ValueError("a position occurs more than once")
        return t.drop("file", "n")
    order = (F.asc("file"), F.asc("n")) if policy == "first" else (F.desc("file"), F.desc("n"))
    return t.withColumn("_r", F.row_number().over(Window.partitionBy("header", "position").orderBy(*order))).where("_r = 1").drop("file", "n", "_r")


def read_atoms(spark: SparkSession, path: str, chain: str | None = None, hetatm: bool = False) -> DataFrame:
    """Atoms of fixed-width structure files: (file, chain, resseq, icode, resname, atom, x, y, z); of alternates blank or A."""
    t = spark.read.text(path).withColumn("file", F.url_decode(F.input_file_name()))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    kinds = ["ATOM", "HETATM"] if hetatm else ["ATOM"]
    t = t.where(cut(1, 6).isin(*kinds) & F.substring("value", 17, 1).isin(" ", "A"))
    t = t.select("file", cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resseq"), cut(27, 1).alias("icode"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom"), *[cut(a, 8).try_cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))])
    return t.where(F.col("chain") == chain) if chain else t


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, row MAP) of the CSV files inside zip archives, unpacked where the archive is read."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import zipfile

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(".csv"):
                            with z.open(name) as f:
                                rows = [dict(r) for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"))]
                            yield pd.DataFrame({"archive": p, "member": name, "row": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, row map<string,string>")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as CSV with headers."""
    nodes.write.mode("overwrite").option("header", "true").csv(f"{path}/nodes")
    edges.write.mode("overwrite").option("header", "true").csv(f"{path}/edges")


def graphml_lines(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str, weight: str) -> DataFrame:
    """The graph as GraphML, a line per element; ``part`` orders head, nodes, edges and tail."""
    x = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'), (3, "</graph></graphml>")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"/>', x(F.col(node))).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="w">%s</data></edge>', x(F.col(a)), x(F.col(b)), F.col(weight).cast("string")).alias("line"))
    return frame.unionByName(n).unionByName(e)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with one header, in the folder ``path``.

    Parts are written by all tasks and put one behind the other as streams
    of bytes, so no task or driver holds the table.
    """
    spark, parts = df.sparkSession, f"{path.rstrip('/')}-parts"
    df.write.mode("overwrite").option("header", "false").csv(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at, source = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    fs = at.getFileSystem(conf)
    fs.delete(at, True)
    out = fs.create(hadoop.fs.Path(at, "part-00000.csv"))
    quoted = lambda c: '"' + c.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(x in c for x in ',"\n\r') else c
    out.write(bytearray((",".join(map(quoted, df.columns)) + "\n").encode()))
    for file in sorted((f.getPath() for f in fs.listStatus(source)), key=lambda f: f.getName()):
        if file.getName().startswith("part-"):
            read = fs.open(file)
            hadoop.io.IOUtils.copyBytes(read, out, conf, False)
            read.close()
    out.close()
    fs.delete(source, True)


def write_manifest(spark: SparkSession, path: str, entries: dict) -> None:
    """A run's manifest as one JSON line."""
    spark.createDataFrame([(json.dumps(entries, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as a map of texts per file."""
    return spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("entries"))


def write_packed(profiles: DataFrame, path: str, key: str = "family") -> None:
    """Profiles as Parquet sorted by family, so that reading one family touches few row groups (offsets are not needed)."""
    profiles.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(path)


def read_packed(spark: SparkSession, path: str, families: list[int] | None = None, key: str = "family") -> DataFrame:
    """Packed profiles, all or those of some families (the filter reaches the scan)."""
    t = spark.read.parquet(path)
    return t.where(F.col(key).isin(families)) if families is not None else t


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(kind, family, shape, values) of array files named ``<kind>_<family>.npy``."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                if m := re.search(r"([A-Za-z]+)_(\d+)\.npy$", p):
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                    yield pd.DataFrame({"kind": [m[1]], "family": [int(m[2])], "shape": [list(a.shape)], "values": [a.ravel().astype(float).tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "kind string, family int, shape array<int>, values array<double>")

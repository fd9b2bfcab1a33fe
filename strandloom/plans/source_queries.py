"""Sources and sinks: tables written in the formats of the analysis and read back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import CLEAN_NAME_SQL
from strandloom.plans.aggregate_queries import _EDGES, edges
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import BACKGROUND, CONTACTS, PATHS, background, contacts, paths
from strandloom.plans.pipeline_queries import profiles
from strandloom.session import Stage, table
from strandloom.sources import readers as S

CATALOG = Catalog()


def _text(spark: SparkSession, lines: DataFrame, parts: int = 4) -> str:
    """A folder of text files with the given lines."""
    path = f"{Stage(spark, 'files').root}/text"
    lines.repartition(parts).write.text(path)
    return path


@CATALOG.query("SELECT row_number() OVER (ORDER BY pfam) - 1 AS family_id, pfam AS name FROM (SELECT DISTINCT pfam FROM fragment_index WHERE starts_with(pfam, 'PF') AND regexp_matches(pfam, '^PF[0-9]{5}$'))")
def src_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of profile files, names by number."""
    f = table(spark, d, "fragment_index").where(F.col("pfam").rlike("^PF[0-9]{5}$")).select(F.concat(F.lit("file:/data/lib/profiles/"), "pfam", F.lit(".hhm")).alias("path")).distinct()
    return S.dense_ids(f, "/data/lib").select(F.col("family_id").cast("bigint").alias("family_id"), "name")


@CATALOG.query("SELECT pfam AS name, family_id, CAST(NULL AS VARCHAR) AS problem FROM fragment_index")
def src_mapping(spark: SparkSession, d: str) -> DataFrame:
    """S3: mapping of names to ids written as lines and read with its problems marked."""
    f = table(spark, d, "fragment_index")
    return S.read_mapping(spark, _text(spark, f.select(F.format_string("%s: %d", "pfam", "family_id"))))


@CATALOG.query("SELECT 'file:/lib/' || hmm_file AS path, family_id FROM fragment_index")
def src_resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths resolved to ids by the first candidate that is known."""
    f = table(spark, d, "fragment_index")
    return S.resolve_paths(f.select(F.concat(F.lit("file:/lib/"), "hmm_file").alias("path")), f.select(F.col("pfam").alias("name"), "family_id"), "path", "/lib")


_ALN = f"SELECT global_row_index || ':' || pfam_side AS header, target_aligned_frag AS sequence FROM {CONTACTS} WHERE target_aligned_frag != ''"


@CATALOG.query(_ALN)
def src_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Aligned fragments written as FASTA, two lines a record or more, and read back."""
    t = contacts(spark, d, F.concat_ws(":", "global_row_index", "pfam_side").alias("h"), "target_aligned_frag").where("target_aligned_frag != ''")
    rec = F.concat(F.lit(">"), "h", F.lit("\n"), F.regexp_replace("target_aligned_frag", "(.{7})", "$1\n"))
    return S.read_alignment(spark, _text(spark, t.select(rec))).select("header", "sequence")


@CATALOG.query()
def src_packed(spark: SparkSession, d: str) -> DataFrame:
    """Profiles packed in order of the family and read back."""
    path = f"{Stage(spark, 'packed').root}/p"
    S.write_packed(profiles(spark, d), path)
    return S.read_packed(spark, path).select("family", F.size("emissions").alias("n"))


@CATALOG.query(f"SELECT family::VARCHAR AS family, row_number() OVER (PARTITION BY family ORDER BY pos)::INT AS pos, bg FROM {BACKGROUND}")
def src_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    """Background vectors written as JSON objects by name and read back."""
    g = background(spark, d).groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bg"))), lambda x: x["bg"].cast("double")).alias("v"))
    lines = g.select(F.to_json(F.create_map(F.col("family").cast("string"), "v")).alias("value"))
    path = f"{Stage(spark, 'files').root}/json"
    lines.repartition(20, "value").write.option("lineSep", " ").option("maxRecordsPerFile", 1).text(path)
    return S.read_backgrounds(spark, path)


@CATALOG.query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV with trimmed header names, all text."""
    path = f"{Stage(spark, 'files').root}/csv"
    table(spark, d, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), "o_orderpriority").write.option("header", "true").csv(path)
    return S.read_csv_fallback(spark, path)


@CATALOG.query(
    f"SELECT split_part(trim(accession), '.', 1) AS acc, global_row_index || ':' || pfam_side AS region_id, least(target_hmm_start, target_hmm_end) AS start, greatest(target_hmm_start, target_hmm_end) AS \"end\" FROM {CONTACTS} WHERE accession != '' AND target_hmm_start IS NOT NULL AND target_hmm_end IS NOT NULL"
)
def src_regions(spark: SparkSession, d: str) -> DataFrame:
    """Annotated regions as TSV; versions off, ends in order, rows without numbers out."""
    t = contacts(spark, d, F.concat("accession", F.lit(".2")).alias("UniProt ACC"), F.concat_ws(":", "global_row_index", "pfam_side").alias("Region ID"), F.col("target_hmm_start").alias("Start"), F.col("target_hmm_end").alias("End")).where("`UniProt ACC` != '.2'")
    path = f"{Stage(spark, 'files').root}/tsv"
    t.write.option("header", "true").option("sep", "\t").csv(path)
    return S.read_regions(spark, path).drop("term")


@CATALOG.query(f"SELECT 'S' || global_row_index || pfam_side AS seed_name, split_part(trim(accession), '.', 1) AS acc, seed_global_start AS start, seed_global_end AS \"end\" FROM {CONTACTS} WHERE accession != '' AND seed_global_start IS NOT NULL AND seed_global_end IS NOT NULL")
def src_seed_index(spark: SparkSession, d: str) -> DataFrame:
    """Accessions of seed alignments."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "accession", "seed_global_start", "seed_global_end").where("accession != ''").dropna()
    line = F.format_string("#=GS S%d%s/%d-%d  AC %s.1", "global_row_index", "pfam_side", "seed_global_start", "seed_global_end", "accession")
    return S.read_seed_index(spark, _text(spark, t.select(line))).drop("file")


@CATALOG.query("SELECT l_orderkey::VARCHAR AS protein, (CASE WHEN l_linenumber % 2 = 0 THEN 'Fold_EARLY' ELSE 'Stab_WEAK' END) AS class, count(DISTINCT l_partkey % 100)::INT AS n_residues FROM lineitem GROUP BY 1, 2")
def src_experiments(spark: SparkSession, d: str) -> DataFrame:
    """XML experiments to residue classes."""
    even = F.col("l_linenumber") % 2 == 0
    r = F.struct((F.col("l_partkey") % 100).cast("int").alias("_VALUE"), F.when(even, "fold").otherwise("stab").alias("_kind"), F.when(even, "early").otherwise("weak").alias("_strength"))
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("_id")).agg(F.collect_list(r).alias("residue"))
    path = f"{Stage(spark, 'files').root}/xml"
    t.write.format("xml").options(rootTag="all", rowTag="entry", attributePrefix="_", valueTag="_VALUE").save(path)
    return S.read_experiments(spark, path).select("protein", "class", F.size("residues").alias("n_residues"))


@CATALOG.query(f"SELECT pdb_id, chain_id, target_seq_start AS res_start, target_seq_end AS res_end, seed_global_start AS unp_start FROM {CONTACTS} WHERE pdb_id != '' AND accession != '' AND chain_id IS NOT NULL AND target_seq_start IS NOT NULL AND target_seq_end IS NOT NULL AND seed_global_start IS NOT NULL")
def src_residue_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON of residue mappings flattened."""
    t = contacts(spark, d, "pdb_id", "chain_id", "accession", "target_seq_start", "target_seq_end", "seed_global_start").dropna().where("pdb_id != '' AND accession != ''")
    at = lambda c: F.struct(F.col(c).alias("residue_number"), F.lit("").alias("author_insertion_code"))
    m = F.struct(F.lit(1).alias("entity_id"), "chain_id", F.col("seed_global_start").alias("unp_start"), at("target_seq_start").alias("start"), at("target_seq_end").alias("end"))
    line = F.to_json(F.create_map("pdb_id", F.struct(F.create_map("accession", F.struct(F.array(m).alias("mappings"))).alias("UniProt"))))
    lines = spark.read.text(_text(spark, t.select(line)))
    return S.flatten_residue_mappings(lines).select("pdb_id", "chain_id", "res_start", "res_end", "unp_start")


@CATALOG.query("SELECT 'f' || family_id AS header, '1-' || nfrag AS fragments, upper(pfam) AS sequence FROM fragment_index")
def src_fragment_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of three lines."""
    t = table(spark, d, "fragment_index").select(F.format_string(">f%d\nfrag_dom=1-%d\n%s", "family_id", "nfrag", F.upper("pfam")))
    return S.read_fragment_records(spark, _text(spark, t))


@CATALOG.query("SELECT 'v' || vec_id AS header, label AS position, round(embedding[1]::DOUBLE, 4) AS first, round(embedding[20]::DOUBLE, 4) AS last FROM embeddings")
def src_position_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """A vector of 20 values per position as TSV."""
    e = F.transform(F.slice("embedding", 1, 20), lambda x: x.cast("double").cast("string"))
    t = table(spark, d, "embeddings").select(F.concat_ws("\t", F.format_string("v%d", "vec_id"), F.col("label").cast("string"), F.lit("A"), F.array_join(e, "\t")))
    p = S.read_position_probabilities(spark, _text(spark, t))
    return p.select("header", "position", F.round(F.col("probabilities")[0], 4).alias("first"), F.round(F.col("probabilities")[19], 4).alias("last"))


@CATALOG.query("SELECT vec_id::INT AS resseq, chr(65 + label) AS chain, round(embedding[1]::DOUBLE * 100, 3) AS x FROM embeddings WHERE label < 26 AND vec_id < 10000")
def src_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms in fixed columns."""
    t = table(spark, d, "embeddings")
    # columns hold four figures of a residue and one letter of a chain: what goes beyond names the file
    block, letters = F.expr("vec_id div 10000"), F.expr("label div 26")
    c = lambda n: (F.col("embedding")[n].cast("double") * 100)
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("vec_id") % 10000, F.char(65 + F.col("label") % 26), F.col("vec_id") % 10000, c(0), c(1), c(2))
    path = f"{Stage(spark, 'files').root}/text"
    t.select(line.alias("value"), block.alias("block"), letters.alias("letters")).repartition(4).write.partitionBy("block", "letters").text(path)
    part = lambda name: F.regexp_extract("file", f"/{name}=(\\d+)/", 1).cast("int")
    p = S.read_atoms(spark, path)
    return p.select((part("block") * 10000 + F.col("resseq")).alias("resseq"), F.decode(F.unhex(F.lpad(F.hex(F.ascii("chain") + 26 * part("letters")), 8, "0")), "UTF-32").alias("chain"), F.round("x", 3).alias("x"))


@CATALOG.query(f"SELECT a, b, w::VARCHAR AS w FROM {_EDGES}")
def src_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the graph written as CSV."""
    e = edges(spark, d)
    path = f"{Stage(spark, 'files').root}/graph"
    S.write_graph(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), e, path)
    return spark.read.option("header", "true").csv(f"{path}/edges")


@CATALOG.query(f"SELECT DISTINCT {CLEAN_NAME_SQL.format(c='pfam_id')} AS family, 'completed' AS status FROM contact_order_results WHERE {CLEAN_NAME_SQL.format(c='pfam_id')} IS NOT NULL")
def src_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests as JSON lines."""
    t = contacts(spark, d, F.col("pfam_id").alias("family")).dropna().distinct().withColumn("status", F.lit("completed"))
    m = S.read_manifest(spark, _text(spark, t.select(F.to_json(F.struct("family", "status")))))
    return m.select(F.col("entries")["family"].alias("family"), F.col("entries")["status"].alias("status"))


def _put(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A folder with the given files (fixtures of the formats that Spark has no writer for; 20 families of 61 positions at most)."""
    root = f"{Stage(spark, 'files').root}/named"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name, content in files.items():
        out = hadoop.Path(f"{root}/{name}").getFileSystem(conf).create(hadoop.Path(f"{root}/{name}"))
        out.write(bytearray(content))
        out.close()
    return root


def _vectors(spark: SparkSession, d: str) -> dict[int, list[tuple[int, float]]]:
    """The background vectors of the 20 families, (position, value) in order."""
    t = background(spark, d).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("bg").cast("double").alias("v")))).alias("x"))
    return {r["family"]: [(x["pos"], x["v"]) for x in r["x"]] for r in t.collect()}


def _npy(values, **kw) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(values, **kw))
    return out.getvalue()


_TEXTS = "1000 * (pos % 3) + 7 * pos + 13 * {k} + family"


def _profile_text(rows: list[tuple[int, float]], family: int) -> bytes:
    units = lambda n, k0, pos: " ".join(str(1000 * (pos % 3) + 7 * pos + 13 * (k0 + k) + family) for k in range(n))
    head = f"HHsearch 1.5\nNAME  F{family:02d} made up\nLENG  {len(rows)}\n#\nNULL   {' '.join(['3706'] * 20)}\nHMM    A C D E F G H I K L M N P Q R S T V W Y\n       M->M M->I M->D I->M I->I D->M D->D\n       {units(7, 0, 0)}\n"
    body = "".join(f"{'ACDEFGHIKLMNPQRSTVWY'[pos % 20]} {pos}    {units(20, 0, pos)} {pos + 2}\n       {units(7, 20, pos)} 1 2 3\n\n" for pos, _ in rows)
    return f"{head}{body}//\n".encode()


def _profiles_put(spark: SparkSession, d: str) -> str:
    return _put(spark, {f"lib/x{f % 3}/F{f:02d}.hhm": _profile_text(rows, f) for f, rows in _vectors(spark, d).items()} | {"lib/old/F99.hhm": b"", "lib/readme.txt": b"none"})


@CATALOG.query(f"SELECT row_number() OVER (ORDER BY family % 3, family) - 1 AS family_id, 'F' || lpad(family::VARCHAR, 2, '0') AS name, true AS has_content FROM (SELECT DISTINCT family FROM {BACKGROUND})")
def src_scan(spark: SparkSession, d: str) -> DataFrame:
    """Profile files found below a folder, one subfolder left out, numbered in the order of their paths."""
    root = f"{_profiles_put(spark, d)}/lib"
    files = S.scan_files(spark, root, exclude=["%/old/%"])
    ids = S.dense_ids(files, root)
    return ids.join(files, "path").select(F.col("family_id").cast("bigint").alias("family_id"), "name", (F.col("length") > 0).alias("has_content"))


_EXPECTED_PROFILE = ", ".join(f"({_TEXTS.format(k=k)})::DOUBLE AS {name}" for name, k in (("first", 0), ("last", 19), ("stay", 20), ("leave", 26)))


@CATALOG.query(
    f"SELECT 'F' || lpad(family::VARCHAR, 2, '0') AS family, pos AS state, substr('ACDEFGHIKLMNPQRSTVWY', pos % 20 + 1, 1) AS aa, pos + 2 AS msa_column, {_EXPECTED_PROFILE} FROM {BACKGROUND} "
    f"UNION ALL SELECT 'F' || lpad(family::VARCHAR, 2, '0'), 0, NULL, NULL, NULL, NULL, family::DOUBLE, (78 + family)::DOUBLE FROM (SELECT DISTINCT family FROM {BACKGROUND})"
)
def src_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profile files: states, emissions, transitions and alignment columns."""
    t = S.read_profiles(spark, f"{_profiles_put(spark, d)}/lib/x*")
    value = lambda c, k, name: F.col(c)[k].alias(name)
    return t.select("family", "state", "aa", "msa_column", value("emissions", 0, "first"), value("emissions", 19, "last"), value("transitions", 0, "stay"), value("transitions", 6, "leave"))


_NUMBERED = f"(SELECT family, pos, bg::DOUBLE AS v, row_number() OVER (PARTITION BY family ORDER BY pos) - 1 AS k FROM {BACKGROUND})"


@CATALOG.query(f"SELECT kind, family, n, total FROM (SELECT family, count(*) AS n, round(sum(v), 6) AS total FROM {_NUMBERED} GROUP BY 1), (SELECT unnest(['A', 'pi']) AS kind)")
def src_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Array files of families, the kind and the family in the name."""
    files = {}
    for f, rows in _vectors(spark, d).items():
        files |= {f"pi_{f}.npy": _npy([v for _, v in rows]), f"A_{f}.npy": _npy([[v] for _, v in rows])}
    t = S.read_arrays(spark, _put(spark, files))
    return t.select("kind", "family", F.size("values").cast("bigint").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@CATALOG.query(f'SELECT family AS i, family + 100 AS j, r AS "row", k::INT AS col, v + r AS value FROM {_NUMBERED}, (SELECT unnest([0, 1]) AS r)')
def src_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Dense matrix files, both families in the name."""
    files = {f"kl_{f:04d}_{f + 100:04d}.npy": _npy([[v for _, v in rows], [v + 1 for _, v in rows]]) for f, rows in _vectors(spark, d).items()}
    return S.read_matrices(spark, _put(spark, files))


@CATALOG.query(f'SELECT family AS i, family + 100 + r AS j, (k % 2)::INT AS "row", k::INT AS col, v + r AS value FROM {_NUMBERED}, (SELECT unnest([0, 1]) AS r)')
def src_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Sparse archives of a family against two others."""
    files = {}
    for f, rows in _vectors(spark, d).items():
        n, out = len(rows), io.BytesIO()
        at = np.arange(n)
        meta = np.array([[f + 100, 2, n, 0, n], [f + 101, 2, n, n, n]])
        np.savez(out, i=f, meta=meta, rows=np.tile(at % 2, 2), cols=np.tile(at, 2), vals=np.array([v + r for r in (0, 1) for _, v in rows]))
        files[f"sparse_{f}.npz"] = out.getvalue()
    return S.read_sparse(spark, _put(spark, files))


@CATALOG.query(f"SELECT 'F' || family AS family, pos, round(bg::DOUBLE / 100, 9) AS frac FROM {BACKGROUND}")
def src_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage files by family in several folders, percent read as a share."""
    head = "Match_State,MSA_Column,Residue_Count,Total_Seqs,Completeness_Percent\n"
    files = {f"c{f % 4}/F{f}_coverage.csv": (head + "".join(f"{p},{p},1,2,{v!r}\n" for p, v in rows)).encode() for f, rows in _vectors(spark, d).items()}
    return S.read_coverage(spark, _put(spark, files)).select("family", "pos", F.round("frac", 9).alias("frac"))


@CATALOG.query(f"SELECT family || '.csv' AS member, pos, round(bg::DOUBLE, 6) AS bg FROM {BACKGROUND}")
def src_zipped(spark: SparkSession, d: str) -> DataFrame:
    """CSV files inside zip archives."""
    files = {}
    for f, rows in _vectors(spark, d).items():
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{f}.csv", "pos,bg\n" + "".join(f"{p},{v!r}\n" for p, v in rows))
            z.writestr("notes.txt", "none")
        files[f"a{f}.zip"] = out.getvalue()
    t = S.read_zipped_csv(spark, _put(spark, files))
    return t.select("member", F.col("row")["pos"].cast("int").alias("pos"), F.round(F.col("row")["bg"].cast("double"), 6).alias("bg"))


_PF = f"(SELECT global_row_index AS g, main_hmm AS a, sub_hmm AS b FROM {PATHS} WHERE regexp_matches(main_hmm, '^PF[0-9]{{5}}$') AND regexp_matches(sub_hmm, '^PF[0-9]{{5}}$'))"


@CATALOG.query(
    f"SELECT a AS pfam_a, b AS pfam_b, 'x' || g AS pdb, 'A' AS chain, [(g % 400 + 1)::INT, (g % 400 + 2)::INT] AS residues FROM {_PF} UNION ALL SELECT b, a, 'x' || g, 'B', [(g % 300 + 1)::INT] FROM {_PF}"
)
def src_interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces of domain pairs in a flat file, headers carried down the lines, seen from both sides."""
    t = paths(spark, d, F.col("global_row_index").alias("g"), F.col("main_hmm").alias("a"), F.col("sub_hmm").alias("b")).where("a RLIKE '^PF[0-9]{5}$' AND b RLIKE '^PF[0-9]{5}$'")
    line = F.expr("concat('#=ID\\tA\\tB\\t', a, '.3@x\\t', b, '.4@x\\n#=3D\\tx', g, '\\tA:1-90\\tB:3-80\\n10\\tX\\t', g % 400 + 1, '\\t', g % 300 + 1, '\\tm\\n11\\tX\\t', g % 400 + 2, '\\t', g % 300 + 1, '\\tm\\n//')")
    return S.read_interfaces(spark, _text(spark, t.select(line)))


@CATALOG.query(
    "SELECT replace(n_name, ' ', '_') AS main, 'C' || c_custkey AS sub, (c_custkey * 7 % 1000)::DOUBLE / 10 AS probability, '1-' || (c_custkey % 50 + 1) AS main_segment, (c_custkey % 9 + 1) || '-' || (c_custkey % 9 + 20) AS sub_segment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey * 7 % 1000 >= 500"
)
def src_hit_tables(spark: SparkSession, d: str) -> DataFrame:
    """Summary tables of search results, a file per query and 10,000 hits, from a probability on."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    hit = F.format_string("%d C%d some text  %.1f 1E-10 2E-9 50.0 0.0 20 1-%d %d-%d (90)", k % 999 + 1, k, (k * 7 % 1000) / 10, k % 50 + 1, k % 9 + 1, k % 9 + 20)
    files = c.groupBy("n_name", F.expr("c_custkey div 10000").alias("part")).agg(F.array_join(F.array_sort(F.collect_list(hit)), "\n").alias("hits"))
    text = F.concat(F.lit("Query         "), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" made up\nMatch_columns 9\n\n No Hit      Prob E-value\n"), "hits", F.lit("\n\nDone!\n"))
    path = f"{Stage(spark, 'files').root}/hits"
    files.select(text.alias("value")).repartition(25, "value").write.option("lineSep", " ").option("maxRecordsPerFile", 1).text(path)
    return S.read_hit_tables(spark, path, 50.0)


@CATALOG.query(f"SELECT a, b, w FROM {_EDGES}")
def src_single_csv(spark: SparkSession, d: str) -> DataFrame:
    """Parts of all tasks put together to one CSV file with one header, and read back."""
    path = f"{Stage(spark, 'files').root}/one"
    S.write_single_csv(edges(spark, d), path)
    return spark.read.option("header", "true").csv(path).select("a", "b", F.col("w").cast("double").alias("w"))

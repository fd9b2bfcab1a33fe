from __future__ import annotations

import gzip
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.sources import readers as R
from strandloom.sources.tables import resolve_columns


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_and_dense_ids(spark, tmp_path):
    for n in ("a/PF00010.hhm", "b/PF00002.hhm", "z.hhm", "skip/PF00001.hhm", "a/x.txt"):
        put(tmp_path / n, "x")
    t = R.scan_files(spark, str(tmp_path), exclude=["%/skip/%"])
    got = [(r["family_id"], r["name"]) for r in R.dense_ids(t, str(tmp_path)).orderBy("family_id").collect()]
    assert got == [(0, "PF00002"), (1, "PF00010"), (2, "z")]
    put(tmp_path / "c/PF00010.hhm", "x")
    with pytest.raises(ValueError, match="more than once"):
        R.dense_ids(R.scan_files(spark, str(tmp_path)), str(tmp_path))


def test_mapping_and_path_resolution(spark, tmp_path):
    m = R.read_mapping(spark, put(tmp_path / "m.txt", "PF1: 0\nx/y.hhm: 2\nbad: q\nPF1: 5\n\n"))
    assert {(r["name"], r["family_id"]): r["problem"] for r in m.collect()} == {("PF1", 0): "name repeated", ("PF1", 5): "name repeated", ("x/y.hhm", 2): None, ("bad", None): "bad number"}
    m = spark.createDataFrame([("x/y.hhm", 2), ("y", 3), ("q", 4)], "name string, family_id int")
    p = spark.createDataFrame([("/data/root/x/y.hhm",), ("/data/root/k/q.hhm",), ("/data/root/none.hhm",)], "path string")
    assert dict(map(tuple, R.resolve_paths(p, m, "path", "/data/root").collect())) == {"/data/root/x/y.hhm": 2, "/data/root/k/q.hhm": 4, "/data/root/none.hhm": None}


PROFILE = """HHsearch 1.5
NAME  PF00001
LENG  2
#
NULL   {nulls}
HMM    A C D
       M->M M->I M->D I->M I->I D->M D->D Neff
       0 * * 0 * 0 * 1000
M 1    {e1} 7
       10 20 30 40 50 60 70 1 2 3

K 2    {e2} 9
       0 * * 0 * 0 * 1 2 3

//
X 3    ignored
"""


def test_profiles(spark, tmp_path):
    e1, e2 = " ".join(str(100 * i) for i in range(20)), " ".join(["*"] * 20)
    path = put(tmp_path / "p.hhm", PROFILE.format(nulls=" ".join(["3000"] * 20), e1=e1, e2=e2))
    got = {r["state"]: r for r in R.read_profiles(spark, path).collect()}
    assert sorted(got) == [0, 1, 2] and got[1]["family"] == "PF00001"
    assert got[1]["emissions"][3] == 300 and got[1]["msa_column"] == 7 and got[1]["aa"] == "M" and got[1]["transitions"][:7] == [10, 20, 30, 40, 50, 60, 70]
    assert got[2]["emissions"][0] == float("inf") and got[0]["transitions"][1] == float("inf") and got[2]["null_emissions"] == [3000.0] * 20


def test_alignments(spark, tmp_path):
    fa = R.read_alignment(spark, put(tmp_path / "a.fa", ">s1 x\nAC-\nD\n>s2\nAAA-\n"))
    assert {(r["header"], r["sequence"]) for r in fa.collect()} == {("s1 x", "AC-D"), ("s2", "AAA-")}
    sto = R.read_alignment(spark, put(tmp_path / "a.sto", "# STOCKHOLM 1.0\n#=GS s1/1-4 AC P12345.2\ns1/1-4  AC-\ns2  A.C\n\ns1/1-4  DE\ns2  --\n//\n"))
    assert {(r["header"], r["sequence"]) for r in sto.collect()} == {("s1/1-4", "AC-DE"), ("s2", "A.C--")}
    seed = R.read_seed_index(spark, str(tmp_path / "a.sto")).first()
    assert (seed["seed_name"], seed["acc"], seed["start"], seed["end"]) == ("s1", "P12345", 1, 4)


def test_matrices_dense_and_sparse(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    b = io.BytesIO()
    np.save(b, a)
    put(tmp_path / "m/kl_0003_0011.npy", b.getvalue())
    got = R.read_matrices(spark, str(tmp_path / "m")).collect()
    assert {(r["i"], r["j"]) for r in got} == {(3, 11)} and {(r["row"], r["col"]): r["value"] for r in got} == {(i, j): float(a[i, j]) for i in range(2) for j in range(3)}
    z = io.BytesIO()
    np.savez(z, i=np.array(5), meta=np.array([[7, 4, 4, 0, 2], [8, 4, 4, 2, 1]]), rows=np.array([0, 1, 3]), cols=np.array([2, 3, 0]), vals=np.array([0.5, 1.5, 2.5]))
    put(tmp_path / "s/x.npz", z.getvalue())
    assert rows(R.read_sparse(spark, str(tmp_path / "s"))) == [(5, 7, 0, 2, 0.5), (5, 7, 1, 3, 1.5), (5, 8, 3, 0, 2.5)]


def test_points_round_trip_and_pruning(spark, tmp_path):
    t = spark.createDataFrame([(i % 5, i % 3, i, i + 1, float(i)) for i in range(50)], "i int, j int, row int, col int, raw double")
    R.write_points(t, str(tmp_path / "p"), 4)
    assert rows(R.read_points(spark, str(tmp_path / "p"))) == rows(t)
    one = R.read_points(spark, str(tmp_path / "p"), 3, 4)
    assert rows(one) == rows(t.where("i = 3")) and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_pair_lists_and_ranges(spark, tmp_path):
    p = put(tmp_path / "a.csv", "# list\nfamily_j,x,family_i\n2,9,1\n4,9,3\n2,9,1\n")
    assert [tuple(r) for r in R.read_pair_list(spark, p).collect()] == [(1, 2), (3, 4)]
    p = put(tmp_path / "b.txt", "5 6\n7\t8\n")
    assert [tuple(r) for r in R.read_pair_list(spark, p).collect()] == [(5, 6), (7, 8)]
    assert rows(R.expand_ranges(spark, 0, 2, 1, 2, True)) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    assert R.expand_ranges(spark, 0, 2, 1, 2).count() == 6
    want, have = spark.createDataFrame([(1, 2), (3, 4)], "i int, j int"), spark.createDataFrame([(1, 2)], "i int, j int")
    assert rows(R.missing_outputs(want, have, ["i", "j"])) == [(3, 4)]


def test_backgrounds_and_coverage(spark, tmp_path):
    p = put(tmp_path / "bg.json", json.dumps({"PF1": [1.5, 2.5], "7": [3.0], "what": [1.0]}, indent=1))
    m = spark.createDataFrame([("PF1", 0)], "name string, family_id int")
    assert rows(R.read_backgrounds(spark, p, m)) == [(0, 1, 1.5), (0, 2, 2.5), (7, 1, 3.0)]
    put(tmp_path / "c/x/PF1_coverage.csv", "Match_State,MSA_Column,Residue_Count,Total_Seqs,Completeness_Percent\n1,1,5,10,50.0\n2,2,10,10,100\n")
    assert rows(R.read_coverage(spark, str(tmp_path / "c"))) == [("PF1", 1, 0.5), ("PF1", 2, 1.0)]


def test_csv_encodings_and_columns(spark, tmp_path):
    a = R.read_csv_fallback(spark, put(tmp_path / "u.csv", "﻿ Main_HMM ,Score\nx,1\n"))
    assert a.columns == ["Main_HMM", "Score"] and rows(a) == [("x", "1")]
    b = R.read_csv_fallback(spark, put(tmp_path / "g.csv", "名称,b\n家族,2\n", "gbk"))
    assert b.columns == ["名称", "b"] and rows(b) == [("家族", "2")]
    with pytest.raises(ValueError, match="missing columns"):
        resolve_columns(a, {"length": ["len"]})
    assert rows(resolve_columns(a, {"hmm": ["main_hmm"], "n": ["n"]}, {"n": "int"})) == [("x", None)]


def test_related_tables(spark, tmp_path):
    hits = spark.createDataFrame([(1, "OK"), (2, "FAIL")], "obs_id int, status string")
    R.write_observations(hits, spark.createDataFrame([(1, 0.5), (2, 0.7)], "obs_id int, v double"), str(tmp_path / "db"))
    h, w = R.read_observations(spark, str(tmp_path / "db"))
    assert rows(h) == [(1, "OK")] and rows(w) == [(1, 0.5)]


def test_interfaces(spark, tmp_path):
    text = "#=ID\tA\tB\tPF00001.3@x\tPF00002.4@x\n#=3D\t1abc\tA:1-90\tB:3-80\n10\tX\t12\t33\tm\n11\tX\t13\t33\tm\n//\n"
    p = put(tmp_path / "f.gz", gzip.compress(text.encode()))
    assert rows(R.read_interfaces(spark, p)) == [("PF00001", "PF00002", "1abc", "A", [12, 13]), ("PF00002", "PF00001", "1abc", "B", [33])]


def test_regions_and_experiments(spark, tmp_path):
    p = put(tmp_path / "d.tsv", "UniProt ACC\tRegion ID\tStart\tEnd\nP1.2\tr1\t9\t3\nP2\tr2\tx\t3\n")
    assert rows(R.read_regions(spark, p)) == [("P1", "r1", 3, 9, None)]
    x = put(tmp_path / "e.xml", "<all><entry id='P1'><residue kind='fold' strength='early'>4</residue><residue kind='fold' strength='early'>2</residue><residue kind='stab' strength='weak'>7</residue></entry></all>")
    assert rows(R.read_experiments(spark, x)) == [("P1", "Fold_EARLY", [2, 4]), ("P1", "Stab_WEAK", [7])]


def test_residue_mappings(spark, tmp_path):
    m = {"entity_id": 1, "chain_id": "A", "unp_start": 5, "unp_end": 9, "start": {"author_residue_number": 15, "residue_number": 1, "author_insertion_code": ""}, "end": {"author_residue_number": None, "residue_number": 5, "author_insertion_code": ""}}
    r = R.read_residue_mappings(spark, put(tmp_path / "m.json", json.dumps({"1abc": {"UniProt": {"P1-2": {"mappings": [m]}}}}))).first()
    assert (r["pdb_id"], r["uniprot_ac_base"], r["chain_id"], r["auth_start"], r["auth_end"], r["res_end"], r["unp_end"]) == ("1abc", "P1", "A", 15, None, 5, 9)


HITS = """Query         {q}
Match_columns 9

 No Hit                             Prob E-value P-value  Score    SS Cols Query HMM  Template HMM
  1 {h} some text   98.5 1E-10   2E-9   50.0   0.0   20    1-20     3-22 (90)
  2 {q} itself      99.0 1E-10   2E-9   50.0   0.0   20    1-20     1-20 (90)
  3 PF9 weak        10.0 1E-10   2E-9   50.0   0.0   20    1-20     1-20 (90)

Done!
"""


def test_hit_tables(spark, tmp_path):
    put(tmp_path / "h/a.hhr", HITS.format(q="PF1", h="PF2"))
    put(tmp_path / "h/b.hhr", HITS.format(q="PF2", h="PF1"))
    assert rows(R.read_hit_tables(spark, str(tmp_path / "h"), 50.0)) == [("PF1", "PF2", 98.5, "1-20", "3-22")]


def test_records_probabilities_atoms_zip(spark, tmp_path):
    p = put(tmp_path / "r.txt", ">id1|x\nfrag_dom=1-5,9-12\nACDE\n>id2|y\nfrag_dom=\nKK\n")
    assert rows(R.read_fragment_records(spark, p)) == [("id1|x", "1-5,9-12", "ACDE"), ("id2|y", "", "KK")]
    line = lambda h, i, v: "\t".join([h, str(i), "A", *[str(v)] * 20])
    p = put(tmp_path / "p.tsv", "\n".join([line("h", 1, 0.1), line("h", 1, 0.2), line("h", 2, 0.3)]))
    assert sorted(r["probabilities"][0] for r in R.read_position_probabilities(spark, p).collect()) == [0.1, 0.3]
    assert sorted(r["probabilities"][0] for r in R.read_position_probabilities(spark, p, "last").collect()) == [0.2, 0.3]
    with pytest.raises(ValueError):
        R.read_position_probabilities(spark, p, "error")
    atom = "ATOM      1  CA AALA A  12A     11.104   6.134  -6.504  1.00  0.00           C"
    p = put(tmp_path / "x.pdb", "\n".join([atom, atom.replace("AALA", "BALA"), atom.replace("ATOM  ", "HETATM")]))
    assert [tuple(r)[1:] for r in R.read_atoms(spark, p, "A").collect()] == [("A", 12, "A", "ALA", "CA", 11.104, 6.134, -6.504)]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/a.csv", "﻿x,y\n1,2\n")
        f.writestr("in/readme.txt", "no")
    r = R.read_zipped_csv(spark, put(tmp_path / "z.zip", z.getvalue())).first()
    assert r["member"] == "in/a.csv" and r["row"] == {"x": "1", "y": "2"}


def test_sinks(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a<",), ("b",)], "node string"), spark.createDataFrame([("a<", "b", 1.5)], "a string, b string, w double")
    R.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "g/edges")).count() == 1
    text = "".join(r["line"] for r in R.graphml_lines(nodes, edges, "node", "a", "b", "w").orderBy("part").collect())
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(text)[1]) == 3
    R.write_single_csv(edges.repartition(3), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1
    R.write_manifest(spark, str(tmp_path / "man"), {"status": "completed", "n": "3"})
    assert R.read_manifest(spark, str(tmp_path / "man")).first()["entries"] == {"status": "completed", "n": "3"}


def test_texts_inside_tables(spark):
    df = spark.createDataFrame([(1, "HMM  PF92567  LENG 157\nW 1\t" + "\t".join(["4678", "*"] * 10) + "\nL 2\tbroken"), (2, ">a b\nAC\nDE\n>c\nKK"), (3, None), (4, "")], "k int, text string")
    r = R.profile_dumps(df, "k", "text").collect()
    assert len(r) == 1 and r[0]["family"] == "PF92567" and r[0]["emissions"][:2] == [4678.0, float("inf")]
    assert rows(R.sequence_records(df, "k", "text")) == [(2, 0, "a b", "ACDE"), (2, 1, "c", "KK")]
    assert F.lit(1) is not None


def test_atoms_of_all_ids_and_labels(spark, tmp_path):
    from strandloom.plans.source_queries import src_atoms

    rows = [(v, label, [0.5, -0.25, 0.125]) for v, label in ((0, 0), (9999, 25), (10000, 0), (25001, 26), (123456, 300))]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in src_atoms(spark, str(tmp_path)).collect())
    assert got == [(v, chr(65 + label), 50.0) for v, label, _ in rows]

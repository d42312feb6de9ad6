"""Readers and converters on small files written here."""

import pytest
from pyspark.sql import functions as F

from allelo import config
from allelo.operators import frequencies as fr
from allelo.sources import converters, native, newick, tables


def put(tmp_path, text, name="f.txt"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_header_and_sites():
    h = native.parse_header("2 10 . some title")
    assert (h.pops, h.loci, h.delimiter, h.title) == (2, 10, ".", "some title")
    assert native.parse_header("s 2 5 name").kind == "s"
    with pytest.raises(ValueError):
        native.parse_header("<xml>")
    parts = native.parse_sites("(s200 s800) (s500) x=n10")
    assert [(p.locus, p.sublocus, p.kind, p.length, p.name) for p in parts] == [(1, 1, "s", 200, None), (1, 2, "s", 800, None), (2, 1, "s", 500, None), (3, 1, "n", 10, "x")]
    assert native.parse_models(["#$ 1 s TN 2.0 3.0"]) == {1: ("TN", [2.0, 3.0])}
    assert native.parse_repeats(["# note @M", "#@M 2 3 4"]) == [2, 3, 4]


def test_alleles(spark, tmp_path):
    path = put(tmp_path, "2 2 / test\n# a comment\n2 first\nA         1/2 3\n?B        ?/2 4/4\n1 second one\nC         5/5 6/7\n")
    rows = {(r.pop, r.ind_name, r.locus, r.copy): (r.value, r.unassigned) for r in native.read_genotypes(spark, path).collect()}
    assert len(rows) == 12
    assert rows[1, "A", 2, 1] == rows[1, "A", 2, 2] == ("3", False)
    assert rows[1, "B", 1, 1] == (None, True) and rows[2, "C", 2, 2] == ("7", False)


def test_sequences(spark, tmp_path):
    path = put(tmp_path, "2 2 seqs\n(s3 s2) (s4)\n1 p\nA         ACGTT ACGT\n1 q\nB         AC?NN TTTT\n")
    d = native.read_genotypes(spark, path)
    assert {(r.pop, r.locus, r.sublocus): r.value for r in d.collect()} == {(1, 1, 1): "ACG", (1, 1, 2): "TT", (1, 2, 1): "ACGT", (2, 1, 1): "AC?", (2, 1, 2): "NN", (2, 2, 1): "TTTT"}
    s = native.explode_sites(d)
    assert s.count() == 18 and s.where("value is null").count() == 3


def test_hapmap_counts(spark, tmp_path):
    good = put(tmp_path, "h 1 1 x\n3 P\n10\tG\t2\tC\t1\t3\n")
    assert native.read_genotypes(spark, good).groupBy("value").count().count() == 2
    bad = put(tmp_path, "h 1 1 x\n3 P\n10\tG\t2\tC\t2\t3\n", "bad.txt")
    with pytest.raises(Exception, match="do not add up"):
        native.read_genotypes(spark, bad).collect()


def test_spectrum_of_published_counts(spark):
    # Copies of each allele in two populations, and the heterozygosities printed for them.
    first = {"16": 11, "19": 2, "18": 3, "15": 11, "21": 1, "23": 1, "17": 14, "22": 3, "25": 3, "24": 1}
    second = {"16": 7, "19": 3, "18": 5, "15": 1, "21": 7, "23": 5, "17": 4, "22": 5, "25": 1, "26": 1, "27": 2, "29": 1}
    rows = [(p, 1, v) for p, counts in ((1, first), (2, second)) for v, n in counts.items() for _ in range(n)]
    s = fr.allele_spectrum(spark.createDataFrame(rows, "pop int, locus int, value string"), "pop", "locus", "value")
    assert {r["pop"]: round(r["h_exp"], 3) for r in fr.expected_heterozygosity(s, "pop", "locus").collect()} == {1: 0.811, 2: 0.883}
    assert {r["pop"]: round(r["freq"], 3) for r in s.where("value = '16'").collect()} == {1: 0.220, 2: 0.167}


def test_tabs_and_an_empty_population(spark, tmp_path):
    d = native.read_genotypes(spark, put(tmp_path, "3\t2\t. a title\n1\tfirst\nA         \t16.19\t20\n0 none\n1 last\nB\t        \t?.19\t21.20\n"))
    assert {(r.pop, r.locus, r.copy): r.value for r in d.collect()} == {
        (1, 1, 1): "16", (1, 1, 2): "19", (1, 2, 1): "20", (1, 2, 2): "20", (3, 1, 1): None, (3, 1, 2): "19", (3, 2, 1): "21", (3, 2, 2): "20",
    }


def test_dates(spark, tmp_path):
    d = tables.read_dates(spark, put(tmp_path, "2 1\n2 P 0\nA         1.5\nB         0.0\n1 Q\nC         3\n"))
    assert sorted((r.pop, r.ind_name, r.date) for r in d.collect()) == [(1, "A", 1.5), (1, "B", 0.0), (2, "C", 3.0)]


def test_distances_weights_samples(spark, tmp_path):
    m = put(tmp_path, "2\nA          0.0 0.0\nB          2.0 0.0\n")
    assert {(r.i, r.j): r.d for r in tables.read_distances(spark, m).collect()} == {(1, 1): 0.0, (1, 2): 1e-6, (2, 1): 2.0, (2, 2): 0.0}
    w = put(tmp_path, "10 A\n2\n", "w.txt")
    assert [(r.site, r.value) for r in tables.read_site_values(spark, w).orderBy("site").collect()] == [(1, 1), (2, 0), (3, 10), (4, 2)]
    s = put(tmp_path, "# note\nSteps\tLocus\tReplicate\tlnPost\tT1\n10\t1\t1\t-3.5\t0.1\n\n20\t1\t1\t-3.0\t0.2\n10\t2\t1\t-1\t0.3\n", "s.txt")
    d = tables.read_samples(spark, s)
    assert d.count() == 3 and tables.long_samples(d, ["T1"]).count() == 3
    work = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "locus int, replicate int")
    assert sorted(map(tuple, tables.remaining_work(work, d, 3).collect())) == [(2, 1), (3, 1)]
    assert sorted(r["Locus"] for r in tables.merge_samples(d, d).collect()) == [1, 1, 2, 3, 3, 4]
    tables.write_samples(d, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_fasta_and_stacks(spark, tmp_path):
    p = put(tmp_path, ">a one\nACG\nTT\n>b\nGG\n")
    assert [(r.name, r.seq) for r in converters.read_fasta(spark, p).orderBy("nr").collect()] == [("a one", "ACGTT"), ("b", "GG")]
    p = put(tmp_path, ">CLocus_7_Sample_3_Locus_9_Allele_1 [JoJo_s1.fq; g, 4, +]\nACGNN\n>CLocus_7_Sample_4_Locus_9_Allele_0 [JoJo_s2.fq; g, 4, +]\nACGTN\n", "s.fa")
    r = converters.stacks_loci(converters.read_stacks(spark, p)).collect()
    assert [(x.pop_name, x.locus, x.n, x.length) for x in r] == [("JoJo", 7, 2, 4)]


def test_structure_and_exports(spark, tmp_path):
    p = put(tmp_path, "x 1 100 7\nx 1 104 -9\ny 2 108 7\ny 2 100 9\n")
    d = converters.read_structure(spark, p, 2)
    assert {r.locus: r.unit for r in converters.repeat_length(d).collect()} == {1: 4, 2: 2}
    long = d.withColumn("pop_name", F.col("pop")).withColumn("pop", F.col("pop").cast("int")).withColumn("ind", F.lit(1))
    lines = [r.line.rstrip() for r in converters.native_lines(long, "t").collect()]
    assert lines == [" 2 2 . t", "1 1", "x         100.104 7.?", "1 2", "y         108.100 7.9"]
    back = native.read_genotypes(spark, put(tmp_path, "\n".join(lines) + "\n", "back.txt"))
    assert back.count() == 8 and back.where("value is null").count() == 1
    assert converters.structure_rows(long).count() == 4
    assert {tuple(r) for r in converters.lfmm_rows(long).collect()} == {("x", 1, 9), ("y", 0, 1)}
    assert [tuple(r) for r in converters.treemix_rows(long).collect()] == [(2, "1,0", "1,1")]
    assert converters.arlequin_rows(long).count() == converters.phylip_rows(long).count() == 4
    assert converters.gphocs_blocks(long).count() == 2


def test_vcf_depth(spark, tmp_path):
    p = put(tmp_path, "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nun\t7\tL1\tC\tT\t.\tPASS\t.\tGT:DP\t0/0:12\t0/1:3\n")
    d = converters.read_vcf_depth(spark, p)
    assert {(r.ind, r.depth) for r in d.collect()} == {("a", 12), ("b", 3)}
    g = spark.createDataFrame([("a", "L1"), ("b", "L1")], "ind string, locus string")
    assert [r.ind for r in converters.deep_enough(g, d, 5).collect()] == ["a"]


def test_trees(spark):
    text = "((a:0.1,b:0.1):0.2 [&M 1 2:0.05],c:0.35);"
    edges = newick.parse(text)
    kinds = sorted(e["type"] for e in edges)
    assert kinds == ["i", "i", "m", "t", "t", "t"]
    assert {e["name"]: round(e["time"], 6) for e in edges if e["type"] == "t"} == {"a": 0.0, "b": 0.0, "c": 0.0}
    again = newick.parse(newick.write(edges))
    assert [(e["type"], round(e["time"], 6)) for e in again] == [(e["type"], round(e["time"], 6)) for e in edges]
    d = newick.edges_of_trees(spark.createDataFrame([(1, text), (2, "(x:1,y:1);")], "tree long, text string"))
    assert d.count() == 9
    assert {r.tree for r in newick.trees_of_edges(d).collect()} == {1, 2}


def test_options_round_trip():
    o = config.parse("# c\nlong-sample=10\nheating=ADAPTIVE:1:{1.0,1.5}\nnodata=YES\nunknown-key=7\nbayes-priors=THETA * * UNIFORM: 0,0.1\nend\nignored=1\n")
    assert (o.long_sample, o.nodata, o.other) == (10, True, {"unknown-key": "7"})
    assert config.parse(config.write(o)) == o


def test_interleaved(spark):
    lines = spark.createDataFrame([(0, "A         ACG"), (1, "B         TT "), (2, "TT"), (3, "GG C")], "nr long, line string")
    assert sorted(map(tuple, native.join_interleaved(lines, 2).collect())) == [(1, "A", "ACGTT"), (2, "B", "TTGGC")]


def test_interleaved_file_and_loci(spark, tmp_path):
    text = "2 2 seqs\n#$ 1 s TN 2.0 3.5\n(s3 s2) (s4)\n2 p\nA         ACG\n?B        AAA\nTTAC\nCCCC\nGT\nGG\n1 q\n7         AC?NN\nTTTT\n"
    path = put(tmp_path, text)
    d = native.read_genotypes(spark, path, interleaved=True)
    assert {(r.pop, r.ind_name, r.unassigned, r.locus, r.sublocus): r.value for r in d.collect()} == {
        (1, "A", False, 1, 1): "ACG", (1, "A", False, 1, 2): "TT", (1, "A", False, 2, 1): "ACGT",
        (1, "B", True, 1, 1): "AAA", (1, "B", True, 1, 2): "CC", (1, "B", True, 2, 1): "CCGG",
        (2, "7", False, 1, 1): "AC?", (2, "7", False, 1, 2): "NN", (2, "7", False, 2, 1): "TTTT",
    }
    loci = native.read_loci(spark, path).orderBy("locus", "sublocus").collect()
    assert [(r.locus, r.sublocus, r.n_sites, r.model, r.params) for r in loci] == [(1, 1, 3, "TN", [2.0, 3.5]), (1, 2, 2, None, []), (2, 1, 4, None, [])]
    path = put(tmp_path, "1 2 . x\n#@M 2 3\n2 P\n11        1.2 3.3\n12        1.2 ?.3\n", "m.txt")
    assert [r.repeat_unit for r in native.read_loci(spark, path).orderBy("locus").collect()] == [2, 3]
    assert native.read_genotypes(spark, path).count() == 8


def test_a_missing_population_line(spark, tmp_path):
    with pytest.raises(ValueError, match="not a population line"):
        native.read_genotypes(spark, put(tmp_path, "2 1 . x\n1 P\nA         1.2\nB         1.2\n"))

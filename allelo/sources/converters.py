"""Foreign genotype formats, in and out of the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lines import numbered, stripped


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(nr, name, seq, file): records in order; a record's lines are joined by the number of header lines before them."""
    d = numbered(spark, path)
    chunk = F.floor(F.col("nr") / 4096)
    head = F.col("line").startswith(">").cast("int")
    d = d.withColumn("_c", chunk)
    per = d.groupBy("_c").agg(F.sum(head).alias("_h"))
    before = F.coalesce(F.sum("_h").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(per.select("_c", before.alias("_b")), "_c")
    d = d.withColumn("_r", F.col("_b") + F.sum(head).over(W.partitionBy("_c").orderBy("nr")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nr", "line"))), lambda x: x["line"])
    d = d.groupBy("_r").agg(lines.alias("l"))
    return d.select(F.col("_r").alias("nr"), F.substring(F.col("l")[0], F.lit(2), F.length(F.col("l")[0])).alias("name"), F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), F.trim), "").alias("seq"))


def read_fastas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One population each file, named after it."""
    out = None
    for i, p in enumerate(paths, 1):
        d = read_fasta(spark, p).withColumn("pop", F.lit(i)).withColumn("pop_name", F.lit(p.rsplit("/", 1)[-1].rsplit(".", 1)[0]))
        out = d if out is None else out.unionByName(d)
    return out


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """Headers ``CLocus_n_Sample_n_Locus_n_Allele_n [individual; group, position, strand]`` with one sequence each."""
    d = read_fasta(spark, path)
    part = lambda p, i=1: F.regexp_extract("name", p, i)
    return d.select(
        part(r"CLocus_(\d+)").cast("int").alias("locus"), part(r"Sample_(\d+)").cast("int").alias("sample"), part(r"Allele_(\d+)").cast("int").alias("copy"),
        part(r"\[([^_;\]]*)_?").alias("pop_name"), part(r"\[([^;\]]*)").alias("ind_name"), "seq",
    )


def stacks_loci(d: DataFrame) -> DataFrame:
    """Per population and locus: sequences, and the used length (to the last first N of any)."""
    end = F.instr("seq", "N")
    return d.groupBy("pop_name", "locus").agg(F.count("*").alias("n"), F.max(F.when(end > 0, end - 1).otherwise(F.length("seq"))).alias("length"))


def read_structure(spark: SparkSession, path: str, loci: int, missing: str = "-9") -> DataFrame:
    """Two rows an individual (name, population, values) -> (ind_name, pop, locus, copy, value)."""
    d = numbered(spark, path).withColumn("w", F.split(stripped("line"), r"\s+")).where(F.size("w") >= loci + 2)
    copy = F.row_number().over(W.partitionBy(F.col("w")[0]).orderBy("nr"))
    d = d.withColumn("copy", copy)  # before the rows are exploded
    d = d.select(F.col("w")[0].alias("ind_name"), F.col("w")[1].alias("pop"), "copy", F.posexplode(F.slice("w", 3, loci)).alias("_l", "v"))
    return d.select("ind_name", "pop", (F.col("_l") + 1).alias("locus"), "copy", F.when(F.col("v") != missing, F.col("v")).alias("value"))


def repeat_length(d: DataFrame) -> DataFrame:
    """Mean gap between the sorted different values of each locus, at least 1, rounded."""
    v = d.where("value is not null").select("locus", F.col("value").cast("long").alias("v")).distinct()
    gap = F.col("v") - F.lag("v").over(W.partitionBy("locus").orderBy("v"))
    return v.withColumn("g", gap).groupBy("locus").agg(F.greatest(F.round(F.avg("g")), F.lit(1)).cast("int").alias("unit"))


def read_vcf_depth(spark: SparkSession, path: str) -> DataFrame:
    """(locus, pos, individual, genotype, depth) of a VCF with GT:DP first."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()[0]["value"].split("\t")
    d = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("w"))
    cells = F.array(*[F.struct(F.lit(n).alias("ind"), F.col("w")[i + 9].alias("c")) for i, n in enumerate(head[9:])])
    d = d.select(F.col("w")[2].alias("locus"), F.col("w")[1].cast("long").alias("pos"), F.explode(cells).alias("x"))
    return d.select("locus", "pos", F.col("x.ind").alias("ind"), F.split("x.c", ":")[0].alias("genotype"), F.split("x.c", ":")[1].cast("int").alias("depth"))


def deep_enough(d: DataFrame, depth: DataFrame, least: int) -> DataFrame:
    """Rows of (ind, locus) with a depth of ``least`` or more."""
    good = depth.groupBy("ind", "locus").agg(F.max("depth").alias("depth")).where(F.col("depth") >= least).select("ind", "locus")
    return d.join(good, ["ind", "locus"], "left_semi")


def haplotype_numbers(d: DataFrame, order: str = "ind_name") -> DataFrame:
    """Different values of each locus as numbers in the order of their first appearance."""
    seen = d.where("value is not null").groupBy("locus", "value").agg(F.min(order).alias("_f"))
    n = F.row_number().over(W.partitionBy("locus").orderBy("_f", "value"))
    return d.join(seen.select("locus", "value", n.alias("hap")), ["locus", "value"], "left")


def _genotype(sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("copy", F.coalesce("value", F.lit("?")).alias("v")))), lambda x: x["v"]), sep)


def _loci(d: DataFrame) -> list:
    return [r["locus"] for r in d.select("locus").distinct().orderBy("locus").collect()]  # columns of the result


def native_lines(d: DataFrame, title: str = "", delimiter: str = ".") -> DataFrame:
    """Lines (nr, line) of a native file of alleles, sorted by ``nr``."""
    loci = _loci(d)
    wide = d.groupBy("pop", "pop_name", "ind", "ind_name", "locus").agg(_genotype(delimiter).alias("g")).groupBy("pop", "pop_name", "ind", "ind_name").pivot("locus", loci).agg(F.first("g"))
    people = wide.select("pop", F.col("ind").cast("long").alias("ind"), F.concat(F.rpad("ind_name", 10, " "), F.concat_ws(" ", *[F.coalesce(F.col(str(x)), F.lit(f"?{delimiter}?")) for x in loci])).alias("line"))
    heads = wide.groupBy("pop", "pop_name").agg(F.count("*").alias("n")).select("pop", F.lit(0).cast("long").alias("ind"), F.concat_ws(" ", "n", "pop_name").alias("line"))
    first = wide.agg(F.countDistinct("pop").alias("n")).select(F.lit(0).alias("pop"), F.lit(0).cast("long").alias("ind"), F.concat(F.lit(" "), F.col("n"), F.lit(f" {len(loci)} {delimiter} {title}")).alias("line"))
    return first.unionByName(heads).unionByName(people).select(F.struct("pop", "ind").alias("nr"), "line").orderBy("nr")


def structure_rows(d: DataFrame) -> DataFrame:
    """Two rows an individual, haplotypes as numbers, -9 missing: (ind_name, pop, copy, one column a locus)."""
    h = haplotype_numbers(d)
    return h.groupBy("ind_name", "pop", "copy").pivot("locus", _loci(d)).agg(F.first(F.coalesce("hap", F.lit(-9))))


def lfmm_rows(d: DataFrame) -> DataFrame:
    """Per individual and locus the number of copies of the locus' second allele (9 missing), one column a locus."""
    h = haplotype_numbers(d)
    g = h.groupBy("ind_name", "locus").agg(F.when(F.count("hap") < F.count("*"), F.lit(9)).otherwise(F.sum((F.col("hap") == 2).cast("int"))).alias("g"))
    return g.groupBy("ind_name").pivot("locus", _loci(d)).agg(F.first("g"))


def treemix_rows(d: DataFrame) -> DataFrame:
    """Per biallelic locus one column a population with ``count of the first,count of the second``."""
    h = haplotype_numbers(d).where("hap is not null")
    two = h.groupBy("locus").agg(F.max("hap").alias("m")).where("m = 2").select("locus")
    count = lambda k: F.sum((F.col("hap") == k).cast("int")).cast("string")
    g = h.join(two, "locus", "left_semi").groupBy("locus", "pop").agg(F.concat_ws(",", count(1), count(2)).alias("g"))
    pops = [r["pop"] for r in d.select("pop").distinct().orderBy("pop").collect()]  # columns of the result
    return g.groupBy("locus").pivot("pop", pops).agg(F.first("g")).na.fill("0,0")


def phylip_rows(d: DataFrame) -> DataFrame:
    """Concatenated sequences over the loci for each individual and copy (loci in order)."""
    s = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locus", F.coalesce("value", F.lit("?")).alias("v")))), lambda x: x["v"]), "")
    return d.groupBy("ind_name", "copy").agg(s.alias("seq")).select(F.rpad(F.concat_ws("_", "ind_name", "copy"), 10, " ").alias("name"), "seq")


def arlequin_rows(d: DataFrame) -> DataFrame:
    """(pop, ind_name, copy, line): two lines an individual, the first with its name and count 1."""
    s = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locus", F.coalesce("value", F.lit("?")).alias("v")))), lambda x: x["v"]), "\t")
    d = d.groupBy("pop", "ind_name", "copy").agg(s.alias("s"))
    return d.select("pop", "ind_name", "copy", F.when(F.col("copy") == 1, F.concat_ws("\t", "ind_name", F.lit("1"), "s")).otherwise(F.concat(F.lit("\t\t"), F.col("s"))).alias("line"))


def gphocs_blocks(d: DataFrame) -> DataFrame:
    """(locus, block): a header ``locus individuals length`` and a line for each individual."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ind_name", "copy", "value"))), lambda x: F.concat_ws(" ", F.concat_ws("_", x["ind_name"], x["copy"]), F.coalesce(x["value"], F.lit("N"))))
    g = d.groupBy("locus").agg(rows.alias("r"), F.max(F.length("value")).alias("n"))
    return g.select("locus", F.concat(F.concat_ws(" ", F.concat(F.lit("locus"), F.col("locus")), F.size("r"), "n"), F.lit("\n"), F.array_join("r", "\n")).alias("block"))

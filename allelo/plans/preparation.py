"""Queries on genotype preparation: q01 to q16, q41 to q46, q64, q65, q70, q71."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indexing import first_rate, rate_index, rate_source, rate_target
from ..operators import events as ev
from ..operators import frequencies as fr
from ..operators import sequences as sq
from ..store import stored
from .common import rounded, table

# Bases with the weight that an (ambiguous) symbol gives each.
AMBIGUITY = {"a": "a", "c": "c", "g": "g", "t": "t", "u": "t", "r": "ag", "y": "ct", "m": "ac", "k": "gt", "s": "cg", "w": "at", "b": "cgt", "d": "agt", "h": "act", "v": "acg"}


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("pop"), F.col("l_linestatus").alias("locus"), F.col("l_quantity").alias("allele"))


def q01_freq_spectrum(spark, sf):
    return rounded(fr.allele_spectrum(_lineitem(spark, sf), "pop", "locus", "allele"))


def q02_spectrum_total(spark, sf):
    return rounded(fr.allele_spectrum_with_total(_lineitem(spark, sf), "pop", "locus", "allele"))


def q03_allele_counts(spark, sf):
    return fr.allele_counts(_lineitem(spark, sf), "pop", "locus", "allele")


def _orders_spectrum(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = o.join(c, o["o_custkey"] == c["c_custkey"])
    d = d.select(F.col("c_nationkey").alias("pop"), F.col("o_orderstatus").alias("locus"), F.col("o_orderpriority").alias("allele"))
    return fr.allele_spectrum(d, "pop", "locus", "allele")


def q04_expected_het(spark, sf):
    return rounded(fr.expected_heterozygosity(_orders_spectrum(spark, sf), "pop", "locus"))


def q05_avg_het(spark, sf):
    return rounded(fr.mean_heterozygosity(fr.expected_heterozygosity(_orders_spectrum(spark, sf), "pop", "locus"), "pop"))


def q06_gene_copies(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("pop"), F.col("l_linestatus").alias("locus"), F.nullif("l_discount", F.lit(0.0)).alias("copy"))
    return fr.gene_copies(d, "pop", "locus", "copy")


def q07_base_freq(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("locus"), F.explode(F.split(F.lower("text"), "")).alias("symbol"))
    rows = [(s, b, 1.0 / len(bs)) for s, bs in AMBIGUITY.items() for b in bs]
    return rounded(fr.base_frequencies(d, "locus", "symbol", spark.createDataFrame(rows, "symbol string, base string, w double")).drop("w"), 10)


_BASES = "acgt"
EM_STEPS = 4


def q83_em_base_freq(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("locus"), F.explode(F.split(F.lower("text"), "")).alias("symbol"))
    counts = d.groupBy("locus", "symbol").agg(F.count("*").alias("n"))
    masks = spark.createDataFrame([(s, [float(b in bs) for b in _BASES]) for s, bs in AMBIGUITY.items()], "symbol string, mask array<double>")
    f = fr.em_frequencies(counts, "locus", "symbol", "n", masks, EM_STEPS)
    return rounded(f.select("locus", F.posexplode("f").alias("i", "freq")).select("locus", F.element_at(F.array(*map(F.lit, _BASES)), F.col("i") + 1).alias("base"), "freq"), 9)


def q84_weighted_draws(spark, sf):
    return fr.weighted_subset(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_custkey", "c_acctbal", 5, "draws")


def _brand_sites(spark, sf):
    p = table(spark, sf, "part").select("p_size", "p_partkey", F.rpad("p_brand", 8, "?").alias("seq"))
    return sq.sites(p, ["p_size", "p_partkey"], "seq")


def q08_segregating(spark, sf):
    return sq.segregating_sites(_brand_sites(spark, sf), "p_size")


def q09_watterson(spark, sf):
    n = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    d = sq.watterson(q08_segregating(spark, sf).join(n, "p_size"), "segregating", "n")
    return rounded(sq.relative_rates(d, F.col("theta"), F.col("n_sites")), 7)


def _long_sites(spark, sf):
    p = table(spark, sf, "part").select("p_size", "p_partkey", F.rpad(F.concat("p_brand", "p_type"), 40, "?").alias("seq"))
    return sq.sites(p, ["p_size", "p_partkey"], "seq")


def q10_site_patterns(spark, sf):
    return sq.site_patterns(_long_sites(spark, sf), "p_size", "p_partkey")


def q64_pooled_het(spark, sf):
    return rounded(fr.pooled_heterozygosity(_orders_spectrum(spark, sf), "locus", "allele"))


def q65_site_to_pattern(spark, sf):
    return sq.site_to_pattern(_long_sites(spark, sf), "p_size", "p_partkey")


def q70_allele_index(spark, sf):
    d = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    known = fr.first_seen_index(d.where("o_orderpriority <> '5-LOW'"), ["o_orderstatus"], "o_orderpriority", "o_orderkey")
    return fr.allele_index(d, ["o_orderstatus"], "o_orderpriority", known)


def q71_sequence_differences(spark, sf):
    return sq.pairwise_arrays(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", sq.text_differences, "int")


def q11_random_subset(spark, sf):
    return fr.random_subset(table(spark, sf, "customer").select("c_nationkey", "c_name", "c_custkey"), ["c_nationkey"], "c_name", 5, "17")


def q12_relabel(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pop"), F.col("n_regionkey").alias("new_pop"))
    d = table(spark, sf, "customer").select(F.col("c_nationkey").alias("pop"), F.lit(1).alias("locus"), F.col("c_mktsegment").alias("allele"))
    return rounded(fr.allele_spectrum(fr.relabel(d, "pop", nation, "new_pop"), "pop", "locus", "allele"))


def q13_filter_cascade(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ind"), F.col("l_linenumber").alias("locus"), F.col("l_returnflag").alias("allele")).distinct()
    d = d.withColumn("pop", F.col("ind") % 5)
    d = fr.drop_rare_alleles(stored(d), "locus", "allele", "pop", 0.2, 0.6)  # filters look at their input several times
    # missing data: a population and locus has as many individuals as the population; a locus all; an individual all loci.
    # A row for each individual and locus, so that every filter is a count; what each keeps is a small table.
    d = stored(d.groupBy("pop", "ind", "locus").agg(F.collect_set("allele").alias("alleles")))
    need = d.groupBy("pop").agg(F.countDistinct("ind").alias("need"))
    enough = 1 - F.col("have") / F.col("need") <= 0.3
    kept = d.groupBy("pop", "locus").agg(F.count("*").alias("have")).join(need, "pop").where(enough)
    d = d.join(stored(kept.select("pop", "locus")), ["pop", "locus"], "left_semi")
    everyone = d.agg(F.countDistinct("ind").alias("need"))
    kept = d.groupBy("locus").agg(F.count("*").alias("have")).crossJoin(F.broadcast(everyone)).where(enough)  # one row
    d = d.join(stored(kept.select("locus")), "locus", "left_semi")
    n_loci = d.agg(F.countDistinct("locus").alias("need"))
    kept = d.groupBy("ind").agg(F.count("*").alias("have")).crossJoin(F.broadcast(n_loci)).where(enough)  # one row
    d = d.join(stored(kept.select("ind")), "ind", "left_semi").select("ind", "locus", F.explode("alleles").alias("allele"), "pop")
    return fr.drop_monomorphic(d, "locus", "allele").select("ind", "locus", "allele", "pop")


def q14_whitelist(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    a = fr.keep_listed(o, rich, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("side", F.lit("listed"))
    b = fr.drop_listed(o, rich, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("side", F.lit("other"))
    return a.unionByName(b)


def q15_pairwise(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return sq.pairwise_arrays(e, "vec_id", "embedding", partial(sq.squared_distances, digits=6), "double")


def q16_index_algebra(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"))
    pairs = n.crossJoin(n.select(F.col("source").alias("target")))  # all (source, target) of a dimension
    d = pairs.withColumn("idx", rate_index(F.col("source"), F.col("target"), 25))
    return d.select("source", "target", "idx", rate_source(F.col("idx"), 25).alias("back_source"), rate_target(F.col("idx"), 25).alias("back_target"), first_rate(F.col("target"), 25).alias("first"))


def q41_repeat_offset(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_size").alias("locus"), F.round(F.col("p_retailprice") * 100).cast("long").alias("length"))
    o = fr.repeat_offset(d, "locus", "length", 4)
    d = d.join(o, "locus")
    return d.groupBy("locus", "shift", "ss").agg(F.sum(fr.to_repeats(F.col("length"), F.col("shift"), 4, F.lit(0))).alias("repeats"))


def q42_geo_weights(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"))
    pairs = n.crossJoin(n.select(F.col("a").alias("b"))).where("a <> b")  # all pairs of a dimension
    d = pairs.withColumn("d", F.when((F.col("a") + F.col("b")) % 3 != 0, F.abs(F.col("a") - F.col("b")).cast("double")))
    return rounded(ev.geographic_weights(d, "d").select("a", "b", "weight"))


def q43_allele_range(spark, sf):
    return rounded(fr.allele_range(table(spark, sf, "part").select("p_brand", "p_size"), "p_brand", "p_size"))


def q44_first_seen(spark, sf):
    d = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return fr.first_seen_index(d, ["o_orderstatus"], "o_orderpriority", "o_orderkey")


def q45_names(spark, sf):
    p = table(spark, sf, "part")
    clipped = fr.clip_cut_sites(F.col("p_name"), "a", "e")
    return p.select("p_partkey", fr.clean_name(F.col("p_name")).alias("name"), clipped.alias("clipped"), fr.clamp(F.col("p_size"), F.lit(5), F.lit(40)).alias("size"))


def q46_biallelic(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_partkey"), F.col("l_linenumber"), F.col("l_returnflag")).distinct()
    return fr.biallelic(d, ["l_partkey", "l_linenumber"], "l_returnflag").groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))


_WEIGHTS = ", ".join(f"('{s}', '{b}', {1.0 / len(bs)!r}::DOUBLE)" for s, bs in AMBIGUITY.items() for b in bs)
_HET = """s AS (SELECT c_nationkey AS pop, o_orderstatus AS locus, o_orderpriority AS allele, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY pop, locus) AS freq FROM s),
h AS (SELECT pop, locus, 1.0::DOUBLE - sum(freq * freq) AS h_exp FROM f GROUP BY ALL)"""
_PATTERNS = """c AS (SELECT p_size, p_partkey, rpad(p_brand || p_type, 40, '?') AS seq FROM part),
b AS (SELECT p_size, i::INT AS site, md5(p_partkey::VARCHAR || '|' || substr(seq, i::INT, 1)) AS h FROM c, generate_series(1, 40) g(i)),
s AS (SELECT p_size, site, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS pattern FROM b GROUP BY ALL)"""
_SITES = """chars AS (SELECT p_size, p_partkey, rpad(p_brand, 8, '?') AS seq FROM part),
sites AS (SELECT p_size, p_partkey, i::INT AS site, substr(seq, i::INT, 1) AS base FROM chars, generate_series(1, 8) g(i)),
per AS (SELECT p_size, site, count(DISTINCT CASE WHEN base <> '?' THEN base END) AS k FROM sites GROUP BY ALL),
seg AS (SELECT p_size, count(*) AS n_sites, sum((k > 1)::INT)::BIGINT AS segregating FROM per GROUP BY ALL)"""

_MASKS = ", ".join("('" + s + "', " + ", ".join(str(float(b in bs)) for b in _BASES) + ")" for s, bs in AMBIGUITY.items())


def _em_sql() -> str:
    f, out = "f0 AS (SELECT DISTINCT locus, 0.25::DOUBLE AS a, 0.25::DOUBLE AS c, 0.25::DOUBLE AS g, 0.25::DOUBLE AS t FROM n)", []
    total = " + ".join(f"f.{b} * m.{b}" for b in _BASES)
    for i in range(EM_STEPS):
        sums = ", ".join(f"sum(n * f.{b} * m.{b} / ({total})) AS {b}" for b in _BASES)
        low = ", ".join(f"CASE WHEN {b} < 1e-10 THEN {b} + 1e-10 ELSE {b} END AS {b}" for b in _BASES)
        out.append(f"s{i} AS (SELECT locus, {sums} FROM n JOIN m USING (symbol) JOIN f{i} f USING (locus) GROUP BY locus), l{i} AS (SELECT locus, {low} FROM s{i})")
        out.append(f"f{i + 1} AS (SELECT locus, " + ", ".join(f"{b} / (a + c + g + t) AS {b}" for b in _BASES) + f" FROM l{i})")
    rows = " UNION ALL ".join(f"SELECT locus, '{b}' AS base, round({b}, 9) AS freq FROM f{EM_STEPS}" for b in _BASES)
    return f"""WITH m(symbol, a, c, g, t) AS (VALUES {_MASKS}), x AS (SELECT lang AS locus, unnest(string_split(lower(text), '')) AS symbol FROM documents),
        n AS (SELECT x.locus, x.symbol, count(*)::DOUBLE AS n FROM x JOIN m USING (symbol) GROUP BY ALL), {f}, {", ".join(out)} {rows}"""


SQL = {
    "q83_em_base_freq": _em_sql(),
    "q84_weighted_draws": """WITH d AS (SELECT c_nationkey, c_custkey, c_acctbal,
          -ln((('0x' || substr(md5(c_custkey || '|draws'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / c_acctbal AS k FROM customer WHERE c_acctbal > 0)
        SELECT c_nationkey, c_custkey, c_acctbal, (row_number() OVER (PARTITION BY c_nationkey ORDER BY k, c_custkey))::INT AS draw FROM d QUALIFY draw <= 5""",
    "q01_freq_spectrum": """SELECT l_returnflag AS pop, l_linestatus AS locus, l_quantity AS allele, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus), 8) AS freq
        FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag, l_linestatus, l_quantity""",
    "q02_spectrum_total": """WITH s AS (SELECT l_returnflag AS pop, l_linestatus AS locus, l_quantity AS allele, count(*) AS n FROM lineitem
        WHERE l_quantity IS NOT NULL GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_quantity), (l_linestatus, l_quantity)))
        SELECT pop, locus, allele, n, round(n / sum(n) OVER (PARTITION BY pop, locus), 8) AS freq FROM s""",
    "q03_allele_counts": """SELECT l_returnflag AS pop, l_linestatus AS locus, count(DISTINCT l_quantity) AS n_alleles, count(l_quantity) AS n_copies
        FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))""",
    "q04_expected_het": f"WITH {_HET} SELECT pop, locus, round(h_exp, 8) AS h_exp FROM h",
    "q05_avg_het": f"WITH {_HET} SELECT pop, round(avg(h_exp), 8) AS mean_h, count(*) AS n_loci FROM h GROUP BY pop",
    "q06_gene_copies": """SELECT l_linestatus AS locus, l_returnflag AS pop, count(nullif(l_discount, 0.0)) AS n_copies,
        (count(*) - count(nullif(l_discount, 0.0)))::BIGINT AS n_missing FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)""",
    "q07_base_freq": f"""WITH w(symbol, base, w) AS (VALUES {_WEIGHTS}),
        c AS (SELECT lang AS locus, unnest(string_split(lower(text), '')) AS symbol FROM documents),
        n AS (SELECT locus, symbol, count(*) AS n FROM c GROUP BY ALL),
        f AS (SELECT locus, base, sum(n * w) AS w FROM n JOIN w USING (symbol) GROUP BY ALL),
        g AS (SELECT locus, base, greatest(w / sum(w) OVER (PARTITION BY locus), 1e-6) AS freq FROM f)
        SELECT locus, base, round(freq / sum(freq) OVER (PARTITION BY locus), 10) AS freq FROM g""",
    "q08_segregating": f"WITH {_SITES} SELECT * FROM seg",
    "q09_watterson": f"""WITH {_SITES}, n AS (SELECT p_size, count(*) AS n FROM part GROUP BY ALL),
        a AS (SELECT p_size, n_sites, segregating, n, coalesce((SELECT sum(1.0::DOUBLE / k) FROM generate_series(1, n - 1) g(k)), 0) AS a1,
              coalesce((SELECT sum(1.0::DOUBLE / (k * k)) FROM generate_series(1, n - 1) g(k)), 0) AS a2 FROM seg JOIN n USING (p_size)),
        t AS (SELECT *, CASE WHEN a1 > 0 THEN segregating / a1 END AS theta FROM a),
        v AS (SELECT *, theta / a1 + a2 * theta * theta / (a1 * a1) AS theta_var FROM t),
        r AS (SELECT *, coalesce(theta, 0.0) / n_sites + 1e-7 AS x FROM v)
        SELECT p_size, n_sites, segregating, n, round(a1, 7) AS a1, round(a2, 7) AS a2, round(theta, 7) AS theta, round(theta_var, 7) AS theta_var,
               round(sqrt(theta_var), 7) AS theta_sd, round(x / avg(x) OVER (), 7) AS rate FROM r""",
    "q10_site_patterns": f"""WITH {_PATTERNS} SELECT p_size, pattern, count(*) AS weight, min(site) AS first_site FROM s GROUP BY ALL""",
    "q64_pooled_het": f"""WITH {_HET}, p AS (SELECT locus, allele, sum(n) AS n FROM s GROUP BY ALL), t AS (SELECT locus, sum(n)::BIGINT AS n_copies, sum(n * n)::DOUBLE AS q FROM p GROUP BY ALL)
        SELECT locus, n_copies, round(1.0::DOUBLE - q / (n_copies::DOUBLE * n_copies::DOUBLE), 8) AS h_exp FROM t""",
    "q65_site_to_pattern": f"""WITH {_PATTERNS}, f AS (SELECT p_size, site, min(site) OVER (PARTITION BY p_size, pattern) AS first_site FROM s)
        SELECT p_size, site, first_site, dense_rank() OVER (PARTITION BY p_size ORDER BY first_site)::INT AS pattern_nr FROM f""",
    "q11_random_subset": """SELECT c_nationkey, c_name, c_custkey FROM customer
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_name || '17'), c_name) <= 5""",
    "q12_relabel": """SELECT n_regionkey AS pop, 1 AS locus, c_mktsegment AS allele, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey), 8) AS freq
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_mktsegment""",
    "q13_filter_cascade": """WITH d AS (SELECT DISTINCT l_suppkey AS ind, l_linenumber AS locus, l_returnflag AS allele, l_suppkey % 5 AS pop FROM lineitem),
        al AS (SELECT locus, allele, count(*) / sum(count(*)) OVER (PARTITION BY locus) AS share, count(DISTINCT pop) / (SELECT count(DISTINCT pop) FROM d) AS pops FROM d GROUP BY locus, allele),
        d1 AS (SELECT d.* FROM d JOIN al USING (locus, allele) WHERE share >= 0.2 AND pops >= 0.6),
        pl AS (SELECT pop, locus FROM d1 JOIN (SELECT pop, count(DISTINCT ind) AS need FROM d1 GROUP BY pop) USING (pop) GROUP BY pop, locus, need
               HAVING 1 - count(DISTINCT ind) / need <= 0.3),
        d2 AS (SELECT * FROM d1 SEMI JOIN pl USING (pop, locus)),
        lo AS (SELECT locus FROM d2 GROUP BY locus HAVING 1 - count(DISTINCT ind) / (SELECT count(DISTINCT ind) FROM d2) <= 0.3),
        d3 AS (SELECT * FROM d2 SEMI JOIN lo USING (locus)),
        i AS (SELECT ind FROM d3 GROUP BY ind HAVING 1 - count(DISTINCT locus) / (SELECT count(DISTINCT locus) FROM d3) <= 0.3),
        d4 AS (SELECT * FROM d3 SEMI JOIN i USING (ind))
        SELECT ind, locus, allele, pop FROM d4 SEMI JOIN (SELECT locus FROM d4 GROUP BY locus HAVING count(DISTINCT allele) > 1) USING (locus)""",
    "q14_whitelist": """SELECT o_orderstatus, count(*) AS n, 'listed' AS side FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) GROUP BY ALL
        UNION ALL SELECT o_orderstatus, count(*), 'other' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) GROUP BY ALL""",
    "q15_pairwise": """SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS d
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""",
    "q16_index_algebra": """WITH p AS (SELECT a.n_nationkey AS source, b.n_nationkey AS target FROM nation a, nation b)
        SELECT source, target, CASE WHEN source = target THEN target ELSE 25 + target * 24 + CASE WHEN source < target THEN source ELSE source - 1 END END AS idx,
        source AS back_source, target AS back_target, 25 + target * 24 AS first FROM p""",
    "q41_repeat_offset": """WITH d AS (SELECT p_size AS locus, round(p_retailprice * 100)::BIGINT AS length FROM part),
        s AS (SELECT locus, r, sum(least((length - r) % 4, 4 - (length - r) % 4) ** 2)::BIGINT AS ss FROM d, generate_series(0, 3) g(r) GROUP BY ALL),
        m AS (SELECT locus, min(ss) AS ss, arg_min(r, ss * 4 + r) AS shift FROM s GROUP BY locus)
        SELECT locus, shift::INT AS shift, ss, sum(CASE WHEN (length - shift) / 4.0 - floor((length - shift) / 4.0) = 0.5 THEN floor((length - shift) / 4.0)
        ELSE floor((length - shift) / 4.0 + 0.5) END + 10)::BIGINT AS repeats FROM d JOIN m USING (locus) GROUP BY ALL""",
    "q42_geo_weights": """SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(coalesce(1.0::DOUBLE / greatest(CASE WHEN (a.n_nationkey + b.n_nationkey) % 3 <> 0
        THEN abs(a.n_nationkey - b.n_nationkey)::DOUBLE END, CASE WHEN (a.n_nationkey + b.n_nationkey) % 3 <> 0 THEN 1e-6 END), 1.0), 8) AS weight
        FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey""",
    "q43_allele_range": "SELECT p_brand, min(p_size) AS least, max(p_size) AS greatest, round(avg(p_size), 8) AS mean FROM part GROUP BY p_brand",
    "q44_first_seen": """SELECT o_orderstatus, o_orderpriority, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY min(o_orderkey)) - 1)::INT AS idx
        FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "q45_names": """WITH c AS (SELECT *, CASE WHEN starts_with(p_name, 'a') THEN substr(p_name, 2) ELSE p_name END AS s FROM part)
        SELECT p_partkey, rpad(translate(trim(p_name), ' ', '_'), 10, ' ') AS name, CASE WHEN ends_with(s, 'e') THEN substr(s, 1, length(s) - 1) ELSE s END AS clipped,
        greatest(5, least(p_size, 40)) AS size FROM c""",
    "q46_biallelic": """WITH d AS (SELECT DISTINCT l_partkey, l_linenumber, l_returnflag FROM lineitem),
        two AS (SELECT l_partkey, l_linenumber FROM d GROUP BY ALL HAVING count(*) = 2)
        SELECT l_linenumber, l_returnflag, count(*) AS n FROM d SEMI JOIN two USING (l_partkey, l_linenumber) GROUP BY ALL""",
    "q70_allele_index": """WITH k AS (SELECT o_orderstatus, o_orderpriority, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY min(o_orderkey), o_orderpriority) - 1)::INT AS idx
        FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus, o_orderpriority)
        SELECT o_orderstatus, o_orderpriority, o_orderkey, idx FROM orders LEFT JOIN k USING (o_orderstatus, o_orderpriority)""",
    "q71_sequence_differences": """SELECT a.s_suppkey AS i, b.s_suppkey AS j, (SELECT count(*) FROM generate_series(1, greatest(length(a.s_name), length(b.s_name))) g(k)
        WHERE substr(a.s_name, k::INT, 1) <> substr(b.s_name, k::INT, 1))::INT AS d FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey""",
}
QUERIES = {k: globals()[k] for k in SQL}

"""Reader of genotype files: a header with data type, populations and loci, then a block of individuals each population.

The header and the line of sites are read on the driver; population lines are found by joins and individuals' lines parsed by
column expressions. Result: one row for each individual, locus and copy, with null for missing values.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import stored
from .lines import numbered, stripped

# Data types by their letter, and those with two copies of each locus.
DATATYPES = {"s": "sequence", "n": "linked snp", "u": "unlinked snp", "h": "hapmap", "f": "ancestral", "a": "infinite allele", "m": "stepwise", "b": "brownian", "g": "genealogies", "@": "haplotype"}
DIPLOID = "abm"
MISSING = "?"
_DELIMITERS = "./,|:;-"


@dataclass
class Sublocus:
    locus: int
    sublocus: int
    kind: str
    length: int
    name: str | None = None
    model: str | None = None
    parameters: list[float] = field(default_factory=list)
    unit: int | None = None
    start: int | None = None


@dataclass
class Header:
    kind: str | None
    pops: int
    loci: int
    delimiter: str | None
    title: str


def parse_header(line: str) -> Header:
    """``[kind] pops loci [delimiter] [title]``; the kind may be missing where the line of sites gives it."""
    if line.lstrip().startswith("<"):
        raise ValueError("XML is not a genotype file")
    m = re.match(r"\s*([a-zA-Z@])?\s*(\d+)\s+(\d+)(?:\s+(\S)(?=\s|$))?\s*(.*)$", line)
    if not m:
        raise ValueError(f"not a header: {line!r}")
    kind, pops, loci, mark, title = m.groups()
    if mark is not None and mark not in _DELIMITERS:
        mark, title = None, f"{mark} {title}".strip()
    if kind is not None and kind.lower() not in DATATYPES:
        raise ValueError(f"unknown data type {kind!r}")
    return Header(kind and kind.lower(), int(pops), int(loci), mark, title.strip())


#: A part of a locus: name, start in its sequence (from 0), kind and length.
_PART = re.compile(r"(?:([^\s()\[\]=]+)=)?(?:(\d+)\s*(?=[a-zA-Z@]))?([a-zA-Z@])?(\d+)$")
_TOKEN = re.compile(r"\s*(?:\[([^\]]*)\]|([()])|((?:[^\s()\[\]=]+=)?\d+\s+[a-zA-Z@]\d+[^\s()\[\]]*(?=[^(]*\))|[^\s()\[\]]+))")


def _slices(spec: str, length: int, seed: int) -> tuple[list[tuple[int, int]], int]:
    """``10``, ``10oN``, ``10rN``, with ``_k`` or not -> (start, length) of each slice of a sequence, and how many are linked."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:([or])(\d+)(?:_(\d+))?)?\s*", spec)
    if not m or int(m[1]) < 1:
        raise ValueError(f"cannot read [{spec}] in the line of sites")
    n, size = int(m[1]), int(m[3] or 0)
    each, rest = divmod(length, n)
    if n * size > length or n > length:
        raise ValueError(f"[{spec}] takes more sites than {length}")
    if m[2] is None:  # all sites, the last slice with the rest
        return [(i * each, each + (rest if i == n - 1 else 0)) for i in range(n)], 1
    if m[2] == "o":
        starts = [rest // 2 + i * each for i in range(n)]
    elif size:
        free = sorted(random.Random(seed).choices(range(length - n * size + 1), k=n))
        starts = [x + i * size for i, x in enumerate(free)]
    else:
        starts = [0, *sorted(random.Random(seed).sample(range(1, length), n - 1))]
    ends = [x + size for x in starts] if size else [*starts[1:], length]
    return [(a, b - a) for a, b in zip(starts, ends, strict=True)], int(m[4] or 1)


def parse_sites(line: str, seed: int = 1) -> list[Sublocus]:
    """The line of sites. ``(s200 s800)`` is one linked locus of two parts, ``s10 s20`` two loci; ``x=s10`` names a part,
    ``12s10`` (or ``12 s10`` in parentheses) starts after 12 sites of the sequence, and a bare list of numbers gives lengths of
    sequences, one locus each.

    ``[10](s1000)`` cuts a sequence into 10 loci, the last with the rest; ``[10o50](s1000)`` takes 10 of 50 sites at equal
    distances, ``[10r50](s1000)`` 10 that do not overlap at places drawn with ``seed`` (``r0``: whole stretches between places
    drawn), and ``_2`` after these links each two of them to one locus. Slices count from where the sequence begins.
    """
    out: list[Sublocus] = []
    locus, inside, part, spec, base, at, sliced = 0, False, 0, None, 0, 0, False
    line = line.rstrip()
    while at < len(line):
        m = _TOKEN.match(line, at)
        if not m:
            raise ValueError(f"cannot read {line[at:]!r} in the line of sites")
        at = m.end()
        if m[1] is not None:
            spec = m[1]
        elif m[2] == "(":
            inside, part, locus = True, 0, locus + 1
        elif m[2] == ")":
            inside = False
        else:
            p = _PART.match(m[3])
            kind = (p[3] or "s").lower() if p else ""
            if kind not in DATATYPES:
                raise ValueError(f"cannot read {m[3]!r} in the line of sites")
            if not inside:
                locus, part = locus + 1, 0
            name, start, length = p[1], p[2] and int(p[2]), int(p[4])
            if spec is None:
                part += 1
                out.append(Sublocus(locus, part, kind, length, name, start=base if sliced and start is None else start))
                base += length if start is None else 0
                continue
            cuts, linked = _slices(spec, length, seed)
            for i, (a, n) in enumerate(cuts):
                if i and i % linked == 0:
                    locus += 1
                out.append(Sublocus(locus, i % linked + 1, kind, n, name, start=base + a))
            spec, base, sliced = None, base + length, True
    return out


def parse_models(comments: list[str]) -> dict[int, tuple[str, list[float]]]:
    """``#$ ... n kind MODEL parameters`` comments: number of the part -> model and its parameters."""
    out = {}
    for c in comments:
        m = re.match(r"#\$\s*(\d+)\s+\S\s+([A-Za-z0-9]+)\s*(.*)$", c)
        if m:
            out[int(m[1])] = (m[2].upper(), [float(x) for x in re.findall(r"[-+0-9.eE]+", m[3]) if re.fullmatch(r"[-+]?[0-9.]+([eE][-+]?\d+)?", x)])
    return out


def parse_repeats(comments: list[str]) -> list[int] | None:
    """``#@M 2 3 ...`` comments: repeat lengths of the loci."""
    for c in comments:
        m = re.match(r"#\s*@M\s+(.*)$", c)
        if m:
            return [int(x) for x in m[1].split()]
    return None


def _value(v: Column) -> Column:
    return F.when((v == MISSING) | (v == ""), F.lit(None)).otherwise(v)


def _header(spark: SparkSession, path: str, kind: str | None) -> tuple[DataFrame, Header, str, int, list[Sublocus]]:
    """Numbered lines, header, kind, number of the first population line and the parts of loci with their models."""
    comments = [r["line"] for r in spark.read.text(path).where(F.col("value").rlike(r"^\s*#(\$|\s*@M)")).select(F.col("value").alias("line")).collect()]
    lines = numbered(spark, path, r"^\s*(#|$)")
    first = lines.where("nr < 2").orderBy("nr").limit(2).collect()
    head = parse_header(first[0]["line"])
    kind = head.kind or kind
    start, parts = 1, None
    if head.delimiter is None and kind in (None, "s", "n", "u") and len(first) > 1:
        try:
            parts = parse_sites(first[1]["line"])
            start = 2
            kind = kind or parts[0].kind
        except ValueError:
            parts = None
    if kind is None:
        kind = "m" if head.delimiter else "s"
    models = parse_models(comments)
    units = parse_repeats(comments) or []
    parts = parts or [Sublocus(i + 1, 1, kind, 1) for i in range(head.loci)]
    for i, p in enumerate(parts, 1):
        p.model, p.parameters = models.get(i, (None, []))
        p.unit = units[i - 1] if i <= len(units) else None
    return lines, head, kind, start, parts


def read_loci(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A row for each part of a locus, as header, line of sites, model and repeat comments say: (locus, sublocus, name,
    n_sites, datatype, model, params, repeat_unit)."""
    parts = _header(spark, path, kind)[4]
    rows = [(p.locus, p.sublocus, p.name, p.length, p.kind, p.model, p.parameters, p.unit) for p in parts]
    return spark.createDataFrame(rows, "locus int, sublocus int, name string, n_sites int, datatype string, model string, params array<double>, repeat_unit int")


def population_lines(lines: DataFrame, start: int, pops: int, interleaved: bool = False) -> DataFrame:
    """(pop, pop_name, first, last, size): first and last line of each population's individuals. Each population line says how
    many individuals follow, so it tells where the next one is. Lines that begin with a number (individuals may) are
    followed from the first one by doubling: from twice as many lines in each round, to where twice as many steps lead. Nothing
    of the lines is collected. Interleaved blocks go on to the next line that begins with a number, or to the end."""
    number = r"^\s*(\d+)((?:\s+\d+)*)\s*(.*)$"
    found = lines.where((F.col("nr") >= start) & F.col("line").rlike(r"^\s*\d+(\s|$)"))
    found = found.select("nr", F.regexp_extract("line", number, 1).cast("long").alias("size"), stripped(F.regexp_extract("line", number, 3)).alias("name"))
    if interleaved:  # every such line is one; a row a population goes through the window
        found = found.orderBy("nr").limit(pops)
        by = W.orderBy("nr")
        end = lines.agg(F.max("nr").alias("_end"))
        d = found.withColumn("step", F.row_number().over(by) - 1).withColumn("_next", F.lead("nr").over(by)).crossJoin(end)
        d = d.withColumn("last", F.coalesce(F.col("_next") - 1, F.col("_end")))
    else:
        found = stored(found)
        jump = found.select("nr", (F.col("nr") + F.col("size") + 1).alias("to"))
        reached, far = lines.sparkSession.range(start, start + 1).select(F.col("id").alias("nr"), F.lit(0).cast("long").alias("step")), 1
        while far < pops and not jump.isEmpty():
            on = reached.join(jump, "nr").select(F.col("to").alias("nr"), (F.col("step") + far).alias("step"))
            reached = stored(reached.unionByName(on))
            again = jump.select(F.col("nr").alias("to"), F.col("to").alias("_far"))
            jump, far = stored(jump.join(again, "to").select("nr", F.col("_far").alias("to"))), 2 * far
        d = reached.where(F.col("step") < pops).join(found, "nr", "left")
        wrong = d.where(F.col("size").isNull()).join(lines, "nr").orderBy("step").select("line").first()
        if wrong is not None:
            raise ValueError(f"not a population line: {wrong['line']!r}")
        d = d.where(F.col("size").isNotNull()).withColumn("last", F.col("nr") + F.col("size"))
    pop = (F.col("step") + 1).cast("int")
    name = F.when(F.col("name") == "", F.concat(F.lit("population "), pop)).otherwise(F.col("name"))
    return d.select(pop.alias("pop"), name.alias("pop_name"), (F.col("nr") + 1).alias("first"), "last", F.col("size").cast("int").alias("size"))


def read_genotypes(spark: SparkSession, path: str, name_width: int = 10, kind: str | None = None, interleaved: bool = False) -> DataFrame:
    """(pop, pop_name, ind, ind_name, unassigned, locus, sublocus, copy, site, value, datatype).

    Alleles: two copies a locus, split at the delimiter (a lone one is homozygous), or one or two letters where the file
    has none. Sequences: one copy, ``value`` is the whole part of the locus, ``site`` null (see ``explode_sites``).
    ``interleaved`` sequences come in blocks of a line each individual, with names in a population's first block only.
    """
    lines, head, kind, start, parts = _header(spark, path, kind)
    if kind == "h":
        return read_hapmap(lines, start)
    pops = population_lines(lines, start, head.pops, interleaved)
    d = lines.join(stored(pops), F.col("nr").between(F.col("first"), F.col("last")))  # a row a population, of a size that Spark sees
    if interleaved:
        d = d.withColumn("nr", F.col("nr") - F.col("first"))
        d = join_interleaved(d, F.col("size"), name_width, ["pop", "pop_name"]).withColumnRenamed("seq", "_rest").withColumn("_name", F.col("ind_name"))
    else:
        rest = F.substring(F.col("line"), F.lit(name_width + 1), F.length("line")).alias("_rest")
        d = d.select("pop", "pop_name", (F.col("nr") - F.col("first") + 1).cast("int").alias("ind"), stripped(F.substring("line", 1, name_width)).alias("_name"), rest)
    d = d.select("pop", "pop_name", "ind", F.regexp_replace("_name", r"^\?", "").alias("ind_name"), F.col("_name").startswith("?").alias("unassigned"), "_rest")
    keys = ["pop", "pop_name", "ind", "ind_name", "unassigned"]
    if kind in DIPLOID:
        words = F.split(stripped("_rest"), r"\s+")
        d = d.select(*keys, F.posexplode(words).alias("_l", "_v"))
        a, b = (F.get(F.split("_v", re.escape(head.delimiter)), F.lit(i)) if head.delimiter else F.substring("_v", i + 1, 1) for i in (0, 1))
        copies = F.array(F.struct(F.lit(1).alias("copy"), a.alias("v")), F.struct(F.lit(2).alias("copy"), F.when(F.coalesce(b, F.lit("")) == "", a).otherwise(b).alias("v")))
        d = d.select(*keys, (F.col("_l") + 1).alias("locus"), F.lit(1).alias("sublocus"), F.explode(copies).alias("_c"))
        return d.select(*keys, "locus", "sublocus", "_c.copy", F.lit(None).cast("int").alias("site"), _value(F.col("_c.v")).alias("value"), F.lit(kind).alias("datatype"))
    at, cuts = 1, []
    for p in parts:
        own = at if p.start is None else p.start + 1
        cuts.append(F.struct(F.lit(p.locus).alias("locus"), F.lit(p.sublocus).alias("sublocus"), F.substring("_s", own, p.length).alias("value"), F.lit(p.kind).alias("datatype")))
        at += p.length if p.start is None else 0
    d = d.withColumn("_s", F.translate("_rest", " \t", "")).select(*keys, F.explode(F.array(*cuts)).alias("_c"))
    return d.select(*keys, "_c.locus", "_c.sublocus", F.lit(1).alias("copy"), F.lit(None).cast("int").alias("site"), "_c.value", "_c.datatype")


def join_interleaved(lines: DataFrame, individuals: int | Column, name_width: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Interleaved sequences of each of ``keys``: blocks of a line each individual, names only in the first block.
    ``lines`` (keys, nr from 0, line) -> (keys, ind, ind_name, seq)."""
    keys, n = keys or [], individuals if isinstance(individuals, Column) else F.lit(individuals)
    d = lines.select(*keys, (F.col("nr") % n + 1).cast("int").alias("ind"), F.floor(F.col("nr") / n).alias("block"), "line")
    first = F.col("block") == 0
    part = F.when(first, F.substring(F.col("line"), F.lit(name_width + 1), F.length("line"))).otherwise(F.col("line"))
    d = d.groupBy(*keys, "ind").agg(
        F.max(F.when(first, stripped(F.substring("line", 1, name_width)))).alias("ind_name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.translate(part, " \t", "").alias("s")))), lambda x: x["s"]), "").alias("seq"),
    )
    return d.select(*keys, "ind", "ind_name", "seq")


def explode_sites(d: DataFrame) -> DataFrame:
    """Sequences site by site; symbols without information (``N X ? O -``) are null."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    keep = [c for c in d.columns if c not in ("site", "value")]
    d = d.select(*keep, F.posexplode(chars).alias("_p", "_c"))
    return d.select(*keep, (F.col("_p") + 1).alias("site"), F.when(~F.upper("_c").isin("N", "X", "?", "O", "-"), F.col("_c")).alias("value"))


def read_hapmap(lines: DataFrame, start: int = 1) -> DataFrame:
    """Frequency rows ``position A nA B nB total``; the counts become rows. nA + nB must be the total."""
    d = lines.where(F.col("nr") >= start).withColumn("w", F.split(F.trim("line"), r"\s+"))
    marks = d.where(F.size("w") < 6).select("nr", F.array_join(F.slice("w", F.lit(2), F.size("w")), " ").alias("pop_name"))
    by = W.orderBy("nr")  # a row a population goes through the window
    pops = marks.select(F.row_number().over(by).alias("pop"), "pop_name", F.col("nr").alias("first"), F.coalesce(F.lead("nr").over(by), F.lit(1 << 62)).alias("next"))
    d = d.where(F.size("w") >= 6).join(stored(pops), (F.col("nr") > F.col("first")) & (F.col("nr") < F.col("next")))
    n = lambda i: F.col("w")[i].cast("int")
    ok = F.when(n(2) + n(4) == n(5), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("counts do not add up: "), F.col("line"))).cast("boolean"))
    d = d.where(ok).withColumn("locus", (F.col("nr") - F.col("first")).cast("int"))
    values = F.concat(F.array_repeat(F.col("w")[1], n(2)), F.array_repeat(F.col("w")[3], n(4)))
    d = d.select("pop", "pop_name", "locus", F.posexplode(values).alias("_i", "value"))
    ind = F.col("_i") + 1
    return d.select("pop", "pop_name", ind.alias("ind"), ind.cast("string").alias("ind_name"), F.lit(False).alias("unassigned"), "locus", F.lit(1).alias("sublocus"), F.lit(1).alias("copy"), F.lit(None).cast("int").alias("site"), "value", F.lit("h").alias("datatype"))


def hapmap_genotypes(d: DataFrame, row: str = "value") -> DataFrame:
    """Genotype rows ``rs alleles chrom pos ... genotypes`` -> counts of both labels at each position."""
    w = F.split(stripped(row), r"\s+")
    d = d.select(w.alias("w")).where(F.col("w")[1].rlike("^[ACGT]/[ACGT]$"))
    bases = F.filter(F.split(F.array_join(F.slice("w", F.lit(12), F.size("w")), ""), ""), lambda c: c != "")
    count = lambda x: F.size(F.filter("b", lambda c: c == x))
    d = d.select(F.col("w")[0].alias("rs"), F.col("w")[2].alias("chrom"), F.col("w")[3].cast("long").alias("pos"), F.split(F.col("w")[1], "/").alias("l"), bases.alias("b"))
    return d.select("rs", "chrom", "pos", F.col("l")[0].alias("a"), count(F.col("l")[0]).alias("n_a"), F.col("l")[1].alias("b_label"), count(F.col("l")[1]).alias("n_b"))

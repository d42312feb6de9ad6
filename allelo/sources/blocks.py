"""Genotype files as a Python data source: ``spark.read.format("allelo_genotypes")``, a partition for each population block, and
a writer that makes directories of such blocks.

``register(spark)`` makes the format known. A file's blocks are found by a Spark job (``load_blocks``), which hands the reader a
row for each population: no line of individuals passes the driver, and a task seeks to its block and reads only that. Without
that index a file is one partition, read as a stream (so are compressed files). Conditions ``pop = ...`` and ``pop in (...)``
leave out whole blocks, those on ``locus`` cells (``register`` turns on ``spark.sql.python.filterPushdown.enabled``, without which
Spark refuses readers that take conditions).

The writer takes rows (pop, pop_name, ind, ind_name, locus, copy, value) whose individuals are whole within a partition and in
order (``save_blocks`` sees to that) and streams a line each individual; a file a task, which counts once the driver has
committed the list of all in ``_blocks.json``. A task that is run again writes another file, and what an aborted job has written is
deleted. A population may be in several files, so a large one is many tasks.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..operators.chains import cumulated
from ..ship import ship
from ..store import stored
from .native import DIPLOID, MISSING, Header, Sublocus, parse_header, parse_sites, population_lines

FORMAT = "allelo_genotypes"
SCHEMA = "pop int, pop_name string, ind int, ind_name string, unassigned boolean, locus int, sublocus int, copy int, site int, value string, datatype string"
_INDEX = "_blocks.json"
#: Cells of a batch that a reading task gives to Spark at once.
_CELLS = 20_000


@dataclass
class Block(InputPartition):
    """Individuals of one population: where their lines are and the number of the first; a whole file where ``size`` is None."""

    path: str
    pop: int = 0
    pop_name: str = ""
    offset: int = 0
    size: int | None = None
    first: int = 1


def _open(path: str, offset: int | None = None):
    """A stream of the file at a path or URI, from an offset on or, without one, unpacked."""
    fs, p = pf.FileSystem.from_uri(path) if ":/" in path else (pf.LocalFileSystem(), path)
    if offset is None:
        return fs.open_input_stream(p)
    f = fs.open_input_file(p)
    f.seek(offset)
    return f


def _lines(f) -> Iterator[str]:
    rest = b""
    while chunk := f.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield line.decode().rstrip("\r")
    if rest:
        yield rest.decode().rstrip("\r")


def _content(lines: Iterator[str]) -> Iterator[str]:
    return (x for x in lines if x.strip() and not x.lstrip().startswith("#"))


def _layout(head_line: str, second: str | None, kind: str | None) -> tuple[Header, str, list[Sublocus] | None]:
    """Header, kind and, where the second line is one of sites, the parts of loci."""
    head = parse_header(head_line)
    kind, parts = head.kind or kind, None
    if head.delimiter is None and kind in (None, "s", "n", "u") and second is not None:
        try:
            parts = parse_sites(second)
            kind = kind or parts[0].kind
        except ValueError:
            parts = None
    return head, kind or ("m" if head.delimiter else "s"), parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("name_width", 10))
        self.blocks = [Block(**b) for b in json.loads(options["index"])] if options.get("index") else None
        if self.blocks is None and posixpath.basename(self.path.rstrip("/")).count(".") == 0:
            try:
                made = json.loads(_open(posixpath.join(self.path, _INDEX)).read())
                self.blocks = [Block(**b | {"path": posixpath.join(self.path, b["path"])}) for b in made["blocks"]]
                top = made["lines"]
            except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
                top = None
        else:
            top = None
        if top is None:
            lines = _content(_lines(_open(self.path)))
            top = [x for _, x in zip(range(2), lines, strict=False)]
        self.head, self.kind, self.parts = _layout(top[0], top[1] if len(top) > 1 else None, options.get("kind"))
        if self.kind == "h":
            raise ValueError("frequencies of haplotype maps are read by read_genotypes")
        self.pops: set | None = None
        self.loci: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("pop",), ("locus",)):
                yield f
                continue
            name = "pops" if f.attribute == ("pop",) else "loci"
            mine = getattr(self, name)
            setattr(self, name, values if mine is None else mine & values)

    def partitions(self):
        blocks = [Block(self.path)] if self.blocks is None else self.blocks
        return [b for b in blocks if b.size is None or self.pops is None or b.pop in self.pops] or [Block(self.path, size=0)]

    def _individuals(self, block: Block) -> Iterator[tuple[int, str, int, str]]:
        """(pop, pop_name, ind, line)."""
        if block.size is not None:
            lines = _content(_lines(_open(block.path, block.offset))) if block.size else iter(())
            for i in range(block.size):
                yield block.pop, block.pop_name, block.first + i, next(lines)
            return
        lines = _content(_lines(_open(block.path)))
        next(lines)
        if self.parts is not None:
            next(lines)
        for pop in range(1, self.head.pops + 1):
            line = next(lines, None)
            words = (line or "").split()
            if not words or not words[0].isdigit():
                raise ValueError(f"not a population line: {line!r}")
            while len(words) > 1 and words[1].isdigit():
                words.pop(1)
            name = line.split(None, 1)[1].strip() if len(words) > 1 else f"population {pop}"
            for i in range(int(words[0])):
                line = next(lines)
                if self.pops is None or pop in self.pops:
                    yield pop, name, i + 1, line

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch():
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for pop, pop_name, ind, line in self._individuals(partition):
            own, rest = line[: self.width].strip(), line[self.width :]
            key = (pop, pop_name, ind, own.removeprefix("?"), own.startswith("?"))
            if self.kind in DIPLOID:
                for locus, cell in enumerate(rest.split(), 1):
                    if self.loci is None or locus in self.loci:
                        a, b = (cell.split(self.head.delimiter, 2) + [""])[:2] if self.head.delimiter else (cell[:1], cell[1:2])
                        for copy, v in ((1, a), (2, b or a)):
                            rows.append((*key, locus, 1, copy, None, None if v in (MISSING, "") else v, self.kind))
            else:
                s, at = rest.replace(" ", "").replace("\t", ""), 0
                for p in self.parts or [Sublocus(i + 1, 1, self.kind, 1) for i in range(self.head.loci)]:
                    start = at if p.start is None else p.start
                    at += p.length if p.start is None else 0
                    if self.loci is None or p.locus in self.loci:
                        rows.append((*key, p.locus, p.sublocus, 1, None, s[start : start + p.length], p.kind))
            if len(rows) >= _CELLS:
                yield batch()
                rows.clear()
        yield batch()


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    blocks: list


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.width, self.delimiter = options["path"].rstrip("/"), int(options.get("name_width", 10)), options.get("delimiter", ".")
        self.loci, self.title, self.columns = int(options["loci"]), options.get("title", ""), columns

    def _fs(self) -> tuple[pf.FileSystem, str]:
        return pf.FileSystem.from_uri(self.path) if ":/" in self.path else (pf.LocalFileSystem(), self.path)

    def write(self, iterator) -> _Written:
        fs, top = self._fs()
        fs.create_dir(top, recursive=True)
        file, out, blocks, at, open_ = f"part-{uuid.uuid4().hex}.txt", None, [], 0, None
        cells: list[list] = []

        def line() -> None:
            nonlocal at
            (pop, pop_name, ind), name = open_[:3], open_[3]
            text = f"{name or '':<{self.width}.{self.width}}" + " ".join(self.delimiter.join(v if v is not None else MISSING for v in c) for c in cells) + "\n"
            data = text.encode()
            out.write(data)
            if not blocks or blocks[-1]["pop"] != pop or blocks[-1]["first"] + blocks[-1]["size"] != ind:
                blocks.append({"path": file, "pop": pop, "pop_name": pop_name, "offset": at, "size": 0, "first": ind})
            blocks[-1]["size"] += 1
            at += len(data)

        for row in iterator:
            key = (row["pop"], row["pop_name"], row["ind"], row["ind_name"])
            if key != open_:
                if open_ is not None:
                    line()
                out = out or fs.open_output_stream(f"{top}/{file}")
                open_, cells = key, [[None, None] for _ in range(self.loci)]
            if not 0 < row["locus"] <= self.loci or row["copy"] not in (1, 2):
                raise ValueError(f"locus {row['locus']}, copy {row['copy']} of {self.loci} loci")
            cells[row["locus"] - 1][row["copy"] - 1] = row["value"]
        if open_ is not None:
            line()
            out.close()
        return _Written(file if out else None, blocks)

    def commit(self, messages) -> None:
        fs, top = self._fs()
        blocks = sorted((b for m in messages if m for b in m.blocks), key=lambda b: (b["pop"], b["first"]))
        head = f"m {len({b['pop'] for b in blocks})} {self.loci} {self.delimiter} {self.title}".rstrip()
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{_INDEX}") as f:
            f.write(json.dumps({"lines": [head], "blocks": blocks}).encode())

    def abort(self, messages) -> None:
        fs, top = self._fs()
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{top}/{m.file}")


class GenotypeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GenotypeSource)


def population_blocks(spark: SparkSession, path: str, kind: str | None = None) -> list[Block]:
    """The blocks of a file that is not compressed, by a Spark job; a row a population reaches the driver."""
    d = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("i"), F.lit(1).alias("one"))
    content = ~F.col("value").rlike(r"^\s*(#|$)")
    d = d.withColumns({"bytes": F.octet_length("value") + F.lit(1), "counts": content.cast("long")})
    d = cumulated(d, ["one"], ["i"], F.col("bytes").cast("long"), "end")
    d = stored(cumulated(d, ["one"], ["i"], F.col("counts"), "n").where("counts = 1"))
    lines = d.select(F.regexp_replace("value", "\r$", "").alias("line"), (F.col("n") - 1).alias("nr"))
    top = [r["line"] for r in lines.where("nr < 2").orderBy("nr").collect()]
    head, _, parts = _layout(top[0], top[1] if len(top) > 1 else None, kind)
    pops = population_lines(lines, 1 if parts is None else 2, head.pops)
    ends = d.select((F.col("n") - 1).alias("nr"), "end")
    rows = pops.join(ends, pops["first"] - 1 == ends["nr"]).orderBy("pop").collect()
    return [Block(path, r["pop"], r["pop_name"], r["end"], r["size"]) for r in rows]


def load_blocks(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """The rows of ``read_genotypes`` by the data source, a partition a population."""
    register(spark)
    index = json.dumps([asdict(b) for b in population_blocks(spark, path, kind)])
    return spark.read.format(FORMAT).options(path=path, index=index, **({"kind": kind} if kind else {}), **options).load()


def save_blocks(d: DataFrame, path: str, **options) -> None:
    """Alleles (pop, pop_name, ind, ind_name, locus, copy, value) as a directory of blocks, which the same format reads. Loci are
    numbered from 1; those that an individual lacks are missing."""
    register(d.sparkSession)
    loci = d.agg(F.max("locus")).first()[0] or 0
    d = d.select("pop", "pop_name", "ind", "ind_name", "locus", "copy", "value").repartitionByRange("pop", "ind").sortWithinPartitions("pop", "ind", "locus", "copy")
    d.write.format(FORMAT).options(path=path, loci=loci, **options).mode("append").save()

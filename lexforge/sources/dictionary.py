"""Offline dictionaries: raw responses in sorted files, read through a Spark data source.

write_dictionary() keeps a source's raw responses as Parquet, range-partitioned and sorted by term, in a folder of
its own. The data source "lexforge_dictionary" reads any number of such folders: a partition is a group of rows of
one source and a range of terms. The options sources, from and to choose; with the option pushdown, so do filters on
term (=, IN, ranges, a prefix) and on source, which Spark still evaluates itself. Row groups whose range of terms
can't hold a match are never read, and only matching rows leave the reader.

    spark.read.format("lexforge_dictionary").option("path", p).option("sources", "webster").option("from", "b").load()

Only footers are read to plan, and a task reads its row groups batch by batch. Paths are those of pyarrow's file
systems (file, hdfs, s3, gs). Columns: source, term, lang (the page, empty without a choice), json.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lexforge.schemas import LOOKUP
from lexforge.sources.base import DictSource, known, source
from lexforge.sources.files import Files
from lexforge.sources.shared import workers_import

FORMAT = "lexforge_dictionary"
SCHEMA = "source string, term string, lang string, json string"
#: Rows of a file's row group, about; a partition reads one or a few.
BLOCK_BYTES = 16 << 20


def write_dictionary(entries: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    """Keep entries(term, json and, with several pages, lang) as the dictionary of the named source. Rows without a
    term or response are left out. Terms are dealt out by range, so a common one may fill files of its own."""
    lang = F.col("lang") if "lang" in entries.columns else F.lit("")
    rows = entries.select(F.col("term").cast("string").alias("term"), lang.cast("string").alias("lang"), F.col("json").cast("string").alias("json"))
    rows = rows.filter("term is not null and json is not null").repartitionByRange("term", "json").sortWithinPartitions("term", "lang", "json")
    rows.write.mode(mode).option("parquet.block.size", BLOCK_BYTES).parquet(f"{path.rstrip('/')}/{name}")


@dataclass
class Wanted:
    """What the pushed filters ask of a string column; all parts hold at once."""

    values: set[str] | None = None
    low: str | None = None
    high: str | None = None
    prefix: str | None = None
    tests: list[tuple[str, str]] = field(default_factory=list)  # (comparison, value)

    def add(self, f: ds.Filter) -> None:
        """Take a filter over, if it is of a kind that can be."""
        value = getattr(f, "value", None)
        if isinstance(f, ds.In):
            some = {v for v in value if v is not None}
            self.values = some if self.values is None else self.values & some
        elif not isinstance(value, str):
            return
        elif isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
            self.values = {value} if self.values is None else self.values & {value}
        elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            self.low = value if self.low is None else max(self.low, value, key=str.encode)
            self.tests.append(("greater" if isinstance(f, ds.GreaterThan) else "greater_equal", value))
        elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
            self.high = value if self.high is None else min(self.high, value, key=str.encode)
            self.tests.append(("less" if isinstance(f, ds.LessThan) else "less_equal", value))
        elif isinstance(f, ds.StringStartsWith):
            self.prefix = value
            self.tests.append(("starts_with", value))

    def may_hold(self, low: str | None, high: str | None) -> bool:
        """Whether values from low to high (unknown if None; by bytes) may hold a match."""
        a, b = (low or "").encode(), None if high is None else high.encode()
        if self.values is not None and not any(a <= v.encode() and (b is None or v.encode() <= b) for v in self.values):
            return False
        if self.low is not None and b is not None and b < self.low.encode():
            return False
        if self.high is not None and a > self.high.encode():
            return False
        if self.prefix is not None:
            p = self.prefix.encode()
            return a[: len(p)] <= p and (b is None or b[: len(p)] >= p)
        return True

    def matches(self, column: pa.Array) -> pa.Array:
        keep = pa.array([True] * len(column)) if self.values is None else pc.is_in(column, pa.array(sorted(self.values), pa.string()))
        for name, value in self.tests:
            # strings are compared by bytes, as Spark does
            test = pc.starts_with(column, value) if name == "starts_with" else getattr(pc, name)(column.cast(pa.binary()), pa.scalar(value.encode()))
            keep = pc.and_(keep, test)
        return pc.fill_null(keep, False)


@dataclass
class Part(ds.InputPartition):
    """Row groups of a source's file."""

    source: str
    file: str
    groups: list[int]
    low: str | None
    high: str | None


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the dictionary's path is missing")
        self.path = options["path"].rstrip("/")
        self.sources = [s.strip() for s in options.get("sources", "").split(",") if s.strip()]
        self.term, self.source = Wanted(), Wanted()
        if options.get("from"):
            self.term.add(ds.GreaterThanOrEqual(("term",), options["from"]))
        if options.get("to"):
            self.term.add(ds.LessThanOrEqual(("term",), options["to"]))

    def partitions(self) -> list[Part]:
        """One for each row group that may hold a match."""
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        names = self.sources or [i.base_name for i in at.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
        out = []
        for name in sorted(names):
            if not self.source.matches(pa.array([name]))[0].as_py():
                continue
            for info in sorted(at.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True)), key=lambda i: i.path):
                if info.type == fs.FileType.File and info.base_name.endswith(".parquet"):
                    out += self._groups(name, info.path, pq.ParquetFile(info.path, filesystem=at).metadata)
        return out or [Part("", "", [], None, None)]

    def _groups(self, name: str, file: str, meta: pq.FileMetaData) -> Iterator[Part]:
        column = meta.schema.names.index("term")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(column).statistics
            low, high = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
            if self.term.may_hold(low, high):
                yield Part(name, file, [g], low, high)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.groups:
            return
        from pyarrow import fs

        at = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for batch in pq.ParquetFile(part.file, filesystem=at).iter_batches(10_000, part.groups, columns=["term", "lang", "json"]):
            some = batch.filter(self.term.matches(batch.column(0)))
            if some.num_rows:
                cols = [pa.array([part.source] * some.num_rows, pa.string()), *[c.cast(pa.string()) for c in some.columns]]
                yield pa.RecordBatch.from_arrays(cols, names=["source", "term", "lang", "json"])


class PushingReader(Reader):
    """A reader that also takes Spark's filters."""

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802  Spark's name
        for f in filters:
            of = {("term",): self.term, ("source",): self.source}.get(getattr(f, "attribute", None))
            if of is not None:
                of.add(f)
        # Spark evaluates all of them again
        return filters


class DictionarySource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown", "").lower() == "true" else Reader)(options)


def dictionary(spark: SparkSession, path: str, sources: list[str] | None = None, terms: tuple[str, str] | None = None, pushdown: bool = False) -> DataFrame:
    """The raw responses of the sources kept under path (all, if none are named), of all terms or of those from one to
    another. pushdown: take filters from Spark as well; all uses of one such frame in a query share what was pushed
    last, so load one for each filter."""
    workers_import(spark)
    spark.dataSource.register(DictionarySource)
    reader = spark.read.format(FORMAT).option("path", path)
    if sources:
        reader = reader.option("sources", ",".join(sources))
    if terms:
        reader = reader.option("from", terms[0]).option("to", terms[1])
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("pushdown", "true")
    return reader.load()


def lookup_dictionary(terms: DataFrame, path: str, sources: list[str | DictSource] | None = None, limit: int = 10) -> DataFrame:
    """Result rows for every distinct query of terms(query), from the dictionaries kept under path: of the given
    sources, or of all known ones that have one there."""
    spark, asked = terms.sparkSession, terms.select("query").distinct()
    if sources is None:
        have = Files(spark).folders(path)
        of = [s for s in known() if s.name in have]
    else:
        of = [source(s) if isinstance(s, str) else s for s in sources]
    if not of:
        return spark.createDataFrame([], LOOKUP)
    raw = {s: dictionary(spark, path, [s.name]).withColumnRenamed("term", "query").join(asked, "query", "left_semi") for s in of}
    return functools.reduce(DataFrame.unionByName, [s.flatten(df.select("query", "lang", "json"), limit) for s, df in raw.items()])

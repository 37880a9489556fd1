"""Termbases on a file system that Spark reaches: a folder each, with hash-bucketed files and numbered commits.

A commit is a small file log/<number>.json with the whole state: which folders make up each bucket of terms and
associations, the next ids, the meta values. It is created only if no one else has created that number; a writer that
comes second reads what was committed meanwhile. If that doesn't touch what its own change is based on, the change is
put on top of the new state as it is; otherwise it is made again from there. So readers see one state or another, and
no writer loses another's change.

Terms are in bucket id modulo BUCKETS, associations in that of their term. Adding rows adds folders. Changing rows adds
delta folders to the buckets that have such rows: changed rows as they are now, or ids of deleted ones. Reading
merges a bucket's deltas, the last one of an id winning, and leaves buckets without deltas as they are. A bucket with
many deltas or folders is compacted: read merged and written anew, the others untouched. Ids come from a high-water mark
that is raised by a commit of its own before rows are written, and are never used again. Folders that no recent commit
names are deleted by vacuum().
"""

from __future__ import annotations

import copy
import functools
import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators import termbase as ops
from lexforge.schemas import ASSOCIATIONS, DEFAULTS, EDITABLE, EXPORTED, TERMS
from lexforge.sources.files import Files

BUCKETS = 16
#: Deltas, and folders of rows, that a bucket may have before it is compacted.
MOST_DELTAS, MOST_FOLDERS = 8, 32
TRIES = 50

_SCHEMAS = {"terms": TERMS, "associations": ASSOCIATIONS}
#: The column that a table's buckets and deltas go by.
_KEYS = {"terms": "id", "associations": "term_id"}


def _now() -> Column:
    return F.date_trunc("second", F.current_timestamp())


class Conflict(Exception):
    """What a change is based on was changed by another writer."""


class Termbase:
    """One termbase. Opening an unknown one raises FileNotFoundError; create() makes it."""

    def __init__(self, spark: SparkSession, root: str, name: str = "terms"):
        self.spark, self.root, self.name_on_disk = spark, root.rstrip("/"), name
        self.path = f"{self.root}/{name}"
        self.files = Files(spark)
        if not self._numbers():
            raise FileNotFoundError(f"no termbase named {name!r}")

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, domain: str = "", buckets: int = BUCKETS) -> Termbase:
        none = {str(b): {"rows": [], "deltas": []} for b in range(buckets)}
        meta = {"name": name} | ({"domain": domain} if domain else {})
        state = {"buckets": buckets, "terms": none, "associations": none, "next_term": 1, "next_association": 1, "meta": meta, "batches": {}, "touched": {}}
        if not Files(spark).create(f"{root.rstrip('/')}/{name}/log/{0:020d}.json", json.dumps(state, ensure_ascii=False).encode()):
            raise FileExistsError(f"termbase {name!r} exists")
        return cls(spark, root, name)

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, name: str, domain: str = "") -> Termbase:
        try:
            return cls(spark, root, name)
        except FileNotFoundError:
            try:
                return cls.create(spark, root, name, domain)
            except FileExistsError:
                return cls(spark, root, name)

    # commits

    def _numbers(self) -> list[int]:
        return [int(n[:20]) for n in self.files.names(f"{self.path}/log") if re.fullmatch(r"\d{20}\.json", n)]

    def _load(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/log/{number:020d}.json"))

    def _state(self) -> dict:
        """The last commit, with its number."""
        last = max(self._numbers())
        return self._load(last) | {"number": last}

    def _touched_since(self, number: int, last: int) -> set[str]:
        out: set[str] = set()
        for n in range(number + 1, last + 1):
            out |= {f"{table}/{b}" for table, bs in self._load(n)["touched"].items() for b in bs}
        return out

    def _commit(self, based_on: int, change: dict, reads: Iterable[str] = ()) -> dict:
        """Put a change on top of the last state. reads: buckets (table/number) that it is based on, as they were at
        the commit based_on; Conflict if another writer has changed one since."""
        for _ in range(TRIES):
            state = self._state()
            last = state.pop("number")
            if last > based_on and set(reads) & self._touched_since(based_on, last):
                raise Conflict
            new = _applied(state, change)
            if self.files.create(f"{self.path}/log/{last + 1:020d}.json", json.dumps(new, ensure_ascii=False).encode()):
                return new | {"number": last + 1}
        raise TimeoutError(f"no commit in {TRIES} tries")

    def _again(self, change: Callable[[dict], object]) -> object:
        """Make a change from the last state, and again where another writer was faster."""
        for _ in range(TRIES):
            try:
                return change(self._state())
            except Conflict:
                continue
        raise TimeoutError(f"conflicts in {TRIES} tries")

    # rows

    def _write(self, table: str, rows: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Write rows in buckets; the folder of each bucket that has some."""
        folder = f"{table}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", F.pmod(F.col(_KEYS[table]), F.lit(buckets)).cast("int")).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in self.files.folders(f"{self.path}/{folder}") if n.startswith("_bucket=")}

    def _paths(self, parts: list[str]) -> list[str]:
        return [f"{self.path}/{p}" for p in parts]

    def _rows(self, table: str, state: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of all or some buckets, deltas merged."""
        some = state[table] if buckets is None else {str(b): state[table][str(b)] for b in buckets}
        clean = [p for b in some.values() if not b["deltas"] for p in b["rows"]]
        dirty = [b for b in some.values() if b["deltas"]]
        read = self.spark.read.schema(_SCHEMAS[table])
        out = read.parquet(*self._paths(clean)) if clean else self.spark.createDataFrame([], _SCHEMAS[table])
        if not dirty:
            return out
        rows = [p for b in dirty for p in b["rows"]]
        base = self.spark.read.schema(_SCHEMAS[table]).parquet(*self._paths(rows)) if rows else self.spark.createDataFrame([], _SCHEMAS[table])
        deltas = [[p for b in dirty if k < len(b["deltas"]) for p in b["deltas"][k]] for k in range(max(len(b["deltas"]) for b in dirty))]
        return out.unionByName(_merged(self.spark, table, base, [self._paths(d) for d in deltas]))

    @property
    def terms(self) -> DataFrame:
        return self._rows("terms", self._state())

    @property
    def associations(self) -> DataFrame:
        return self._rows("associations", self._state())

    def get_meta(self, key: str, default: str = "") -> str:
        return self._state()["meta"].get(key, default)

    def set_meta(self, key: str, value: str) -> None:
        self._commit(0, {"meta": {key: value}})

    @property
    def name(self) -> str:
        return self.get_meta("name", self.name_on_disk)

    @property
    def domain(self) -> str:
        return self.get_meta("domain")

    # changes

    def _reserve(self, kind: str, n: int) -> int:
        """The first of n new ids that nobody else gets."""
        return self._commit(0, {"reserve": {kind: n}})[kind] - n

    def add_rows(self, rows: DataFrame, order: list[str], batch: tuple[str, int] | None = None, state: dict | None = None) -> int:
        """Append rows of EDITABLE columns, with ids in the given order; the number added. batch: a stream's name and
        batch number, kept with the rows in one commit; a batch that was added before adds nothing. state: what the
        rows were chosen by; Conflict if terms have changed since."""
        staged_at = f"staged-{uuid.uuid4().hex}"
        # ids by position within range-partitioned parts: no window over all rows
        parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
        parted.write.parquet(f"{self.path}/{staged_at}")
        try:
            staged = self.spark.read.parquet(f"{self.path}/{staged_at}")
            sizes = {r["_p"]: (r["n"], r["lo"]) for r in staged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("lo")).collect()}
            n = sum(s[0] for s in sizes.values())
            before = state or self._state()
            if batch and before["batches"].get(batch[0], -1) >= batch[1]:
                return 0
            change: dict = {"batch": batch} if batch else {}
            if n:
                at, begin = self._reserve("next_term", n), {}
                for p in sorted(sizes):
                    begin[p] = at - sizes[p][1]
                    at += sizes[p][0]
                shift = F.create_map(*[x for p, b in begin.items() for x in (F.lit(p), F.lit(b).cast("long"))])
                out = staged.withColumn("id", F.col("_m") + shift[F.col("_p")]).withColumn("created_at", _now()).withColumn("updated_at", _now())
                typed = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TERMS])
                change["rows"] = {"terms": self._write("terms", typed, before["buckets"])}
            elif not batch:
                return 0
            reads = [f"terms/{b}" for b in before["terms"]] if state else []
            new = self._commit(before["number"], change, reads)
            self._compact_full(new)
            return n
        except _Added:
            return 0
        finally:
            self.files.delete(f"{self.path}/{staged_at}")

    def load(self, terms: DataFrame, associations: DataFrame | None = None) -> None:
        """Take over whole tables with the ids they have, into an empty termbase."""
        state = self._state()
        if any(b["rows"] or b["deltas"] for b in state["terms"].values()):
            raise ValueError("the termbase has terms already")
        top = terms.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
        rows = {"terms": self._write("terms", terms.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TERMS]), state["buckets"])}
        reserve = {"next_term": max(0, top + 1 - state["next_term"])}
        if associations is not None:
            rows["associations"] = self._write("associations", associations.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ASSOCIATIONS]), state["buckets"])
            reserve["next_association"] = max(0, associations.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0] + 1 - state["next_association"])
        self._commit(state["number"], {"rows": rows, "reserve": reserve}, [f"terms/{b}" for b in state["terms"]])

    def add_term(self, word: str, lang: str = "auto", type_: str = "", translation: str = "", domain: str = "", status: str = "draft", notes: str = "") -> int:
        n = self._reserve("next_term", 1)
        state = self._state()
        row = self.spark.createDataFrame([(n, word, lang, type_, translation, domain, status, notes)], "id long, " + ", ".join(f"{c} string" for c in EDITABLE))
        row = row.withColumn("created_at", _now()).withColumn("updated_at", _now()).select(*[f.name for f in TERMS])
        self._compact_full(self._commit(state["number"], {"rows": {"terms": self._write("terms", row, state["buckets"])}}))
        return n

    def _bucket(self, state: dict, term_id: int) -> int:
        return term_id % state["buckets"]

    def _update(self, state: dict, condition: Column, buckets: list[int] | None, now: Column, values: dict[str, str]) -> None:
        found = self._rows("terms", state, buckets).filter(condition)
        changed = ops.update_terms(found, F.lit(True), now, **values).withColumn("_gone", F.lit(False))
        deltas = self._write("terms", changed, state["buckets"])
        if deltas:
            # what chose the rows may be anywhere, unless the buckets were given
            reads = [f"terms/{b}" for b in (state["terms"] if buckets is None else buckets)]
            self._compact_full(self._commit(state["number"], {"deltas": {"terms": deltas}}, reads))

    def update_where(self, condition: Column, now: Column | None = None, **values: str) -> None:
        """Set fields of all terms for which the condition holds; only buckets with such terms get a delta."""
        if any(k in EDITABLE for k in values):
            self._again(lambda s: self._update(s, condition, None, _now() if now is None else now, values))

    def update_term(self, term_id: int, **values: str) -> None:
        if any(k in EDITABLE for k in values):
            self._again(lambda s: self._update(s, F.col("id") == term_id, [self._bucket(s, term_id)], _now(), values))

    def _delete(self, state: dict, condition: Column, buckets: list[int] | None) -> None:
        gone = self._rows("terms", state, buckets).filter(condition).select("id")
        rows = gone.select(*[F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in TERMS], F.lit(True).alias("_gone"))
        deltas = {"terms": self._write("terms", rows, state["buckets"])}
        if not deltas["terms"]:
            return
        # the ids as just written, so both tables lose the same terms
        ids = self.spark.read.schema("id long").parquet(*self._paths([p for ps in deltas["terms"].values() for p in ps])).select(F.col("id").alias("term_id"))
        deltas["associations"] = self._write("associations", ids, state["buckets"])
        reads = [f"terms/{b}" for b in (state["terms"] if buckets is None else buckets)]
        reads += [f"associations/{b}" for b in deltas["associations"]]
        self._compact_full(self._commit(state["number"], {"deltas": deltas}, reads))

    def delete_where(self, condition: Column) -> None:
        """Delete all terms for which the condition holds, and what hangs on them."""
        self._again(lambda s: self._delete(s, condition, None))

    def delete_term(self, term_id: int) -> None:
        self._again(lambda s: self._delete(s, F.col("id") == term_id, [self._bucket(s, term_id)]))

    def get_term(self, term_id: int) -> dict | None:
        state = self._state()
        row = ops.get_term(self._rows("terms", state, [self._bucket(state, term_id)]), term_id).head()
        return row.asDict() if row else None

    def add_association(self, term_id: int, related_word: str, relation_type: str = "", score: float = 1.0, source: str = "manual") -> int:
        n = self._reserve("next_association", 1)

        def add(state: dict) -> int:
            bucket = self._bucket(state, term_id)
            if ops.get_term(self._rows("terms", state, [bucket]), term_id).head() is None:
                raise ValueError(f"no term with id {term_id}")
            row = self.spark.createDataFrame([(n, term_id, related_word, relation_type, float(score), source)], ASSOCIATIONS)
            # the term may be deleted meanwhile
            self._compact_full(self._commit(state["number"], {"rows": {"associations": self._write("associations", row, state["buckets"])}}, [f"terms/{bucket}"]))
            return n

        return self._again(add)

    def get_associations(self, term_id: int) -> list[dict]:
        state = self._state()
        return [r.asDict() for r in ops.associations_of(self._rows("associations", state, [self._bucket(state, term_id)]), term_id).collect()]

    def import_csv(self, path: str, dedup: bool = True) -> int:
        """Rows of a CSV file with a header, in its order; the number added."""
        rows = ops.normalise_import(read_terms_csv(self.spark, path))

        def add(state: dict) -> int:
            new = ops.new_rows(self._rows("terms", state), rows, ["_line"], dedup).select(*EDITABLE, "_line")
            return self.add_rows(new, ["_line"], state=state if dedup else None)

        return self._again(add)

    def merge(self, other: Termbase, dedup: bool = True) -> dict:
        """Copy the other's terms that are new here: added, skipped, total_other."""
        theirs = other.terms.select("id", *EDITABLE)
        total = theirs.count()

        def add(state: dict) -> int:
            return self.add_rows(ops.new_rows(self._rows("terms", state), theirs, ["id"], dedup), ["id"], state=state if dedup else None)

        added = self._again(add)
        return {"added": added, "skipped": total - added, "total_other": total}

    # upkeep

    def _compact_full(self, state: dict) -> None:
        """Compact the buckets that have grown too many deltas or folders."""
        for table in _SCHEMAS:
            full = [int(b) for b, parts in state[table].items() if len(parts["deltas"]) > MOST_DELTAS or len(parts["rows"]) > MOST_FOLDERS]
            if full:
                self.compact(table, full)

    def compact(self, table: str = "terms", buckets: Iterable[int] | None = None) -> int:
        """Write these buckets anew (all that have a delta or several folders), deltas merged; the number of buckets. If
        another writer changes one meanwhile, nothing is done: a later change compacts it."""
        state = self._state()
        some = [int(b) for b, parts in state[table].items() if parts["deltas"] or len(parts["rows"]) > 1] if buckets is None else list(buckets)
        if not some:
            return 0
        new = self._write(table, self._rows(table, state, some), state["buckets"])
        try:
            self._commit(state["number"], {"replace": {table: {str(b): new.get(str(b), []) for b in some}}}, [f"{table}/{b}" for b in some])
        except Conflict:
            return 0
        return len(some)

    def vacuum(self, keep: int = 2, older_than: float = 86_400) -> int:
        """Delete commits but the last ones, and folders that these don't name; the number of folders. Younger ones may
        belong to a change that is being made, so they stay."""
        numbers = sorted(self._numbers())
        named: set[str] = set()
        for n in numbers[-keep:]:
            state = self._load(n)
            for table in _SCHEMAS:
                for parts in state[table].values():
                    named |= {p.split("/")[0] for p in [*parts["rows"], *[p for d in parts["deltas"] for p in d]]}
        gone = [f for f in self.files.folders(self.path) if f != "log" and f not in named and self.files.age(f"{self.path}/{f}") >= older_than]
        for f in gone:
            self.files.delete(f"{self.path}/{f}")
        for n in numbers[:-keep]:
            if self.files.age(f"{self.path}/log/{n:020d}.json") >= older_than:
                self.files.delete(f"{self.path}/log/{n:020d}.json")
        return len(gone)

    def stats(self) -> dict:
        state = self._state()
        return ops.stats(self._rows("terms", state), self._rows("associations", state), self.name, self.domain)


class _Added(Exception):
    """The batch was added by another run."""


def _applied(state: dict, change: dict) -> dict:
    """The state with a change: rows and deltas added, buckets replaced, ids reserved, meta values and batches set."""
    new = copy.deepcopy(state)
    touched: dict[str, set[str]] = {t: set() for t in _SCHEMAS}
    if change.get("batch"):
        name, number = change["batch"]
        if new["batches"].get(name, -1) >= number:
            raise _Added
        new["batches"][name] = number
    for what in ("rows", "deltas", "replace"):
        for table, buckets in change.get(what, {}).items():
            for b, parts in buckets.items():
                touched[table].add(b)
                if what == "rows":
                    new[table][b]["rows"] += parts
                elif what == "deltas":
                    new[table][b]["deltas"].append(parts)
                else:
                    new[table][b] = {"rows": parts, "deltas": []}
    for kind, n in change.get("reserve", {}).items():
        new[kind] += n
    new["meta"] |= change.get("meta", {})
    new["touched"] = {t: sorted(bs) for t, bs in touched.items() if bs}
    return new


def _merged(spark: SparkSession, table: str, base: DataFrame, deltas: list[list[str]], extra: Callable[[DataFrame], DataFrame] = lambda d: d, keys: tuple[str, ...] = ()) -> DataFrame:
    """base with deltas (each a list of folders, in their order) merged. extra adds the columns keys, which tell ids of
    several bases apart."""
    key = _KEYS[table]
    if table == "associations":  # only deletions, of a term's all; a deleted id never comes back
        gone = extra(spark.read.schema("term_id long").parquet(*[p for d in deltas for p in d])).select(key, *keys).distinct()
        return base.join(gone, [key, *keys], "left_anti").select(*base.columns)
    schema = T.StructType([*TERMS.fields, T.StructField("_gone", T.BooleanType())])
    each = [extra(spark.read.schema(schema).parquet(*d)).withColumn("_seq", F.lit(k)) for k, d in enumerate(deltas) if d]
    rows = functools.reduce(DataFrame.unionByName, each)
    last = rows.groupBy(key, *keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, *keys)]), "_seq").alias("_r"))
    kept = base.join(last.select(key, *keys), [key, *keys], "left_anti").select(*base.columns)
    new = last.filter("not _r._gone").select(*[F.col(c) if c in (key, *keys) else F.col(f"_r.{c}").alias(c) for c in base.columns])
    return kept.unionByName(new)


def read_terms_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's rows with their line order in _line; a leading byte order mark is dropped. An empty cell is an empty
    string, and so is one that a short row lacks."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", nullValue="\x00", emptyValue="")
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    df = df.na.fill("")
    # multiLine keeps a file in one partition, so the generated number follows the lines
    return df.withColumn("_line", F.monotonically_increasing_id())


def write_terms_csv(terms: DataFrame, folder: str, status: str | None = None) -> None:
    """Distributed CSV export of the seven exported columns."""
    ops.with_status(terms, status).select(*EXPORTED).write.csv(folder, header=True, quote='"', escape='"', emptyValue="", lineSep="\n")


def list_termbases(spark: SparkSession, root: str) -> list[dict]:
    """Name, domain, languages and size of every termbase; one that can't be read counts as empty. The terms of all
    are counted by one read, in which a row's folder tells its termbase; only if that fails are they read one by
    one, to find those that can't be."""
    root = root.rstrip("/")
    states: dict[str, dict | None] = {}
    for n in Files(spark).folders(root):
        try:
            states[n] = Termbase(spark, root, n)._state()
        except Exception:  # noqa: BLE001
            states[n] = None
    good = {n: s for n, s in states.items() if s is not None}
    counted = {}
    try:
        counted = _count_all(spark, root, good)
    except Exception:  # noqa: BLE001
        for n, s in good.items():
            try:
                counted |= _count_all(spark, root, {n: s})
            except Exception:  # noqa: BLE001
                states[n] = None
    out = []
    for n, s in states.items():
        langs, total = counted.get(n, ("", 0))
        meta = s["meta"] if s else {}
        out.append({"name": meta.get("name", n), "path": f"{root}/{n}", "domain": meta.get("domain", ""), "lang": langs, "total_terms": total})
    return out


def all_terms(spark: SparkSession, root: str, states: dict[str, dict]) -> DataFrame:
    """The terms of several termbases with the column base, by one read of all their files."""

    def at(n: str, parts: list[str]) -> list[str]:
        return [f"{root}/{n}/{p}" for p in parts]

    def named(df: DataFrame) -> DataFrame:
        # <root>/<base>/<folder>/_bucket=<n>/<file>
        return df.withColumn("base", F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -4)))

    every = [(n, b) for n, s in states.items() for b in s["terms"].values()]
    clean = [p for n, b in every if not b["deltas"] for p in at(n, b["rows"])]
    dirty = [(n, b) for n, b in every if b["deltas"]]
    none = spark.createDataFrame([], T.StructType([*TERMS.fields, T.StructField("base", T.StringType())]))
    out = named(spark.read.schema(TERMS).parquet(*clean)) if clean else none
    if dirty:
        rows = [p for n, b in dirty for p in at(n, b["rows"])]
        base = named(spark.read.schema(TERMS).parquet(*rows)) if rows else none
        most = max(len(b["deltas"]) for _, b in dirty)
        deltas = [[p for n, b in dirty if k < len(b["deltas"]) for p in at(n, b["deltas"][k])] for k in range(most)]
        out = out.unionByName(_merged(spark, "terms", base, deltas, named, ("base",)))
    return out


def _count_all(spark: SparkSession, root: str, states: dict[str, dict]) -> dict[str, tuple[str, int]]:
    """Languages and size of each termbase that has terms; a row for each termbase and language comes to the driver."""
    rows = ops.catalog_of(all_terms(spark, root, states)).collect() if states else []
    return {r["base"]: (r["langs"], r["total_terms"]) for r in rows}


def delete_termbase(spark: SparkSession, root: str, name: str) -> None:
    base = Termbase(spark, root, name)
    base.files.delete(base.path)


__all__ = ["DEFAULTS", "Files", "Termbase", "delete_termbase", "list_termbases", "read_terms_csv", "write_terms_csv"]

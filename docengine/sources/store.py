"""Databases of collections: versioned Parquet folders behind a pointer.

A collection is a set of folders ``<root>/<name>/v<N>-...`` and small files ``_meta/<number>.json``; the one of the largest
number names the folders of the current version with the schema, indexes and sensitive fields. An insert writes only its
own rows, as one more folder, and now and then the smaller folders with them; an update or delete writes the folders anew
that hold a row it touches, an upsert or merge all of them. What is written is checked before the next metadata file is
made, so readers see one version or the other. That file is made only if no one else made it: writers of one process take
turns under one lock a root, and a writer whom another driver forestalls does its work again on what it finds then.
"""

from __future__ import annotations

import functools
import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError, ConflictError, DuplicateKeyError, ExistsError, NotFoundError, TooLargeError, UnauthorizedError
from docengine.functions import paths, values
from docengine.functions.filters import compile_filter, sure
from docengine.operators import aggregate as agg
from docengine.operators import find as finding
from docengine.operators import graph, indexes, repair, triggers, updates
from docengine.operators.hooks import Context, Hooks
from docengine.operators.security import Security
from docengine.plans.lineage import cut
from docengine.sources import files

SYSTEM = ("_users", "_roles", "_triggers")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not name or name.startswith("$") or "\0" in name or "/" in name or name in SYSTEM:
        raise BadFilterError(f"{name!r} is no collection name")
    return name


def new_ids() -> Any:
    """Time-ordered unique ids, as text."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0"), F.translate(F.uuid(), "-", ""))


def widened(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both, structs merged, numbers widened."""
    out = []
    for f in a.fields:
        g = paths.field_of(b, f.name)
        if g is None or updates.same(f.dataType, g.dataType):
            out.append(f)
        elif isinstance(f.dataType, T.StructType) and isinstance(g.dataType, T.StructType):
            out.append(T.StructField(f.name, widened(f.dataType, g.dataType)))
        else:
            out.append(T.StructField(f.name, updates.merged(f.dataType, g.dataType)))
    return T.StructType(out + [g for g in b.fields if paths.field_of(a, g.name) is None])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *((updates.fitted(paths.column(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields)
    )


@dataclass
class WriteResult:
    inserted: int = 0
    matched: int = 0
    modified: int = 0
    deleted: int = 0
    upserted: list[str] = field(default_factory=list)
    rejected: DataFrame | None = None


#: Folders of one collection that a scan reads, at most; beyond, an insert writes the smaller half into its own.
MAX_PARTS = 32
#: How often a writer tries again that other drivers forestall.
TRIES = 20
_LOCKS: dict[str, threading.RLock] = {}


def writing(run: Callable) -> Callable:
    """A write of a collection: under the lock of its root, and again from the start if another driver wrote meanwhile."""

    @functools.wraps(run)
    def turn(self: Collection, *args: Any, **kwargs: Any) -> Any:
        with self.db.lock:
            if self._base is not None:  # a part of another write
                return run(self, *args, **kwargs)
            for left in reversed(range(TRIES)):
                self._base = self._last()
                try:
                    return run(self, *args, **kwargs)
                except ConflictError:
                    if not left:
                        raise
                finally:
                    self._base = None

    return turn


class Collection:
    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name
        #: Number of the metadata file that the write under way builds on.
        self._base: int | None = None

    # Metadata.

    @property
    def path(self) -> str:
        return f"{self.db.root}/{self.name}"

    def _last(self) -> int:
        every = [n for n in files.names(self.db.spark, f"{self.path}/_meta") if n.endswith(".json")]
        if not every:
            raise NotFoundError(f"no collection {self.name}")
        return int(every[-1].removesuffix(".json"))

    @property
    def meta(self) -> dict:
        self.db.allow()
        for _ in range(TRIES):
            found = files.read_json(self.db.spark, meta_path(self.path, self._base if self._base is not None else self._last()))
            if found is not None:
                return found
        raise NotFoundError(f"no collection {self.name}")

    def _save_meta(self, **changed: Any) -> None:
        base = self._base if self._base is not None else self._last()
        if not files.create(self.db.spark, meta_path(self.path, base + 1), json.dumps(self.meta | changed, indent=1, sort_keys=True).encode()):
            raise ConflictError(f"{self.name} was written by another")
        if self._base is not None:
            self._base = base + 1
        files.delete(self.db.spark, meta_path(self.path, base - KEPT_META))

    @property
    def indexes(self) -> list[indexes.Index]:
        return [indexes.Index(tuple(i["fields"]), i["unique"]) for i in self.meta["indexes"]]

    @writing
    def ensure_index(self, fields: list[str], unique: bool = False) -> None:
        new = indexes.Index(tuple(fields), unique)
        every = indexes.add(self.indexes, new)
        indexes.check_unique(self.df, [new])
        self._save_meta(indexes=[i.to_json() for i in every])

    @writing
    def drop_index(self, fields: list[str]) -> None:
        left = [i for i in self.indexes if i.fields != tuple(fields)]
        if len(left) == len(self.indexes):
            raise NotFoundError("no such index")
        self._save_meta(indexes=[i.to_json() for i in left])

    @writing
    def set_sensitive_fields(self, fields: list[str]) -> None:
        self._save_meta(sensitive=list(fields))

    # Reading.

    @property
    def df(self) -> DataFrame:
        meta = self.meta
        if not meta["version"]:
            return self.db.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))
        return self._read(T.StructType.fromJson(meta["schema"]), meta["parts"])

    def _read(self, schema: T.StructType, parts: list[str]) -> DataFrame:
        return self.db.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts))

    def get(self, id_: str):
        row = finding.get(self.df, id_).first()
        if row is None:
            raise NotFoundError(f"no document {id_}")
        return row

    def find(self, filter_: dict | None = None, **options: Any) -> DataFrame:
        return finding.find(self.df, filter_, **options)

    def count(self, filter_: dict | None = None) -> int:
        return finding.count(self.df, filter_)

    def distinct(self, key: str, filter_: dict | None = None) -> DataFrame:
        return finding.distinct(self.df, key, filter_)

    def aggregate(self, pipeline: list[dict]) -> DataFrame:
        return agg.aggregate(self.df, pipeline, self.db.table)

    def explain(self, filter_: dict | None = None) -> finding.ExplainResult:
        return finding.explain(self.df, filter_, [i.fields for i in self.indexes])

    # Writing.

    def _touched(self, pick: Callable[[DataFrame], DataFrame]) -> list[str]:
        """The folders of the rows that ``pick`` takes from the collection."""
        named = self.df.withColumn("__part", F.regexp_extract(F.input_file_name(), r"/(v\d+[^/]*)/[^/]*$", 1))
        return [r["__part"] for r in pick(named).select("__part").distinct().collect()]

    def _write(self, df: DataFrame, keep: list[str] = ()) -> None:
        """The next version: these rows and the folders to ``keep``; checked, then pointed to."""
        meta, spark = self.meta, self.db.spark
        keep = list(keep)
        if len(keep) >= MAX_PARTS:
            small = sorted(keep, key=lambda p: files.size(spark, f"{self.path}/{p}"))[: MAX_PARTS // 2]
            keep = [p for p in keep if p not in small]
            df = df.unionByName(self._read(df.schema, small))
        df = df.select("_id", *(paths.column(c) for c in df.columns if c != "_id"))
        part = f"v{meta['version'] + 1}-{uuid.uuid4().hex[:8]}"
        parts = [*keep, part]
        try:
            indexes.layout(df, self.indexes).write.parquet(f"{self.path}/{part}")
            new = self._read(df.schema, [part])
            big = new.where(repair.size_of(new) > repair.MAX_BYTES).select("_id").first()
            if big is not None:
                raise TooLargeError(f"document {big[0]} is larger than 1 MiB")
            indexes.check_new(new, self._read(df.schema, keep) if keep else None, self.indexes)
            # What the last version alone still read stays for its readers until the next rewrite.
            dropped = [p for p in meta["parts"] if p not in parts]
            self._save_meta(version=meta["version"] + 1, schema=df.schema.jsonValue(), parts=parts, old=dropped or meta["old"])
        except Exception:
            files.delete(spark, f"{self.path}/{part}")
            raise
        if dropped:
            for gone in meta["old"]:
                files.delete(spark, f"{self.path}/{gone}")

    def _rows(self, docs: DataFrame | list[dict]) -> DataFrame:
        if isinstance(docs, list):
            docs = rows_of(self.db.spark, docs)
        if "_id" not in docs.columns:
            docs = docs.withColumn("_id", F.lit(None).cast("string"))
        # Ids are made once: random ones would change each time the plan runs.
        docs = docs.withColumn("_id", F.coalesce(F.when(F.col("_id").cast("string") != "", F.col("_id").cast("string")), new_ids()))
        return cut(docs, "insert")

    def _events(self, what: str, docs: DataFrame | None, old: DataFrame | None) -> DataFrame | None:
        return self.db.hooks.before(Context(f"before_{what}", self.name, docs, old, self.db))

    def _after(self, what: str, docs: DataFrame | None, old: DataFrame | None) -> None:
        self.db.hooks.after(Context(f"after_{what}", self.name, docs, old, self.db))

    @writing
    def insert(self, docs: DataFrame | list[dict], ordered: bool = True) -> WriteResult:
        """Duplicates of an ``_id`` are errors: ordered, nothing is written and DuplicateKeyError is raised; unordered, the
        first of each id is written and the others are returned as ``rejected``."""
        new, now = self._events("insert", self._rows(docs), None), self.df
        first = repair.first_by(new, ["_id"], [F.to_json(F.struct("*"))])
        fresh = first.join(now.select("_id"), "_id", "left_anti")
        n, good = new.count(), fresh.count()
        if good < n and ordered:
            twice = new.groupBy("_id").count().where("count > 1").select("_id")
            known = new.join(now.select("_id"), "_id", "left_semi").select("_id")
            raise DuplicateKeyError(f"duplicate _id {twice.unionByName(known).first()[0]}")
        rejected = new.join(now.select("_id"), "_id", "left_semi") if good < n else None
        schema = widened(now.schema, new.schema)
        if self._reads_as(now, schema):
            self._write(conform(fresh, schema), keep=self.meta["parts"])
        else:
            self._write(conform(now, schema).unionByName(conform(fresh, schema)))
        self._after("insert", fresh, None)
        return WriteResult(inserted=good, rejected=rejected)

    def _reads_as(self, now: DataFrame, schema: T.StructType) -> bool:
        """Whether the folders can be read with ``schema``: new columns are null in older ones, other types are not read."""
        return bool(self.meta["version"]) and all(updates.same(f.dataType, schema[f.name].dataType) for f in now.schema.fields)

    @writing
    def upsert(self, docs: DataFrame | list[dict]) -> WriteResult:
        """Whole documents by id: new ones are added, old ones replaced."""
        now = self.df
        new = self._rows(docs)
        old = now.join(new.select("_id"), "_id", "left_semi")
        new = self._events("upsert", repair.first_by(new, ["_id"], [F.to_json(F.struct("*"))]), old)
        schema = widened(now.schema, new.schema)
        matched, total = old.count(), new.count()
        kept = now.join(new.select("_id"), "_id", "left_anti")
        self._write(conform(kept, schema).unionByName(conform(new, schema)))
        self._after("upsert", new, old)
        return WriteResult(inserted=total - matched, matched=matched, modified=matched)

    @writing
    def merge(self, patch: DataFrame, remove: list[str] = ()) -> WriteResult:
        """Shallow merge by ``_id``: the patch's columns replace a matched document's, ``remove`` empties others."""
        now = self.df
        names = [c for c in patch.columns if c != "_id"]
        sent = patch.select(F.col("_id").alias("__pid"), *(paths.column(c).alias(f"__p_{c}") for c in names)).dropDuplicates(["__pid"])
        joined = now.join(sent, now["_id"] == sent["__pid"], "left")
        hit = F.col("__pid").isNotNull()
        out = []
        schema = widened(now.schema, patch.schema)
        for f in schema.fields:
            own = paths.field_of(now.schema, f.name)
            before = updates.fitted(paths.column(f.name), own.dataType, f.dataType) if own else F.lit(None).cast(f.dataType)
            if f.name in names:
                before = F.when(hit, F.col(f"`__p_{f.name}`").cast(f.dataType)).otherwise(before)
            elif f.name in remove and f.name != "_id":
                before = F.when(hit, F.lit(None).cast(f.dataType)).otherwise(before)
            out.append(before.alias(f.name))
        old = now.join(patch.select("_id"), "_id", "left_semi")
        n = old.count()
        new = joined.select(*out)
        self._write(new)
        self._after("update", self.df.join(patch.select("_id"), "_id", "left_semi"), old)
        return WriteResult(matched=n, modified=n)

    @writing
    def update(self, filter_: dict | None, update: dict, *, multi: bool = False, upsert: bool = False) -> WriteResult:
        """Update operators or a replacement on the documents that match; without ``multi`` on the first by ``_id``."""
        now = self.df
        here = sure(compile_filter(filter_, now.schema, strict=True))
        if not multi:
            first = now.where(here).agg(F.min("_id")).first()[0]
            here = F.col("_id") == F.lit(first) if first is not None else F.lit(False)
        matched = now.where(here).count()
        if not matched:
            return self._upsert_one(filter_, update) if upsert else WriteResult()
        old = now.where(here)
        new = self._events("update", updates.updated(old, update), old)
        schema = widened(now.schema, new.schema)
        modified = updates.changes(old, new).count()
        if modified:
            touched = self._touched(lambda df: df.where(here)) if self._reads_as(now, schema) else self.meta["parts"]
            base = self._read(now.schema, touched)
            self._write(conform(base.where(~here), schema).unionByName(conform(new, schema)), keep=[p for p in self.meta["parts"] if p not in touched])
        self._after("update", new, old)
        return WriteResult(matched=matched, modified=modified)

    def _upsert_one(self, filter_: dict | None, update: dict) -> WriteResult:
        base = updates.seed(filter_)
        if updates.is_operators(update):
            nested = rows_of(self.db.spark, [{"_id": str(base.get("_id") or uuid.uuid4().hex)}])
            plain = {k: v for k, v in base.items() if k != "_id"}
            made = updates.updated(nested, {"$set": plain}) if plain else nested
            made = updates.updated(made, update, inserting=True)
        else:
            made = rows_of(self.db.spark, [{"_id": str(update.get("_id") or base.get("_id") or uuid.uuid4().hex)} | {k: v for k, v in update.items() if k != "_id"}])
        id_ = made.first()["_id"]
        self.insert(made)
        return WriteResult(upserted=[id_])

    @writing
    def delete(self, filter_: dict | None = None, *, one: bool = False) -> WriteResult:
        """All that match, or the first by ``_id``."""
        now = self.df
        gone = now.where(compile_filter(filter_, now.schema)).select("_id")
        return self.delete_ids(gone.orderBy("_id").limit(1) if one else gone)

    @writing
    def delete_ids(self, ids: DataFrame) -> WriteResult:
        now = self.df
        old = now.join(ids.select("_id").distinct(), "_id", "left_semi")
        self._events("delete", None, old)
        n = old.count()
        if n:
            touched = self._touched(lambda df: df.join(ids.select("_id"), "_id", "left_semi"))
            gone = cut(old, "deleted")
            base = self._read(now.schema, touched)
            self._write(base.join(gone.select("_id"), "_id", "left_anti"), keep=[p for p in self.meta["parts"] if p not in touched])
            self._after("delete", None, gone)
        return WriteResult(deleted=n)

    @writing
    def find_and_modify(self, filter_: dict | None, *, sort: finding.SortSpec = None, update: dict | None = None, remove: bool = False, new: bool = False, upsert: bool = False, fields: Any = None):
        """The first match in order, changed or removed; returns it as it was, or as it is with ``new``."""
        row = self.find(filter_, sort=sort, limit=1).first()
        if row is None:
            if not upsert or remove:
                return None
            made = self.update(filter_, update or {}, upsert=True)
            return finding.project(self.find({"_id": made.upserted[0]}), fields).first() if new else None
        key = {"_id": row["_id"]}
        before = finding.project(self.find(key), fields).first()
        self.delete(key) if remove else self.update(key, update or {})
        return finding.project(self.find(key), fields).first() if new and not remove else before

    @writing
    def compact(self, partitions: int | None = None) -> None:
        """The current version in fewer files; older ones go."""
        df = self.df
        n = partitions or max(1, self.stats()["size"] >> 27)
        self._write(df.coalesce(n))
        for name in self.meta["old"]:
            files.delete(self.db.spark, f"{self.path}/{name}")
        self._save_meta(old=[])

    @writing
    def repair(self) -> repair.Report:
        unique = [i for i in self.indexes if i.unique]
        said = repair.report(self.df, unique)
        self._write(repair.repaired(self.df, unique))
        return said

    def stats(self) -> dict:
        meta = self.meta
        size = sum(files.size(self.db.spark, f"{self.path}/{p}") for p in meta["parts"])
        return {"ns": self.name, "count": self.count(), "nindexes": len(meta["indexes"]), "size": size, "version": meta["version"]}


def rows_of(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """A few Python documents as rows; types are those of the first value that is there."""
    names = list(dict.fromkeys(k for d in docs for k in d))
    plain = [{k: values.plain(v) for k, v in d.items()} for d in docs]
    kinds: list[T.StructField] = []
    for n in names:
        kind: T.DataType = T.NullType()
        for d in plain:
            if n in d:
                own = values.type_of(d[n])
                kind = widened(kind, own) if isinstance(kind, T.StructType) and isinstance(own, T.StructType) else updates.merged(kind, own)
        kinds.append(T.StructField(n, T.StringType() if isinstance(kind, T.NullType) or n == "_id" else _whole(kind)))
    schema = T.StructType(kinds)
    data = [tuple(_fit(d.get(f.name), f.dataType) for f in schema.fields) for d in plain]
    return spark.createDataFrame(data, schema)


def _whole(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_whole(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _whole(f.dataType)) for f in kind.fields])
    return kind


def _fit(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        if not math.isfinite(value):
            raise BadFilterError("a document holds no NaN or infinity")
        return float(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return tuple(_fit(value.get(f.name), f.dataType) for f in kind.fields)
    return value


#: Metadata files that stay behind the current one.
KEPT_META = 3


def meta_path(path: str, number: int) -> str:
    return f"{path}/_meta/{number:012d}.json"


class Database:
    """Collections under one folder. System collections hold users, roles and triggers and are reached by their own calls."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lock, self.hooks = _LOCKS.setdefault(self.root, threading.RLock()), Hooks()
        self.security = Security(self)
        self._trust = threading.local()
        self.jobs: dict[str, Any] = {}
        self.views: dict[str, DataFrame] = {}
        self._hooked: dict[str, int] = {}
        for t in self.list_triggers():
            self._hook(t)

    # Access. From the first user on, only sessions get through to the collections, and what hooks do for them.

    @contextmanager
    def trusted(self) -> Iterator[None]:
        self._trust.depth = getattr(self._trust, "depth", 0) + 1
        try:
            yield
        finally:
            self._trust.depth -= 1

    @property
    def is_trusted(self) -> bool:
        return bool(getattr(self._trust, "depth", 0))

    def allow(self) -> None:
        if not self.is_trusted and self.security.active:
            raise UnauthorizedError("the database has users: a session is needed")

    # Catalog.

    def __getitem__(self, name: str) -> Collection:
        return self.collection(name)

    def has(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.root}/{name}/_meta")

    def collection(self, name: str, create: bool = False) -> Collection:
        check_name(name)
        if not self.has(name):
            if not create:
                raise NotFoundError(f"no collection {name}")
            self.create(name)
        return Collection(self, name)

    def create(self, name: str) -> Collection:
        self.allow()
        empty = {"version": 0, "schema": None, "parts": [], "old": [], "indexes": [], "sensitive": []}
        if self.has(check_name(name)) or not files.create(self.spark, meta_path(f"{self.root}/{name}", 0), json.dumps(empty).encode()):
            raise ExistsError(f"collection {name} exists")
        return Collection(self, name)

    def drop(self, name: str) -> None:
        self.allow()
        c = self.collection(name)
        if self.hooks.any("delete", name):
            c.delete({})
        files.delete(self.spark, c.path)

    def collections(self) -> list[str]:
        return [n for n in files.names(self.spark, self.root) if not n.startswith("_") and self.has(n)]

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame under a name, for reading."""
        self.views[check_name(name)] = df

    def table(self, name: str) -> DataFrame:
        self.allow()
        return self.views[name] if name in self.views else self.collection(name).df

    def stats(self) -> dict:
        every = [self.collection(n).stats() for n in self.collections()]
        return {"collections": len(every), "objects": sum(s["count"] for s in every), "indexes": sum(s["nindexes"] for s in every), "dataSize": sum(s["size"] for s in every), "each": every}

    # Whole-database operations.

    def snapshot(self, target: str) -> None:
        """A full copy elsewhere that opens as a database."""
        for name in self.collections():
            c, meta = self.collection(name), self.collection(name).meta
            if meta["version"]:
                c.df.write.mode("overwrite").parquet(f"{target}/{name}/v1")
            files.write_json(self.spark, meta_path(f"{target}/{name}", 0), meta | {"version": min(meta["version"], 1), "parts": ["v1"][: meta["version"]], "old": []})
        for name in ("_triggers.json", "_security.json", "_database.json"):
            found = files.read_json(self.spark, f"{self.root}/{name}")
            if found is not None:
                files.write_json(self.spark, f"{target}/{name}", found)

    def compact(self) -> None:
        for name in self.collections():
            self.collection(name).compact()

    @property
    def schema_version(self) -> int:
        return (files.read_json(self.spark, f"{self.root}/_database.json") or {}).get("schemaVersion", 0)

    def migrate(self, migrations: list[tuple[int, str, Callable[[Database], None]]]) -> list[str]:
        """Runs (version, name, up) forward in order; a store newer than all of them is refused."""
        steps = sorted(migrations, key=lambda m: m[0])
        if len({m[0] for m in steps}) < len(steps) or any(m[0] <= 0 for m in steps):
            raise BadFilterError("migration versions are positive and differ")
        if steps and self.schema_version > steps[-1][0]:
            raise BadFilterError("the database is newer than these migrations")
        done = []
        for version, name, up in steps:
            if version > self.schema_version:
                up(self)
                files.write_json(self.spark, f"{self.root}/_database.json", {"schemaVersion": version, "at": time.time()})
                done.append(name)
        return done

    # Triggers.

    def _hook(self, t: triggers.Trigger) -> None:
        if t.enabled:
            add = self.hooks.on_async if t.run_async else self.hooks.on
            self._hooked[t.id] = add(t.event, t.collection, triggers.action_run(t))

    def create_trigger(self, t: triggers.Trigger) -> str:
        triggers.validate(t)
        t.id = t.id or uuid.uuid4().hex
        every = {x.id: x for x in self.list_triggers()} | {t.id: t}
        files.write_json(self.spark, f"{self.root}/_triggers.json", [x.to_json() for x in every.values()])
        if t.id in self._hooked:
            self.hooks.off(self._hooked.pop(t.id))
        self._hook(t)
        return t.id

    def delete_trigger(self, id_: str) -> None:
        left = [t for t in self.list_triggers() if t.id != id_]
        if len(left) == len(self.list_triggers()):
            raise NotFoundError(f"no trigger {id_}")
        files.write_json(self.spark, f"{self.root}/_triggers.json", [x.to_json() for x in left])
        if id_ in self._hooked:
            self.hooks.off(self._hooked.pop(id_))

    def list_triggers(self) -> list[triggers.Trigger]:
        return [triggers.Trigger(**t) for t in files.read_json(self.spark, f"{self.root}/_triggers.json") or []]

    # Graph.

    def add_edge(self, edge_type: str, start: str, end: str, props: dict | None = None) -> str:
        name = graph.edge_collection(edge_type)
        graph.check_edge(start, end)
        id_ = (props or {}).get("_id") or uuid.uuid4().hex
        self.collection(name, create=True).insert([{**(props or {}), "_id": id_, "_from": start, "_to": end}])
        return id_

    def remove_edge(self, edge_type: str, id_: str) -> None:
        if not self.collection(graph.edge_collection(edge_type)).delete({"_id": id_}).deleted:
            raise NotFoundError(f"no edge {id_}")

    def edges(self, edge_type: str) -> DataFrame:
        name = graph.edge_collection(edge_type)
        if name in self.views or name in self.collections():
            df = self.table(name)
            if "_from" in df.columns:
                return df
        return self.spark.createDataFrame([], "_id string, _from string, _to string")

    def neighbors(self, edge_type: str, vertex: str, direction: str = graph.OUT) -> list[str]:
        return [r[0] for r in graph.neighbors(self.edges(edge_type), vertex, direction).collect()]

    def traverse(self, edge_type: str, start: str, **options: Any) -> DataFrame:
        return graph.traverse(self.edges(edge_type), start, **options)

    def shortest_path(self, edge_type: str, start: str, end: str, **options: Any) -> list[str] | None:
        return graph.shortest_path(self.edges(edge_type), start, end, **options)


def open_database(spark: SparkSession, root: str) -> Database:
    return Database(spark, root)


class Registry:
    """Databases by name under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._open = spark, root.rstrip("/"), {}

    def __getitem__(self, name: str) -> Database:
        if name not in self._open:
            self._open[name] = Database(self.spark, f"{self.root}/{check_name(name)}")
        return self._open[name]

    def databases(self) -> list[str]:
        return files.names(self.spark, self.root)

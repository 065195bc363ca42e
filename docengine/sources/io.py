"""Import and export of CSV, JSON and NDJSON, and discovery of fields."""

from __future__ import annotations

import json
import threading
import uuid
from contextlib import nullcontext
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError
from docengine.functions import paths
from docengine.functions.filters import compile_filter
from docengine.plans.lineage import cut, shared_dir
from docengine.sources import files

if TYPE_CHECKING:
    from docengine.sources.store import Collection

# Fields that no export shows.
ALWAYS_HIDDEN = ("refresh_token", "access_token", "password", "password_hash")
BOM = b"\xef\xbb\xbf"


def detect_format(start: bytes) -> str:
    """``[`` begins JSON; ``{`` NDJSON if there is more than one line, else JSON; anything else is CSV."""
    text = start.removeprefix(BOM).decode("utf-8", "replace").lstrip()
    if text.startswith("["):
        return "json"
    if text.startswith("{"):
        return "ndjson" if len([x for x in text.splitlines() if x.strip()]) > 1 and text.splitlines()[0].rstrip().endswith("}") else "json"
    return "csv"


def csv_value(c: Column) -> Column:
    """A trimmed cell as JSON text of what it spells: true, false, null, a number, or a string."""
    cell = F.trim(c)
    return (
        F.when(cell.isNull() | (cell == "") | (F.lower(cell) == "null"), F.lit(None).cast("string"))
        .when(F.lower(cell).isin("true", "false"), F.lower(cell))
        .otherwise(cell)
    )


def infer_csv(df: DataFrame) -> DataFrame:
    """Columns of strings with the narrowest type that all their cells spell: boolean, double, else string. One pass."""
    cells = df.select(*(csv_value(paths.column(c)).alias(c) for c in df.columns))
    names = [c for c in cells.columns if c != "_id"]
    if not names:
        return cells
    checks = []
    for i, c in enumerate(names):
        at = paths.column(c)
        checks += [
            F.coalesce(F.bool_and(at.isin("true", "false")), F.lit(False)).alias(f"b{i}"),
            F.coalesce(F.bool_and(at.try_cast("double").isNotNull() & ~F.lower(at).rlike("nan|inf|[df]$")), F.lit(False)).alias(f"n{i}"),
        ]
    fits = cells.where(" OR ".join(f"`{c}` IS NOT NULL" for c in names)).agg(*checks).first()
    kinds = {c: "boolean" if fits[f"b{i}"] else "double" if fits[f"n{i}"] else "string" for i, c in enumerate(names)}
    return cells.select(*(paths.column(c).cast(kinds.get(c, "string")).alias(c) for c in cells.columns))


def read(spark: SparkSession, path: str, format: str = "auto", *, strict: bool = True) -> DataFrame:
    """Documents of a file or folder. ``strict`` fails on a bad NDJSON line; otherwise it is skipped."""
    if format == "auto":
        format = detect_format(files.head(spark, path))
    if format == "csv":
        return infer_csv(spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
    if format == "json":
        return with_string_id(spark.read.json(path, multiLine=True))
    if format == "ndjson":
        return with_string_id(spark.read.json(path, mode="FAILFAST" if strict else "DROPMALFORMED"))
    raise BadFilterError(f"unknown format {format}")


def with_string_id(df: DataFrame) -> DataFrame:
    if "_id" not in df.columns:
        return df
    kind = df.schema["_id"].dataType
    at = F.col("_id")
    if isinstance(kind, T.StructType):
        at = at["$oid"] if "$oid" in kind.names else F.to_json(at)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        at = F.when(at == F.floor(at), at.cast("long").cast("string")).otherwise(at.cast("string"))
    return df.withColumn("_id", at.cast("string"))


#: Bytes of a file that a preview looks at.
PREVIEW_BYTES = 64 << 10


def preview(spark: SparkSession, path: str, format: str = "auto", rows: int = 10) -> list[dict]:
    """The first rows, read from the first PREVIEW_BYTES alone; JSON that one document fills is cut at its last whole one."""
    start = files.head(spark, path, PREVIEW_BYTES)
    format = detect_format(start) if format == "auto" else format
    text = start.removeprefix(BOM).decode("utf-8", "ignore")
    if len(start) == PREVIEW_BYTES:
        text = text.rpartition("\n")[0] or text
    if format == "json":
        text = "\n".join(json.dumps(x) for x in whole_documents(text))
    beside = f"{shared_dir(spark)}/preview-{uuid.uuid4().hex}"
    files.write_bytes(spark, beside, text.encode())
    try:
        found = read(spark, beside, "ndjson" if format == "json" else format, strict=False)
        return [r.asDict(recursive=True) for r in found.limit(min(rows, 10)).collect()]
    finally:
        files.delete(spark, beside)


def whole_documents(text: str) -> list[Any]:
    """The documents of a JSON array, or the one document, that ``text`` holds to their end."""
    decoder, at, out = json.JSONDecoder(), 0, []
    text = text.lstrip().removeprefix("[")
    while True:
        at += len(text) - at - len(text[at:].lstrip(" \t\r\n,"))
        try:
            found, at = decoder.raw_decode(text, at)
        except ValueError:
            return out
        out.append(found)


@dataclass
class ImportReport:
    read: int
    inserted: int
    replaced: int
    rejected: int


def import_into(collection: Collection, path: str, format: str = "auto", *, mode: str = "insert") -> ImportReport:
    """A file's documents into a collection in one version: ``insert`` skips ids that are there, ``upsert`` replaces."""
    docs = cut(read(collection.db.spark, path, format, strict=False), "import")
    n = docs.count()
    if mode == "insert":
        done = collection.insert(docs, ordered=False)
        return ImportReport(n, done.inserted, 0, n - done.inserted)
    if mode == "upsert":
        done = collection.upsert(docs)
        return ImportReport(n, done.inserted, done.matched, n - done.inserted - done.matched)
    raise BadFilterError("mode is insert or upsert")


@dataclass
class ImportJob:
    """An import under way: its id, state (running, done or failed), counters and error."""

    id: str
    state: str = "running"
    report: ImportReport | None = None
    error: str = ""
    _thread: threading.Thread | None = field(default=None, repr=False)

    def wait(self, seconds: float | None = None) -> ImportJob:
        if self._thread is not None:
            self._thread.join(seconds)
        return self


def start_import(collection: Collection, path: str, format: str = "auto", *, mode: str = "insert") -> ImportJob:
    """``import_into`` in the background; the database keeps the job by its id in ``jobs``."""
    job = ImportJob(uuid.uuid4().hex)
    allowed = collection.db.is_trusted

    def run() -> None:
        try:
            with collection.db.trusted() if allowed else nullcontext():
                job.report = import_into(collection, path, format, mode=mode)
            job.state = "done"
        except Exception as e:
            job.state, job.error = "failed", str(e)

    collection.db.jobs[job.id] = job
    job._thread = threading.Thread(target=run, daemon=True)
    job._thread.start()
    return job


def cell(c: Column, kind: T.DataType) -> Column:
    """A value as a CSV cell: nested ones as JSON, integral numbers without a fraction."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def export_columns(df: DataFrame, hidden: list[str] = (), sort: bool = True) -> DataFrame:
    """``_id`` first, then the other columns sorted (or as they come), as cells; hidden ones are left out."""
    gone = {*ALWAYS_HIDDEN, *hidden} if sort else set(hidden)
    names = [c for c in df.columns if c != "_id" and c not in gone]
    names = (["_id"] if "_id" in df.columns else []) + (sorted(names) if sort else names)
    return df.select(*(F.coalesce(cell(paths.column(c), df.schema[c].dataType), F.lit("")).alias(c) for c in names))


def export_csv(df: DataFrame, path: str, hidden: list[str] = ()) -> None:
    """One CSV file with a byte-order mark and a header, written in parallel and joined as streams."""
    spark, out = df.sparkSession, export_columns(df, hidden)
    beside = f"{shared_dir(spark)}/export-{id(df)}-{abs(hash(path))}"
    out.write.mode("overwrite").csv(beside, header=False, escape='"', emptyValue="")
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in out.columns)
    files.merge(spark, beside, path, BOM + header.encode() + b"\n")
    files.delete(spark, beside)


def export(df: DataFrame, path: str, format: str, filter_: dict | None = None) -> None:
    """A folder of CSV, JSON or NDJSON part files of the rows that pass; columns as they come."""
    kept = df.where(compile_filter(filter_, df.schema)) if filter_ else df
    if format == "csv":
        export_columns(kept, sort=False).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
    elif format in ("json", "ndjson"):
        kept.write.mode("overwrite").json(path)
    else:
        raise BadFilterError(f"unknown format {format}")


TYPE_NAMES = {"number": "number", "string": "string", "bool": "boolean", "time": "date", "array": "array", "object": "object", "null": "null"}


def discover(df: DataFrame, max_scan: int = 1000, depth: int = 3) -> dict[str, Any]:
    """Fields, dotted paths down to ``depth`` and types, of columns with a value among the first ``max_scan`` rows."""
    part = df.limit(max_scan)
    found: list[tuple[str, Column, T.DataType]] = []

    def walk(prefix: str, at: Column, kind: T.DataType, level: int) -> None:
        found.append((prefix, at, kind))
        if isinstance(kind, T.StructType) and level < depth:
            for f in kind.fields:
                walk(f"{prefix}.{f.name}", at[f.name], f.dataType, level + 1)

    for f in df.schema.fields:
        walk(f.name, paths.column(f.name), f.dataType, 1)
    seen = part.agg(F.count(F.lit(1)).alias("n"), *(F.count(at).alias(f"c{i}") for i, (_, at, _) in enumerate(found))).first()
    there = [(p, k) for i, (p, _, k) in enumerate(found) if seen[f"c{i}"] or p == "_id"]
    tops = sorted({p for p, _ in there if "." not in p}, key=lambda p: (p != "_id", p))
    more = bool(df.limit(max_scan + 1).count() > max_scan)
    return {"fields": tops, "paths": sorted(p for p, _ in there), "types": {p: TYPE_NAMES.get(paths.family(k), "other") for p, k in there}, "scanned": seen["n"], "truncated": more}


def discovered(df: DataFrame) -> DataFrame:
    """Field statistics as a table: path, type, and how many rows have a value; one pass over the whole table."""
    names = df.columns
    stats = df.agg(*(F.count(paths.column(c)).alias(f"c{i}") for i, c in enumerate(names)))
    rows = [F.struct(F.lit(c).alias("path"), F.lit(TYPE_NAMES.get(paths.family(df.schema[c].dataType), "other")).alias("type"), F.col(f"c{i}").alias("n")) for i, c in enumerate(names)]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

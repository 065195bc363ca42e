"""Declarative triggers: a filter and actions, compiled to Column expressions over the mutated documents."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import partial
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.errors import BadFilterError
from docengine.functions import paths, values
from docengine.functions.filters import compile_filter
from docengine.operators.hooks import EVENTS, Context
from docengine.operators.updates import Draft, fitted

if TYPE_CHECKING:
    from docengine.sources.store import Database

ACTIONS = {"set": ("fields",), "unset": ("fields",), "insert": ("collection", "doc"), "update": ("collection", "id", "fields"), "upsert": ("collection", "id", "doc"), "delete": ("collection", "id")}


@dataclass
class Trigger:
    event: str
    collection: str
    actions: list[dict]
    filter: dict = field(default_factory=dict)
    enabled: bool = True
    run_async: bool = False
    id: str | None = None
    name: str = ""

    def to_json(self) -> dict:
        return asdict(self)


def validate(t: Trigger) -> None:
    if t.event not in EVENTS:
        raise BadFilterError(f"unknown event {t.event}")
    if t.run_async and not t.event.startswith("after_"):
        raise BadFilterError("asynchronous triggers are after triggers")
    if not t.actions:
        raise BadFilterError("a trigger has an action")
    for a in t.actions:
        kind = a.get("type")
        if kind not in ACTIONS:
            raise BadFilterError(f"unknown action {kind}")
        if kind == "unset" and not t.event.startswith("before_"):
            raise BadFilterError("unset is for before triggers")
        if kind in ("set", "unset") and t.event.endswith("_delete"):
            raise BadFilterError(f"{kind} has no document on delete")
        for key in ACTIONS[kind]:
            if not a.get(key):
                raise BadFilterError(f"{kind} needs {key}")


def template(spec: Any, docs: DataFrame, old: str = "__old") -> Column:
    """A template as a Column: ``{"$get": "f"}`` is a top-level field of the document, ``{"$get": "old.f"}`` of the one
    before; objects and lists are filled in throughout."""
    if isinstance(spec, dict) and set(spec) == {"$get"}:
        name = spec["$get"]
        if name.startswith("old."):
            kind = docs.schema[old].dataType if old in docs.columns else None
            return F.col(old)[name[4:]] if kind is not None and paths.field_of(kind, name[4:]) else F.lit(None).cast("string")
        return paths.column(name) if name in docs.columns else F.lit(None).cast("string")
    if isinstance(spec, dict):
        return F.struct(*(template(v, docs, old).alias(k) for k, v in spec.items()))
    if isinstance(spec, list):
        return F.array(*(template(v, docs, old) for v in spec))
    made = values.literal(spec)
    return made.cast("string") if spec is None else made


def with_old(docs: DataFrame, old: DataFrame | None) -> DataFrame:
    if old is None:
        return docs
    image = old.select(F.col("_id").alias("__oid"), F.struct("*").alias("__old"))
    return docs.join(image, docs["_id"] == image["__oid"], "left").drop("__oid")


def before(t: Trigger, docs: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The documents as the trigger's set and unset leave them, where its filter holds."""
    seen = with_old(docs, old)
    here = compile_filter(t.filter, docs.schema, strict=True)
    d = Draft(docs.schema)
    for a in t.actions:
        if a["type"] == "set":
            for name, spec in a["fields"].items():
                if name != "_id":
                    value = template(spec, seen)
                    d.write(name, value, seen.select(value.alias("v")).schema["v"].dataType)
        elif a["type"] == "unset":
            for name in a["fields"]:
                if name != "_id":
                    d.remove(name)
    out = {}
    for name, value in d.changed.items():
        have = paths.field_of(docs.schema, name)
        kept = fitted(paths.column(name), have.dataType, d.kinds[name]) if have else F.lit(None).cast(d.kinds[name])
        out[name] = F.when(here, value.cast(d.kinds[name])).otherwise(kept)
    return (seen.withColumns(out) if out else seen).drop("__old")


def rows(t: Trigger, action: dict, docs: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """What an insert, upsert, update or delete action sends: one row per document that the filter takes, with the
    filled-in fields and, but for insert, ``_id``."""
    seen = with_old(docs, old).where(compile_filter(t.filter, docs.schema))
    spec = action.get("doc") or action.get("fields") or {}
    columns = [template(v, seen).alias(k) for k, v in spec.items() if action["type"] == "insert" or k != "_id"]
    if action["type"] != "insert":
        columns.insert(0, template(action["id"], seen).cast("string").alias("_id"))
    return seen.select(*columns)


def action_run(t: Trigger, again: bool = False):
    """The trigger as a hook. With ``again`` documents may come a second time: inserts leave out ids that are there."""

    def run(context: Context) -> DataFrame | None:
        docs = context.docs if context.docs is not None else context.old
        if context.event.startswith("before_"):
            return before(t, docs, context.old)
        db: Database = context.db
        for a in t.actions:
            kind = a["type"]
            if kind == "set":
                here = docs.where(compile_filter(t.filter, docs.schema))
                made = here.select("_id", *(template(v, with_old(here, context.old)).alias(k) for k, v in a["fields"].items() if k != "_id"))
                db[t.collection if t.collection not in ("", "*") else context.collection].merge(made)
            else:
                sent = rows(t, a, docs, context.old)
                target = db.collection(a["collection"], create=kind in ("insert", "upsert"))
                {"insert": partial(target.insert, ordered=not again), "upsert": target.upsert, "update": target.merge, "delete": target.delete_ids}[kind](sent)
        return None

    return run

"""Roles and sessions: what a user may read and write, and fields that a role never shows."""

from __future__ import annotations

import hashlib
import hmac
import os
import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row

from docengine.errors import ExistsError, ForbiddenError, NotFoundError, UnauthorizedError
from docengine.functions.filters import fields_used
from docengine.operators import find as finding
from docengine.operators import graph, updates
from docengine.operators.aggregate import aggregate
from docengine.operators.find import sort_keys
from docengine.plans.stages import parse
from docengine.sources import files

if TYPE_CHECKING:
    from docengine.sources.store import Collection, Database


@dataclass
class Permission:
    collection: str
    read: bool = False
    write: bool = False
    field_deny: list[str] = field(default_factory=list)


#: Seconds that a session lasts.
SESSION_SECONDS = 24 * 3600.0


class Security:
    """Users and roles of a database. From the first user on, only sessions may read and write."""

    def __init__(self, db: Database, session_seconds: float = SESSION_SECONDS):
        self.db, self.path, self.session_seconds = db, f"{db.root}/_security.json", session_seconds

    def load(self) -> dict:
        return files.read_json(self.db.spark, self.path) or {"users": {}, "roles": {}}

    def _save(self, state: dict) -> None:
        files.write_json(self.db.spark, self.path, state)

    @property
    def active(self) -> bool:
        return bool(self.load()["users"])

    def create_role(self, name: str, permissions: list[Permission]) -> None:
        state = self.load()
        state["roles"][name] = [asdict(p) for p in permissions]
        self._save(state)

    def create_user(self, user: str, password: str, roles: list[str]) -> None:
        state = self.load()
        if user in state["users"]:
            raise ExistsError(f"user {user} exists")
        self._check_roles(state, roles)
        state["users"][user] = _secret(password) | {"roles": roles}
        self._save(state)

    def change_password(self, user: str, password: str) -> None:
        """The user's sessions end."""
        state = self._with_user(user)
        state["users"][user] |= _secret(password)
        self._save(state)

    def set_user_roles(self, user: str, roles: list[str]) -> None:
        state = self._with_user(user)
        self._check_roles(state, roles)
        state["users"][user]["roles"] = roles
        self._save(state)

    def _with_user(self, user: str) -> dict:
        state = self.load()
        if user not in state["users"]:
            raise NotFoundError(f"no user {user}")
        return state

    def _check_roles(self, state: dict, roles: list[str]) -> None:
        for r in roles:
            if r not in state["roles"]:
                raise NotFoundError(f"no role {r}")

    def delete_user(self, user: str) -> None:
        state = self._with_user(user)
        state["users"].pop(user)
        self._save(state)

    def reset(self) -> None:
        self._save({"users": {}, "roles": {}})

    def authenticate(self, user: str, password: str) -> Session:
        found = self.load()["users"].get(user)
        if found is None or not hmac.compare_digest(found["hash"], _derived(password, bytes.fromhex(found["salt"]))):
            raise UnauthorizedError("wrong user or password")
        return Session(self, user, found["hash"], time.time() + self.session_seconds)


def _secret(password: str) -> dict:
    salt = os.urandom(16)
    return {"salt": salt.hex(), "hash": _derived(password, salt)}


def _derived(password: str, salt: bytes) -> str:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1).hex()


def named_by(stages: list[dict]) -> Iterator[tuple[str | None, str]]:
    """Fields of the source that a pipeline names, as (foreign collection or None, path); behind a stage that makes new
    documents names are its own."""
    for stage in parse(stages):
        arg = stage.arg
        if stage.op == "$match":
            yield from ((None, f) for f in fields_used(arg))
        elif stage.op == "$sort":
            yield from ((None, f) for f, _ in arg)
        elif stage.op == "$unwind":
            yield None, arg["path"]
        elif stage.op == "$project":
            yield from ((None, f) for f, kept in arg.items() if kept)
        elif stage.op == "$lookup":
            yield None, arg["localField"]
            yield arg["from"], arg["foreignField"]
        elif stage.op == "$group":
            yield from ((None, f) for f in _paths_in(arg))
        if stage.op in ("$group", "$count"):
            return


def _paths_in(spec: Any) -> Iterator[str]:
    if isinstance(spec, str) and spec.startswith("$"):
        yield spec.lstrip("$")
    elif isinstance(spec, dict) and set(spec) != {"$literal"}:
        for v in spec.values():
            yield from _paths_in(v)


def named_in_update(update: dict) -> Iterator[str]:
    """Fields that update operators read or write. A replacement names none: it reads nothing."""
    if updates.is_operators(update):
        for op, spec in update.items():
            for path, arg in spec.items():
                yield path
                if op == "$rename":
                    yield str(arg)


class Session:
    """A user's view of a database: denied columns are dropped before anything else runs, and a filter, sort, pipeline or
    update that names one is refused. Roles are those that the user has now; the session ends with its time, when it is
    revoked, and when the user goes or gets another password."""

    def __init__(self, security: Security, user: str, stamp: str, until: float):
        self.security, self.db, self.user, self.revoked = security, security.db, user, False
        self._stamp, self._until = stamp, until

    def revoke(self) -> None:
        self.revoked = True

    def _of(self, collection: str) -> list[Permission]:
        state = self.security.load()
        found = state["users"].get(self.user)
        if self.revoked or time.time() >= self._until or found is None or found["hash"] != self._stamp:
            raise UnauthorizedError("the session has ended")
        every = [Permission(**p) for r in found["roles"] for p in state["roles"].get(r, [])]
        return [p for p in every if p.collection in (collection, "*")]

    def denied(self, collection: str) -> set[str]:
        return {f for p in self._of(collection) for f in p.field_deny}

    def check(self, collection: str, write: bool = False) -> None:
        if not any(p.write if write else p.read for p in self._of(collection)):
            raise ForbiddenError(f"{self.user} may not {'write' if write else 'read'} {collection}")

    def _probe(self, collection: str, names: Iterable[str]) -> None:
        deny = self.denied(collection)
        for name in names:
            if name.split(".")[0] in deny:
                raise ForbiddenError(f"{name} is not shown")

    def _writing(self, collection: str, names: Iterable[str] = (), create: bool = False) -> Collection:
        self.check(collection, write=True)
        self._probe(collection, names)
        return self.db.collection(collection, create=create)

    def _as_shown(self, collection: str, row: Row | None) -> Row | None:
        if row is None:
            return None
        deny = self.denied(collection)
        return Row(**{k: v for k, v in row.asDict().items() if k not in deny})

    # Reading.

    def df(self, collection: str) -> DataFrame:
        self.check(collection)
        with self.db.trusted():
            return self.db.table(collection).drop(*self.denied(collection))

    def collections(self) -> list[str]:
        return [n for n in self.db.collections() if any(p.read for p in self._of(n))]

    def find(self, collection: str, filter_: dict | None = None, **options: Any) -> DataFrame:
        df = self.df(collection)
        self._probe(collection, fields_used(filter_) | {k for k, _ in sort_keys(options.get("sort"))})
        return finding.find(df, filter_, **options)

    def get(self, collection: str, id_: str):
        return finding.get(self.df(collection), id_).first()

    def count(self, collection: str, filter_: dict | None = None) -> int:
        self._probe(collection, fields_used(filter_))
        return finding.count(self.df(collection), filter_)

    def distinct(self, collection: str, key: str, filter_: dict | None = None) -> DataFrame:
        self._probe(collection, fields_used(filter_) | {key})
        return finding.distinct(self.df(collection), key, filter_)

    def aggregate(self, collection: str, pipeline: list[dict]) -> DataFrame:
        for foreign, name in named_by(pipeline):
            self._probe(foreign or collection, [name])
        return aggregate(self.df(collection), pipeline, self.df)

    def explain(self, collection: str, filter_: dict | None = None) -> finding.ExplainResult:
        df = self.df(collection)
        self._probe(collection, fields_used(filter_))
        with self.db.trusted():
            return finding.explain(df, filter_, [i.fields for i in self.db.collection(collection).indexes])

    def indexes(self, collection: str) -> list:
        self.check(collection)
        with self.db.trusted():
            return self.db.collection(collection).indexes

    def stats(self, collection: str) -> dict:
        self.check(collection)
        with self.db.trusted():
            return self.db.collection(collection).stats()

    def export_csv(self, collection: str, path: str) -> None:
        from docengine.sources.io import export_csv

        df = self.df(collection)
        with self.db.trusted():
            hidden = [] if collection in self.db.views else self.db.collection(collection).meta["sensitive"]
        export_csv(df, path, hidden)

    # Writing.

    def known_ids(self, collection: str, ids: list[str]) -> set[str]:
        """Which of these an insert would clash with; it would say so itself."""
        with self.db.trusted():
            own = self._writing(collection, create=True)
            return {r[0] for r in own.find({"_id": {"$in": ids}}).select("_id").collect()} if ids else set()

    def insert(self, collection: str, docs: Any, **options: Any):
        with self.db.trusted():
            return self._writing(collection, create=True).insert(docs, **options)

    def upsert(self, collection: str, docs: Any):
        with self.db.trusted():
            return self._writing(collection, create=True).upsert(docs)

    def merge(self, collection: str, patch: DataFrame, remove: list[str] = ()):
        with self.db.trusted():
            return self._writing(collection, [*patch.columns, *remove]).merge(patch, remove)

    def update(self, collection: str, filter_: dict | None, update: dict, *, upsert: bool = False, multi: bool = False):
        with self.db.trusted():
            own = self._writing(collection, [*fields_used(filter_), *named_in_update(update)], create=upsert)
            return own.update(filter_, update, multi=multi, upsert=upsert)

    def delete(self, collection: str, filter_: dict | None = None, **options: Any):
        with self.db.trusted():
            return self._writing(collection, fields_used(filter_)).delete(filter_, **options)

    def find_and_modify(self, collection: str, filter_: dict | None, *, sort: finding.SortSpec = None, update: dict | None = None, upsert: bool = False, fields: Any = None, **options: Any) -> Row | None:
        """Shows the document, so it takes leave to read as well."""
        names = [*fields_used(filter_), *(k for k, _ in sort_keys(sort)), *named_in_update(update or {}), *([k for k, v in fields.items() if v] if isinstance(fields, dict) else fields or [])]
        with self.db.trusted():
            self.check(collection)
            own = self._writing(collection, names, create=upsert)
            return self._as_shown(collection, own.find_and_modify(filter_, sort=sort, update=update, upsert=upsert, fields=fields, **options))

    def create(self, collection: str):
        self.check(collection, write=True)
        with self.db.trusted():
            return self.db.create(collection)

    def drop(self, collection: str) -> None:
        self.check(collection, write=True)
        with self.db.trusted():
            self.db.drop(collection)

    def ensure_index(self, collection: str, fields: list[str], unique: bool = False) -> None:
        """A unique index tells by its errors whether values repeat."""
        with self.db.trusted():
            self._writing(collection, fields, create=True).ensure_index(fields, unique)

    def drop_index(self, collection: str, fields: list[str]) -> None:
        with self.db.trusted():
            self._writing(collection).drop_index(fields)

    # Graph.

    def add_edge(self, edge_type: str, start: str, end: str, props: dict | None = None) -> str:
        self.check(graph.edge_collection(edge_type), write=True)
        with self.db.trusted():
            return self.db.add_edge(edge_type, start, end, props)

    def remove_edge(self, edge_type: str, id_: str) -> None:
        self.check(graph.edge_collection(edge_type), write=True)
        with self.db.trusted():
            self.db.remove_edge(edge_type, id_)

    def _walking(self, edge_type: str) -> None:
        name = graph.edge_collection(edge_type)
        self.check(name)
        self._probe(name, ["_from", "_to"])

    def neighbors(self, edge_type: str, vertex: str, direction: str = graph.OUT) -> list[str]:
        self._walking(edge_type)
        with self.db.trusted():
            return self.db.neighbors(edge_type, vertex, direction)

    def traverse(self, edge_type: str, start: str, **options: Any) -> DataFrame:
        self._walking(edge_type)
        with self.db.trusted():
            return self.db.traverse(edge_type, start, **options)

    def shortest_path(self, edge_type: str, start: str, end: str, **options: Any) -> list[str] | None:
        self._walking(edge_type)
        with self.db.trusted():
            return self.db.shortest_path(edge_type, start, end, **options)

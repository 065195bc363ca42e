"""Commands: documents in, documents out, over a database. Results go through the driver in pages."""

from __future__ import annotations

import itertools
import time
from typing import Any

from pyspark.sql import DataFrame

from docengine.errors import BadFilterError, DocEngineError, NotFoundError, UnknownCommandError
from docengine.functions import values
from docengine.operators import find as finding
from docengine.operators import graph
from docengine.operators.indexes import command_index
from docengine.sources.store import Database, Registry

BATCH, IDLE_SECONDS = 101, 600


def _whole(value: Any) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return 0


class Direct:
    """The calls that a session has too, on a database without users."""

    def __init__(self, db: Database):
        self.db = db

    def known_ids(self, name: str, ids: list[str]) -> set[str]:
        return {r[0] for r in self.db.collection(name, create=True).find({"_id": {"$in": ids}}).select("_id").collect()} if ids else set()

    def insert(self, name: str, docs: list[dict]):
        return self.db.collection(name, create=True).insert(docs)

    def update(self, name: str, *args: Any, **options: Any):
        return self.db.collection(name, create=True).update(*args, **options)

    def find_and_modify(self, name: str, *args: Any, **options: Any):
        return self.db.collection(name, create=options.get("upsert", False)).find_and_modify(*args, **options)

    def ensure_index(self, name: str, *args: Any) -> None:
        self.db.collection(name, create=True).ensure_index(*args)

    def indexes(self, name: str) -> list:
        return self.db.collection(name).indexes

    def create(self, name: str) -> None:
        self.db.create(name)

    def drop(self, name: str) -> None:
        self.db.drop(name)

    def __getattr__(self, call: str):
        return lambda name, *args, **options: getattr(self.db.collection(name), call)(*args, **options)


class Commands:
    """Runs commands on a database, or on those of a registry by ``$db``."""

    def __init__(self, db: Database, registry: Registry | None = None, session: Any = None):
        self.db, self.registry, self.session = db, registry, session
        self._cursors: dict[int, tuple[finding.Cursor, float, str]] = {}
        self._ids = itertools.count(1)
        self._started = time.time()

    def run(self, command: dict) -> dict:
        """The reply of a command; errors come as ``ok: 0`` with their code."""
        try:
            name = next(iter(command))
            run = getattr(self, "cmd_" + ALIASES.get(name, name), None)
            if run is None:
                raise UnknownCommandError(f"no such command: {name}")
            return {**run(command), "ok": 1}
        except DocEngineError as e:
            return {"ok": 0, "code": e.code, "errmsg": str(e), "codeName": type(e).__name__}

    # Helpers.

    @property
    def _target(self) -> Any:
        """Who runs the calls that name a collection: the session, or the database where there is none."""
        return self.session if self.session is not None else Direct(self.db)

    def _table(self, name: str) -> DataFrame:
        if self.session is not None:
            return self.session.df(name)
        try:
            return self.db.table(name)
        except NotFoundError:
            return self.db.spark.createDataFrame([], "_id string")

    def _reply(self, df: DataFrame, name: str, size: int | None, single: bool = False) -> dict:
        cursor = finding.Cursor(df)
        batch = [r.asDict(recursive=True) for r in cursor.next_batch(BATCH if size is None else size)] if size != 0 else []
        id_ = 0
        if not single and not cursor.done:
            id_ = next(self._ids)
            self._cursors[id_] = (cursor, time.time(), name)
        return {"cursor": {"firstBatch": batch, "id": id_, "ns": name}}

    def _sweep(self) -> None:
        for id_ in [i for i, (_, at, _) in self._cursors.items() if time.time() - at > IDLE_SECONDS]:
            self._cursors.pop(id_)[0].kill()

    # Reading.

    def cmd_find(self, c: dict) -> dict:
        limit = int(c.get("limit", 0))
        df = self._table(c["find"])
        if self.session is not None:
            out = self.session.find(c["find"], c.get("filter"), sort=c.get("sort"), skip=c.get("skip", 0), limit=limit, projection=c.get("projection"))
        else:
            out = finding.find(df, c.get("filter"), sort=c.get("sort") or {"_id": 1}, skip=c.get("skip", 0), limit=limit, projection=c.get("projection"))
        return self._reply(out, c["find"], c.get("batchSize"), c.get("singleBatch", False) or limit < 0)

    def cmd_getMore(self, c: dict) -> dict:
        self._sweep()
        if c["getMore"] not in self._cursors:
            error = NotFoundError("no such cursor")
            error.code = 43
            raise error
        cursor, _, name = self._cursors[c["getMore"]]
        batch = [r.asDict(recursive=True) for r in cursor.next_batch(c.get("batchSize"))]
        self._cursors[c["getMore"]] = (cursor, time.time(), name)
        if cursor.done:
            self._cursors.pop(c["getMore"])
        return {"cursor": {"nextBatch": batch, "id": 0 if cursor.done else c["getMore"], "ns": name}}

    def cmd_killCursors(self, c: dict) -> dict:
        killed = [i for i in c.get("cursors", []) if i in self._cursors]
        for i in killed:
            self._cursors.pop(i)[0].kill()
        return {"cursorsKilled": killed, "cursorsNotFound": [i for i in c.get("cursors", []) if i not in killed]}

    def cmd_count(self, c: dict) -> dict:
        name = c.get("count") or c.get("countDocuments") or c.get("estimatedDocumentCount")
        filter_ = c.get("query") or c.get("filter")
        return {"n": self.session.count(name, filter_) if self.session else finding.count(self._table(name), filter_)}

    def cmd_distinct(self, c: dict) -> dict:
        df = self.session.distinct(c["distinct"], c["key"], c.get("query")) if self.session else finding.distinct(self._table(c["distinct"]), c["key"], c.get("query"))
        return {"values": [r[0] for r in df.toLocalIterator()]}

    def cmd_aggregate(self, c: dict) -> dict:
        from docengine.operators.aggregate import aggregate

        name = c["aggregate"]
        df = self.session.aggregate(name, c["pipeline"]) if self.session else aggregate(self._table(name), c["pipeline"], self._table)
        return self._reply(df, name, (c.get("cursor") or {}).get("batchSize"))

    def cmd_explain(self, c: dict) -> dict:
        inner = c["explain"]
        done = self._target.explain(inner["find"], inner.get("filter"))
        return {"stage": done.plan, "index": done.index, "covered": done.covered, "exact": done.exact, "re_match": done.re_match, "pushed": done.pushed}

    # Writing.

    def cmd_insert(self, c: dict) -> dict:
        name, docs, errors, n = c["insert"], c["documents"], [], 0
        ordered = c.get("ordered", True)
        seen: set[str] = set()
        have = self._target.known_ids(name, [str(d["_id"]) for d in docs if "_id" in d])
        good = []
        for i, d in enumerate(docs):
            id_ = values.plain(d.get("_id"))
            if id_ is not None and (str(id_) in have or str(id_) in seen):
                errors.append({"index": i, "code": 11000, "errmsg": f"duplicate _id {id_}"})
                if ordered:
                    break
                continue
            seen.add(str(id_))
            good.append(d)
        if good:
            n = self._target.insert(name, good).inserted
        return {"n": n, **({"writeErrors": errors} if errors else {})}

    def cmd_update(self, c: dict) -> dict:
        n, modified, upserted = 0, 0, []
        for i, u in enumerate(c["updates"]):
            if u.get("multi") and not any(k.startswith("$") for k in u["u"]):
                raise BadFilterError("a replacement is of one document")
            done = self._target.update(c["update"], u.get("q"), u["u"], multi=u.get("multi", False), upsert=u.get("upsert", False))
            n += done.matched + len(done.upserted)
            modified += done.modified
            upserted += [{"index": i, "_id": x} for x in done.upserted]
        return {"n": n, "nModified": modified, **({"upserted": upserted} if upserted else {})}

    def cmd_delete(self, c: dict) -> dict:
        return {"n": sum(self._target.delete(c["delete"], d.get("q"), one=d.get("limit", 0) == 1).deleted for d in c["deletes"])}

    def cmd_findAndModify(self, c: dict) -> dict:
        name = c.get("findAndModify") or c.get("findandmodify")
        if bool(c.get("remove")) == bool(c.get("update")):
            raise BadFilterError("findAndModify takes remove or update")
        upsert = c.get("upsert", False)
        row = self._target.find_and_modify(name, c.get("query"), sort=c.get("sort"), update=c.get("update"), remove=c.get("remove", False), new=c.get("new", False), upsert=upsert, fields=c.get("fields"))
        found = row is not None
        last = {"n": int(found), **({} if c.get("remove") else {"updatedExisting": found})}
        return {"value": row.asDict(recursive=True) if found else None, "lastErrorObject": last}

    # Walks, by the parameters that the console's requests have: texts, of which those that are no number count as 0.

    def _walker(self) -> Any:
        return self.session if self.session is not None else self.db

    def cmd_graphTraverse(self, c: dict) -> dict:
        p = c["graphTraverse"]
        if not p.get("edge") or not p.get("start"):
            raise BadFilterError("edge and start are required")
        way = p.get("dir") if p.get("dir") in (graph.IN, graph.BOTH) else graph.OUT
        found = self._walker().traverse(p["edge"], p["start"], direction=way, max_depth=_whole(p.get("maxDepth")), min_depth=_whole(p.get("minDepth")), limit=_whole(p.get("limit")))
        return {"nodes": [{"vertex": r["vertex"], "depth": r["depth"]} for r in found.collect()]}

    def cmd_graphPath(self, c: dict) -> dict:
        p = c["graphPath"]
        if not all(p.get(k) for k in ("edge", "from", "to")):
            raise BadFilterError("edge, from and to are required")
        return {"path": self._walker().shortest_path(p["edge"], p["from"], p["to"], max_depth=_whole(p.get("maxDepth"))) or []}

    # Catalog.

    def cmd_create(self, c: dict) -> dict:
        self._target.create(c["create"])
        return {}

    def cmd_drop(self, c: dict) -> dict:
        self._target.drop(c["drop"])
        return {"ns": c["drop"]}

    def cmd_listCollections(self, c: dict) -> dict:
        import re

        want = (c.get("filter") or {}).get("name")
        names = sorted(self.session.collections()) if self.session is not None else sorted({*self.db.collections(), *self.db.views})
        if isinstance(want, str):
            names = [n for n in names if n == want]
        elif isinstance(want, dict):
            names = [n for n in names if n == want.get("$eq", n) and re.search(want.get("$regex", ""), n)]
        return {"cursor": {"id": 0, "firstBatch": [{"name": n, "type": "collection"} for n in names]}}

    def cmd_listDatabases(self, c: dict) -> dict:
        names = self.registry.databases() if self.registry else [self.db.root.rsplit("/", 1)[-1]]
        return {"databases": [{"name": n} for n in names]}

    def cmd_createIndexes(self, c: dict) -> dict:
        name = c["createIndexes"]
        before = len(self._target.indexes(name)) if self.db.has(name) else 0
        for i in c["indexes"]:
            new = command_index(i["key"], i.get("unique", False))
            self._target.ensure_index(name, list(new.fields), new.unique)
        return {"numIndexesBefore": before + 1, "numIndexesAfter": len(self._target.indexes(name)) + 1}

    def cmd_listIndexes(self, c: dict) -> dict:
        listed = [{"name": "_id_", "key": {"_id": 1}}]
        listed += [{"name": i.name, "key": dict.fromkeys(i.fields, 1), "unique": i.unique} for i in self._target.indexes(c["listIndexes"])]
        return {"cursor": {"id": 0, "firstBatch": listed}}

    def cmd_dropIndexes(self, c: dict) -> dict:
        which = c["index"]
        own = self._target.indexes(c["dropIndexes"])
        gone = own if which == "*" else [i for i in own if i.name == which or isinstance(which, dict) and i.fields == command_index(which).fields]
        if not gone and which != "*":
            raise NotFoundError("no such index")
        for i in gone:
            self._target.drop_index(c["dropIndexes"], list(i.fields))
        return {"nIndexesWas": len(own) + 1}

    def cmd_dbStats(self, c: dict) -> dict:
        if self.session is None:
            return self.db.stats()
        every = [self.session.stats(n) for n in self.session.collections()]
        return {"collections": len(every), "objects": sum(x["count"] for x in every), "indexes": sum(x["nindexes"] for x in every), "dataSize": sum(x["size"] for x in every), "each": every}

    def cmd_collStats(self, c: dict) -> dict:
        return self._target.stats(c["collStats"])

    # The server itself.

    def cmd_hello(self, c: dict) -> dict:
        return {"isWritablePrimary": True, "maxWireVersion": 17, "readOnly": False}

    def cmd_ping(self, c: dict) -> dict:
        return {}

    def cmd_buildInfo(self, c: dict) -> dict:
        return {"version": self.db.spark.version}

    def cmd_getLog(self, c: dict) -> dict:
        return {"log": [], "totalLinesWritten": 0}

    def cmd_connectionStatus(self, c: dict) -> dict:
        return {"authInfo": {"authenticatedUsers": [{"user": self.session.user}] if self.session else []}}

    def cmd_whatsmyuri(self, c: dict) -> dict:
        return {"you": "local"}

    def cmd_serverStatus(self, c: dict) -> dict:
        return {"uptime": time.time() - self._started, "cursors": len(self._cursors)}

    def cmd_startSession(self, c: dict) -> dict:
        return {"id": next(self._ids)}

    def cmd_endSessions(self, c: dict) -> dict:
        return {}

    def cmd_getParameter(self, c: dict) -> dict:
        return {}


ALIASES = {"isMaster": "hello", "ismaster": "hello", "countDocuments": "count", "estimatedDocumentCount": "count", "findandmodify": "findAndModify", "refreshSessions": "endSessions", "killSessions": "endSessions"}

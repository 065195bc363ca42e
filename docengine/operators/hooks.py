"""Hooks: Python callables around mutations. A hook works on the DataFrame of all documents that a mutation touches."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from docengine.errors import BadFilterError

if TYPE_CHECKING:
    from docengine.sources.store import Database

EVENTS = tuple(f"{when}_{what}" for what in ("insert", "update", "delete", "upsert") for when in ("before", "after"))
MAX_DEPTH = 8
QUEUE = 1024


@dataclass
class Context:
    """What a hook sees: the documents after (``docs``) and before (``old``) the mutation, and the database, unguarded."""

    event: str
    collection: str
    docs: DataFrame | None
    old: DataFrame | None
    db: Database
    depth: int = 0


@dataclass
class Hook:
    id: int
    event: str
    collection: str
    run: Callable[[Context], DataFrame | None]
    wait: bool = True


@dataclass
class Hooks:
    """A before hook returns the documents to go on with (none: as they are) or raises to veto. Errors of after hooks are
    kept in ``errors`` and stop nothing. Asynchronous ones run in one worker, in order."""

    hooks: dict[int, Hook] = field(default_factory=dict)
    errors: list[Exception] = field(default_factory=list)
    _next: int = 1
    _queue: Any = None
    _local: threading.local = field(default_factory=threading.local)

    def on(self, event: str, collection: str, run: Callable[[Context], DataFrame | None]) -> int:
        return self._add(event, collection, run, True)

    def on_async(self, event: str, collection: str, run: Callable[[Context], DataFrame | None]) -> int:
        if not event.startswith("after_"):
            raise BadFilterError("asynchronous hooks are after hooks")
        return self._add(event, collection, run, False)

    def _add(self, event: str, collection: str, run: Callable, wait: bool) -> int:
        if event not in EVENTS:
            raise BadFilterError(f"unknown event {event}")
        hook = Hook(self._next, event, collection, run, wait)
        self.hooks[hook.id] = hook
        self._next += 1
        return hook.id

    def off(self, id_: int) -> bool:
        return self.hooks.pop(id_, None) is not None

    def of(self, event: str, collection: str) -> list[Hook]:
        return [h for h in self.hooks.values() if h.event == event and h.collection in ("", "*", collection)]

    def any(self, what: str, collection: str) -> bool:
        return any(self.of(f"{when}_{what}", collection) for when in ("before", "after"))

    def before(self, context: Context) -> DataFrame | None:
        docs = context.docs
        for hook in self.of(context.event, context.collection):
            context.docs = docs
            made = self._call(hook, context)
            docs = made if made is not None else docs
        return docs

    def after(self, context: Context) -> None:
        for hook in self.of(context.event, context.collection):
            if hook.wait:
                self._quiet(hook, context)
            else:
                self._worker().put((hook, context, list(self._running)))

    @property
    def _running(self) -> list[int]:
        """The hooks that this thread is in, with those that an asynchronous one was called from."""
        if not hasattr(self._local, "running"):
            self._local.running = []
        return self._local.running

    def _call(self, hook: Hook, context: Context) -> DataFrame | None:
        if len(self._running) >= MAX_DEPTH or hook.id in self._running:
            raise BadFilterError("hooks call each other in a circle or too deep")
        self._running.append(hook.id)
        try:
            return hook.run(context)
        finally:
            self._running.pop()

    def _quiet(self, hook: Hook, context: Context) -> None:
        try:
            self._call(hook, context)
        except Exception as e:  # an after hook cannot undo what is done
            self.errors.append(e)

    def _worker(self) -> queue.Queue:
        if self._queue is None:
            self._queue = queue.Queue(QUEUE)

            def work() -> None:
                while True:
                    hook, context, self._local.running = self._queue.get()
                    with context.db.trusted():
                        self._quiet(hook, context)
                    self._queue.task_done()

            threading.Thread(target=work, daemon=True).start()
        return self._queue

    def wait_async(self) -> None:
        if self._queue is not None:
            self._queue.join()

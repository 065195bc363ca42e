"""Triggers over a stream of changes: each micro-batch of documents runs through a trigger's actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docengine.operators import triggers
from docengine.operators.hooks import Context
from docengine.sources.store import Database


def run(changes: DataFrame, trigger: triggers.Trigger, db: Database, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Runs an after trigger on ``changes``, a streaming DataFrame of documents. A batch that is run again after a failure
    must find its effects there, so insert actions should give an ``_id``; duplicates of one are left out."""
    triggers.validate(trigger)

    act = triggers.action_run(trigger, again=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        if trigger.enabled:
            act(Context(trigger.event, trigger.collection, batch, None, db))
        db.hooks.after(Context(trigger.event, trigger.collection, batch, None, db))

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

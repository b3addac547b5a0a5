"""Streams of writes: each micro-batch is one fold and one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Engine


def upsert(stream: DataFrame, engine: Engine, checkpoint: str, mode: str = "write", **trigger) -> StreamingQuery:
    """Apply a stream of rows (seq, entity, fields, version_id, written_at) to ``engine``.

    ``mode`` is write, guarded (a stale version is rejected) or log (rows also
    have op and window). The last batch applied is committed with its state, so
    that a batch delivered again after a failure is skipped.
    """

    steps = {"write": engine.write, "guarded": engine.compare_and_write, "log": engine.apply_log}
    if mode not in steps:
        raise ValueError(f"unknown mode {mode}")
    name = f"stream:{checkpoint}"

    def apply(batch: DataFrame, number: int) -> None:
        before = engine.batches.get(name)
        if before is not None and before["batch"] >= number:
            return
        engine.batches[name] = {"batch": number}
        try:
            steps[mode](batch)
        except Exception:
            # Not applied: the batch comes again.
            engine.batches.pop(name) if before is None else engine.batches.update({name: before})
            raise

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

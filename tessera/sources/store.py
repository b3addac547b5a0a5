"""Durable state: immutable Parquet generations behind one pointer file.

Entries lie in buckets by the hash of their key. A commit writes the buckets it
touches, and the tables it changes, to a new generation and then replaces the
pointer, so that readers see all of a commit or nothing and a small change does
not rewrite the rest. A second writer is found out by the generation it finds.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import slot
from tessera.functions.values import ENTRIES
from tessera.operators.backfill import COMMITTED
from tessera.operators.ingest import JOURNAL

SCHEMAS = {"journal": JOURNAL, "committed": COMMITTED}
#: Buckets of a new store; ``maintain`` doubles them as they grow beyond so many bytes, and gathers tables of more parts than that.
BUCKETS, BUCKET_BYTES, PARTS = 64, 1 << 30, 16


def _plain(x: object) -> str:
    return x.isoformat() if isinstance(x, datetime) else str(x)


class Store:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = BUCKETS):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        root = self._path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)
        self.pointer = self._read_pointer() or {"generation": 0, "tables": {}, "buckets": buckets, "entries": {}, "meta": {}}

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _read_pointer(self) -> dict | None:
        file = self._path(f"{self.path}/current.json")
        if not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    @property
    def generation(self) -> int:
        return self.pointer["generation"]

    @property
    def meta(self) -> dict:
        return self.pointer["meta"]

    def table(self, name: str) -> DataFrame:
        paths = self.pointer["tables"].get(name)
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """All entries, or those of some buckets: only their files are listed and read."""
        held = self.pointer["entries"]
        paths = [held[k] for k in sorted(held) if buckets is None or int(k) in buckets]
        return self.spark.read.schema(ENTRIES).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRIES)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys (entity), at most as many as there are buckets."""
        found = keys.select(slot(F.col("entity"), self.pointer["buckets"]).alias("k")).distinct().collect()
        return sorted(r.k for r in found)

    @contextmanager
    def staged(self, rows: DataFrame):
        """``rows`` written once beside the state, for a change that reads them several times; gone after it."""
        place = f"{self.path}/staged-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(place)
            yield self.spark.read.schema(rows.schema).parquet(place)
        finally:
            self._fs.delete(self._path(place), True)

    def size(self, place: str) -> int:
        return self._fs.getContentSummary(self._path(place)).getLength()

    def maintain(self, bucket_bytes: int = BUCKET_BYTES, parts: int = PARTS) -> bool:
        """Double the buckets until the largest would have at most ``bucket_bytes``, gather tables of more than ``parts`` parts; whether anything was due."""
        held, buckets = self.pointer["entries"], self.pointer["buckets"]
        largest = max((self.size(p) for p in held.values()), default=0)
        wanted = buckets
        while largest > bucket_bytes:
            wanted, largest = wanted * 2, largest // 2
        many = {n: self.table(n) for n, paths in self.pointer["tables"].items() if len(paths) > parts}
        if wanted == buckets and not many:
            return False
        grown = (self.entries(), list(range(wanted))) if wanted != buckets else None
        self.commit(many, entries=grown, buckets=wanted)
        return True

    def commit(
        self, tables: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
        entries: tuple[DataFrame, list[int]] | None = None, meta: dict | None = None, buckets: int | None = None,
        results: dict[str, DataFrame] | None = None,
    ) -> int:
        """Write the next generation and point to it.

        ``tables`` are replaced, ``append`` adds rows to a table, ``entries`` are
        all entries of the buckets named with them. What is left out stays. Another
        number of ``buckets`` comes with all entries. ``results`` are only written
        beside the generation (see ``result``).
        """
        buckets = buckets or self.pointer["buckets"]
        n = self.generation + 1
        # The folder is this writer's own, whoever else is writing.
        home, held = f"{self.path}/gen={n:08d}-{uuid.uuid4().hex[:12]}", dict(self.pointer["tables"])
        for name, frame in (tables or {}).items():
            held[name] = [f"{home}/{name}"]
            frame.write.mode("overwrite").parquet(held[name][0])
        for name, frame in (append or {}).items():
            held[name] = [*held.get(name, []), f"{home}/{name}-more"]
            frame.write.mode("overwrite").parquet(held[name][-1])
        for name, frame in (results or {}).items():
            frame.write.mode("overwrite").parquet(f"{home}/{name}")
        places = dict(self.pointer["entries"]) if buckets == self.pointer["buckets"] else {}
        if entries is not None:
            frame, touched = entries
            spread = frame.withColumn("bucket", slot(F.col("entity"), buckets)).hint("rebalance", "bucket")
            spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/entries")
            for k in touched:
                place = f"{home}/entries/bucket={k}"
                places.pop(str(k), None)
                if self._fs.exists(self._path(place)):
                    places[str(k)] = place
        pointer = {"generation": n, "home": home, "tables": held, "buckets": buckets, "entries": places, "meta": self.meta if meta is None else meta}
        text = json.dumps(pointer, default=_plain)
        self._replace_pointer(text)
        self.pointer = json.loads(text)
        self._drop_old()
        return n

    def result(self, name: str) -> DataFrame:
        """A result written with this generation; its files stay as long as the generation, ``keep`` commits at least."""
        return self.spark.read.parquet(f"{self.pointer['home']}/{name}")

    def _replace_pointer(self, text: str) -> None:
        """Write a new file, then rename it over the old one in one step, if that is still the one this store has read."""
        found = (self._read_pointer() or {"generation": 0})["generation"]
        if found != self.generation:
            raise RuntimeError(f"another writer has committed generation {found}; this one knows {self.generation}")
        draft, current = self._path(f"{self.path}/next.json"), self._path(f"{self.path}/current.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs, conf = self._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        context = fs.FileContext.getFileContext(self._fs.getUri(), conf)
        overwrite = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = fs.Options.Rename.OVERWRITE
        context.rename(draft, current, overwrite)

    def _drop_old(self) -> None:
        """Remove generations that neither the pointer nor a reader of the last few needs."""
        paths = [*self.pointer["entries"].values(), *(p for ps in self.pointer["tables"].values() for p in ps)]
        held = {m[0] for p in paths if (m := re.search(r"gen=[^/]+", p.removeprefix(self.path)))}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("gen=") and name not in held and int(name[4:12]) <= self.generation - self.keep:
                self._fs.delete(status.getPath(), True)

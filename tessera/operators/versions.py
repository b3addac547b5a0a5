"""Version lifecycle: draft, published, superseded, rolled back; one active version over all tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import Registry

DRAFT, PUBLISHED, SUPERSEDED, ROLLED_BACK = "draft", "published", "superseded", "rolled-back"
STATES = (DRAFT, PUBLISHED, SUPERSEDED, ROLLED_BACK)
# The edges of the lifecycle.
EDGES = {(DRAFT, PUBLISHED), (PUBLISHED, SUPERSEDED), (PUBLISHED, ROLLED_BACK), (SUPERSEDED, ROLLED_BACK)}


def can_transition(a: str, b: str) -> bool:
    return (a, b) in EDGES


@dataclass
class Version:
    id: str
    table_id: str
    state: str = DRAFT
    parent_id: str = ""
    fields: list[str] = field(default_factory=list)
    created_at: datetime | None = None
    published_at: datetime | None = None
    seq: int = 0

    def transition(self, to: str) -> None:
        if not can_transition(self.state, to):
            raise ValueError(f"version {self.id}: {self.state} cannot become {to}")
        self.state = to

    @property
    def is_active(self) -> bool:
        return self.state == PUBLISHED


class Manager:
    """Versions by id, in order of creation.

    With ``compat``, a rolled-back version's superseded parent stays superseded,
    so that no version is active, and switch events only know versions that are
    still published.
    """

    def __init__(self, registry: Registry, clock=None, compat: bool = False):
        self.registry, self.compat = registry, compat
        self.clock = clock or datetime.now
        self.versions: dict[str, Version] = {}
        self.active_id = ""
        self.hooks: list = []

    def _changed(self, *ids: str) -> None:
        for hook in self.hooks:
            hook([i for i in ids if i])

    def create(self, table_id: str) -> Version:
        table = self.registry.get(table_id)
        if table is None:
            raise KeyError(f"unknown table {table_id}")
        n = len(self.versions) + 1
        earlier = [v for v in self.list() if v.table_id == table_id]
        v = Version(f"{table_id}-v{n}", table_id, DRAFT, earlier[-1].id if earlier else "", table.field_names(), self.clock(), None, n)
        self.versions[v.id] = v
        return v

    def must_get(self, id: str) -> Version:
        if id not in self.versions:
            raise KeyError(f"unknown version {id}")
        return self.versions[id]

    def get(self, id: str) -> Version | None:
        return self.versions.get(id)

    def list(self) -> list[Version]:
        return sorted(self.versions.values(), key=lambda v: (v.created_at, v.seq))

    def publish(self, id: str) -> Version:
        v = self.must_get(id)
        v.transition(PUBLISHED)
        v.published_at = self.clock()
        before = self.versions.get(self.active_id)
        if before is not None and before.id != id and before.state == PUBLISHED:
            before.transition(SUPERSEDED)
        prior, self.active_id = self.active_id, id
        self._changed(prior, id)
        return v

    def rollback(self, id: str) -> Version:
        """Roll a version back and return its parent, which becomes the active one."""
        v = self.must_get(id)
        if v.state not in (PUBLISHED, SUPERSEDED):
            raise ValueError(f"version {id} is {v.state}")
        parent = self.versions.get(v.parent_id)
        if parent is None or parent.state == ROLLED_BACK:
            raise ValueError(f"version {id} has no parent to return to")
        v.transition(ROLLED_BACK)
        if can_transition(parent.state, PUBLISHED) or not self.compat:
            if not self.compat:
                # Contract: the parent is the active version, and the only published one.
                current = self.versions.get(self.active_id)
                if current is not None and current is not parent and current.state == PUBLISHED:
                    current.transition(SUPERSEDED)
                parent.published_at = parent.published_at or self.clock()
            parent.state = PUBLISHED
        self.active_id = parent.id
        self._changed(id, parent.id)
        return parent

    def resolve_active(self) -> Version | None:
        v = self.versions.get(self.active_id)
        return v if v is not None and v.is_active else None

    def switch_events(self, since: datetime, until: datetime) -> list[tuple[str, datetime]]:
        """(version id, time) of publishes in [since, until), then the end of the range with an empty id."""
        states = (PUBLISHED,) if self.compat else STATES
        found = [(v.id, v.published_at) for v in self.versions.values() if v.published_at and v.state in states and since <= v.published_at < until]
        return sorted([*found, ("", until)], key=lambda e: (e[1], e[0]))

    def state_dict(self) -> dict:
        return {"active_id": self.active_id, "versions": [asdict(v) for v in self.list()]}

    def load_dict(self, held: dict) -> None:
        self.active_id = held["active_id"]
        self.versions = {}
        for v in held["versions"]:
            for k in ("created_at", "published_at"):
                v[k] = datetime.fromisoformat(v[k]) if isinstance(v[k], str) else v[k]
            self.versions[v["id"]] = Version(**v)

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "id string, table_id string, state string, parent_id string, fields array<string>, created_at timestamp_ntz, published_at timestamp_ntz, seq int"
        return spark.createDataFrame([tuple(asdict(v).values()) for v in self.list()], schema)


def transitions(spark: SparkSession) -> DataFrame:
    """(a, b, allowed) for every pair of states."""
    return spark.createDataFrame([(a, b, can_transition(a, b)) for a in STATES for b in STATES], "a string, b string, allowed boolean")


def switch_windows(events: DataFrame, begin: datetime) -> DataFrame:
    """(window, begin, end): contiguous windows that end at each event after ``begin``; events (version_id, at)."""
    from pyspark.sql import Window

    order = Window.orderBy("at", "version_id")
    ends = events.select(F.lag("at", 1, begin).over(order).cast("timestamp_ntz").alias("begin"), F.col("at").alias("end"), "version_id")
    kept = ends.where(F.col("end") > F.col("begin"))
    return kept.select((F.row_number().over(Window.orderBy("end", "version_id")) - 1).alias("window"), "begin", "end")



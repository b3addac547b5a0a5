"""Tables: named, ordered, typed fields, and the registry that holds them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import KINDS

_SLOT = {"string": "s", "int": "i", "float": "f", "bool": "b"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str


@dataclass(frozen=True)
class Table:
    id: str
    name: str
    fields: tuple[Field, ...]

    def field_index(self, name: str) -> int:
        """Position of a field, -1 if there is none by that name."""
        return next((i for i, f in enumerate(self.fields) if f.name == name), -1)

    def has_field(self, name: str) -> bool:
        return self.field_index(name) >= 0

    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def validate(self) -> None:
        if not self.id.strip():
            raise ValueError("table id is blank")
        seen: set[str] = set()
        for f in self.fields:
            name = f.name.strip()
            if not name:
                raise ValueError(f"table {self.id}: blank field name")
            if name in seen:
                raise ValueError(f"table {self.id}: duplicate field {name}")
            if f.kind not in KINDS:
                raise ValueError(f"table {self.id}: field {name} has unknown type {f.kind}")
            seen.add(name)

    def to_wide(self, entries: DataFrame) -> DataFrame:
        """Entries with a typed column for each declared field; a value of another type is null there."""
        return entries.select("entity", *[typed(F.col("fields"), f).alias(f.name) for f in self.fields], "version_id", "written_at")


def typed(fields: Column, f: Field) -> Column:
    v = fields[f.name]
    return F.when(v.type == f.kind, v[_SLOT[f.kind]])


def _table(id: str, name: str, **kinds: str) -> Table:
    return Table(id, name, tuple(Field(k, v) for k, v in kinds.items()))


# The two built-in tables.
USER_PROFILE = _table("user_profile", "user profile", age="int", city="string", level="int", active_days="int", score="float", is_vip="bool")
ITEM_PROFILE = _table("item_profile", "item profile", category="string", price="float", stock="int", rating="float", on_sale="bool")


class Registry:
    """Tables by id; registering an id again replaces its table, existing versions keep their layout."""

    def __init__(self) -> None:
        self._tables: dict[str, Table] = {}

    def register(self, table: Table) -> None:
        table.validate()
        self._tables[table.id] = table

    def get(self, id: str) -> Table | None:
        return self._tables.get(id)

    def must_get(self, id: str) -> Table:
        if id not in self._tables:
            raise KeyError(f"unknown table {id}")
        return self._tables[id]

    def list(self) -> list[Table]:
        return [self._tables[k] for k in sorted(self._tables)]

    def count(self) -> int:
        return len(self._tables)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.id, t.name, i, f.name, f.kind) for t in self.list() for i, f in enumerate(t.fields)]
        return spark.createDataFrame(rows, "id string, name string, position int, field string, kind string")


def seeded() -> Registry:
    registry = Registry()
    registry.register(USER_PROFILE)
    registry.register(ITEM_PROFILE)
    return registry

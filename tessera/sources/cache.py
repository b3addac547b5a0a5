"""Snapshots of single entities, kept on the driver; an absent entity is kept as such."""

from __future__ import annotations

from collections import OrderedDict

#: Snapshots that are kept; beyond, the one that was read longest ago goes.
LIMIT = 100_000


class ReadCache:
    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self._held: OrderedDict[tuple[str, str], dict | None] = OrderedDict()

    def get(self, entity: str, version_id: str) -> tuple[bool, dict | None]:
        """Whether the pair is known, and its snapshot (a copy), None for an entity that is not there."""
        key = (entity, version_id)
        if key not in self._held:
            return False, None
        self._held.move_to_end(key)
        found = self._held[key]
        return True, None if found is None else dict(found)

    def put(self, entity: str, version_id: str, snapshot: dict | None) -> None:
        self._held[entity, version_id] = None if snapshot is None else dict(snapshot)
        self._held.move_to_end((entity, version_id))
        while len(self._held) > self.limit:
            self._held.popitem(last=False)

    def invalidate_version(self, version_id: str) -> None:
        for key in [k for k in self._held if k[1] == version_id]:
            del self._held[key]

    def invalidate_entity(self, entity: str) -> None:
        for key in [k for k in self._held if k[0] == entity]:
            del self._held[key]

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)

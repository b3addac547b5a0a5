"""Entity keys: validation and placement on shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY_BYTES = 256
# This literal hashes to 0 under the built-in's fixed seed, and each hash seeds the next column's.
_ZERO_SEED = -365884300664092260


def trimmed(key: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(key, r"(?U)^\s+|\s+$", "")


def parse_entity(key: Column) -> Column:
    """The trimmed key; null if it is empty or longer than MAX_KEY_BYTES bytes."""
    t = trimmed(key)
    return F.when(F.octet_length(t).between(1, MAX_KEY_BYTES), t)


def require_entity(key: Column) -> Column:
    """As parse_entity, but an unfit key is an error."""
    t = trimmed(key)
    said = F.when(F.octet_length(t) == 0, "empty entity key").otherwise("entity key too long")
    return F.when(F.octet_length(t).between(1, MAX_KEY_BYTES), t).otherwise(F.raise_error(said).cast("string"))


def hash_key(key: Column) -> Column:
    """XXH64 of the key's bytes with seed 0, as a signed long."""
    return F.xxhash64(F.lit(_ZERO_SEED).cast("bigint"), key)


def slot(key: Column, size: int) -> Column:
    """The unsigned hash modulo ``size``; 0 for sizes under 1."""
    if size <= 0:
        return F.lit(0).cast("int")
    h = hash_key(key)
    wrap = F.when(h < 0, (1 << 64) % size).otherwise(0)
    return F.pmod(F.pmod(h, F.lit(size)) + wrap, F.lit(size)).cast("int")


def route_entity(key: Column, size: int) -> Column:
    """Slot of the key as it is; null where the trimmed key is unfit."""
    return F.when(parse_entity(key).isNotNull(), slot(key, size))


@dataclass(frozen=True)
class Expansion:
    previous: int
    current: int
    added: int


class Router:
    """Shard count and its growth. Placement is a function of key and count, so entries are reachable at any time."""

    def __init__(self, shards: int):
        if shards <= 0:
            raise ValueError("shard count must be positive")
        self.shards = shards

    def route(self, key: Column) -> Column:
        return slot(key, self.shards)

    def expand(self, target: int) -> Expansion:
        if target <= self.shards:
            raise ValueError(f"cannot expand from {self.shards} to {target} shards")
        previous, self.shards = self.shards, target
        return Expansion(previous, target, target - previous)

    def shard_state(self, shard: int) -> int:
        """0 for a shard there is, -1 out of range."""
        return 0 if 0 <= shard < self.shards else -1


def reachable(key: Column, before: int, after: int) -> Column:
    """Whether an entry placed before an expansion is found after it if it is not moved."""
    return slot(key, before) == slot(key, after)

"""Deep-shallow sorting of strings.

Multikey quicksort, eight bytes at a time, sorts to a shallow depth; groups that
are small or still tied there are ordered by blind tries, which look at one byte
of a branch on the way down and compare a string once. The result is the sorted
order with the longest common prefixes of neighbours.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at, and the group size from which tries take over.
SHALLOW, SMALL = 96, 48


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first ``start`` bytes are known to be equal."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """Strings by branching bytes only. A branch is [depth, {byte: child}, a leaf below]; a leaf is a list of equal strings' numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = [number]
            return
        # Blindly down to some leaf: its string shares the longest prefix with s of all in the trie.
        node = self.root
        while len(node) == 3 and isinstance(node[1], dict):
            depth = node[0]
            child = node[1].get(s[depth] if depth < len(s) else -1)
            node = child if child is not None else [node[2]]
        other = self.strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            self._leaf(s).append(number)
            return
        # Down again to where the prefix ends.
        above, edge, node = None, -1, self.root
        while self._is_branch(node) and node[0] < shared:
            above, edge = node, self._byte(s, node[0])
            node = node[1][edge]
        if self._is_branch(node) and node[0] == shared:
            node[1][self._byte(s, shared)] = [number]
            return
        branch = [shared, {self._byte(s, shared): [number], self._byte(other, shared): node}, number]
        if above is None:
            self.root = branch
        else:
            above[1][edge] = branch

    @staticmethod
    def _is_branch(node: list) -> bool:
        return len(node) == 3 and isinstance(node[1], dict)

    def _leaf(self, s: bytes) -> list:
        node = self.root
        while self._is_branch(node):
            node = node[1][self._byte(s, node[0])]
        return node

    def ordered(self) -> list[tuple[int, int]]:
        """(number, common prefix with the one before) in order; the first has 0."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root is not None else []
        while stack:
            node, shared = stack.pop()
            if self._is_branch(node):
                depth, children, _ = node
                keys = sorted(children)
                for i in range(len(keys) - 1, -1, -1):
                    stack.append((children[keys[i]], depth if i else shared))
            else:
                size = len(self.strings[node[0]])
                out += [(n, size if i else shared) for i, n in enumerate(sorted(node))]
        return out


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of ``strings``, equal ones by number, and each one's common prefix with the one before it (0 for the first)."""
    n = len(strings)
    width = SHALLOW // 8
    padded = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    words = np.frombuffer(padded, ">u8").reshape(n, width) if n else np.zeros((0, width), ">u8")
    order: list[int] = []
    prefix: list[int] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(n), 0)] if n else []
    while stack:
        group, depth = stack.pop()
        if len(group) <= SMALL or depth == width:
            trie = BlindTrie(strings)
            for number in group.tolist():
                trie.insert(number)
            found = trie.ordered()
            first = found[0][0]
            prefix.append(common_prefix(strings[order[-1]], strings[first]) if order else 0)
            prefix += [p for _, p in found[1:]]
            order += [number for number, _ in found]
            continue
        keys = words[group, depth]
        # Median of three spread keys as the pivot; equal keys go on at the next eight bytes.
        pivot = np.sort(keys[[0, len(keys) // 2, len(keys) - 1]])[1]
        less, same = keys < pivot, keys == pivot
        parts = [(group[less], depth), (group[same], depth + 1), (group[~(less | same)], depth)]
        stack += [p for p in reversed(parts) if len(p[0])]
    return np.array(order, np.int64), np.array(prefix, np.int64)

"""Deep-shallow sorting of byte strings, with the common prefixes of neighbours.

Multikey quicksort orders strings by one byte at a time down to a shallow depth. Groups that still agree there have long
common prefixes; each is ordered by a blind trie, which keeps only branching depths and bytes: a string is led to a leaf
without comparing, compared with that leaf once, and put where the two differ.
"""

from __future__ import annotations

SHALLOW = 6


def common_prefix(a: bytes, b: bytes, begin: int = 0) -> int:
    """The length of the common prefix of two strings that agree before `begin`."""
    end = min(len(a), len(b))
    if a[begin:end] == b[begin:end]:
        return end
    low, high = begin, end  # agree before low, differ before high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


class BlindTrie:
    """Strings by number; inner nodes are [depth, {byte: node}], leaves are numbers."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, None

    def insert(self, k: int) -> None:
        s, strings = self.strings[k], self.strings
        if self.root is None:
            self.root = k
            return
        node = self.root
        while not isinstance(node, int):
            children = node[1]
            node = children.get(_byte(s, node[0]))
            if node is None:
                node = next(iter(children.values()))
        near = strings[node]
        at = common_prefix(s, near, self.depth)
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < at:
            parent, node = node, node[1][_byte(s, node[0])]
        if not isinstance(node, int) and node[0] == at:
            node[1][_byte(s, at)] = k
            return
        fresh = [at, {_byte(near, at): node, _byte(s, at): k}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][_byte(s, parent[0])] = fresh

    def walk(self) -> tuple[list[int], list[int]]:
        """Leaves in order, and the depth at which each parts from the one before."""
        order: list[int] = []
        parts: list[int] = []
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, int):
                order.append(node)
                parts.append(depth)
                continue
            children = [node[1][c] for c in sorted(node[1])]
            todo += [(child, node[0]) for child in children[:0:-1]]
            todo.append((children[0], depth))
        return order, parts


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of distinct strings that agree before `depth`, and for each but the first the length of the prefix that it
    shares with the one before it (0 for the first)."""
    order: list[int] = []
    parts: list[int] = []
    todo = [(list(range(len(strings))), depth, 0)]  # (group, depth to which it agrees, depth at which it parts from what came before)
    while todo:
        group, at, parted = todo.pop()
        if len(group) == 1:
            order.append(group[0])
            parts.append(parted)
        elif at - depth >= shallow:
            trie = BlindTrie(strings, at)
            for k in group:
                trie.insert(k)
            inner, inner_parts = trie.walk()
            order += inner
            parts += [parted, *inner_parts[1:]]
        else:
            pivot = _byte(strings[group[len(group) // 2]], at)
            less, same, more = [], [], []
            for k in group:
                c = _byte(strings[k], at)
                (same if c == pivot else less if c < pivot else more).append(k)
            pieces = [(g, at + (g is same)) for g in (less, same, more) if g]
            todo += [(g, d, at) for g, d in pieces[:0:-1]]
            todo.append((*pieces[0], parted))
    return order, parts

"""Adaptive radix tree over byte strings: node layouts of 4, 16, 48 and 256 children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class _Sorted:
    """Up to 4 or 16 children beside their sorted bytes."""

    __slots__ = ("bytes", "nodes", "size")

    def __init__(self, size: int):
        self.bytes, self.nodes, self.size = bytearray(), [], size

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node) -> bool:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        elif len(self.bytes) == self.size:
            return False
        else:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        return True

    def items(self) -> Iterator:
        return zip(self.bytes, self.nodes)


class _Indexed:
    """Up to 48 children behind a table of all bytes."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> bool:
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
        elif len(self.nodes) == 48:
            return False
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)
        return True

    def items(self) -> Iterator:
        return ((byte, self.nodes[at - 1]) for byte, at in enumerate(self.index) if at)


class _Direct:
    """A place for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self) -> Iterator:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


def _larger(layout):
    if isinstance(layout, _Sorted):
        grown = _Sorted(16) if layout.size == 4 else _Indexed()
    else:
        grown = _Direct()
    for byte, node in layout.items():
        grown.put(byte, node)
    return grown


class Node:
    """A compressed path and what branches off at its end."""

    __slots__ = ("path", "children", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.children, self.value = path, None, value

    def get(self, byte: int) -> Node | None:
        return self.children.get(byte) if self.children is not None else None

    def put(self, byte: int, node: Node) -> None:
        if self.children is None:
            self.children = _Sorted(4)
        if not self.children.put(byte, node):
            self.children = _larger(self.children)
            self.children.put(byte, node)

    def items(self) -> Iterator:
        return self.children.items() if self.children is not None else iter(())


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at their start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Values by key; keys may be prefixes of each other. The first byte of a branch is not part of the path below."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, above, byte, at = self.root, None, 0, 0
        while True:
            path = node.path
            rest = key[at : at + len(path)]
            if rest != path:
                # The path ends where the key leaves it, and goes on below.
                shared = _shared(path, rest)
                split = Node(path[:shared])
                split.put(path[shared], node)
                node.path = path[shared + 1 :]
                if above is None:
                    self.root = split
                else:
                    above.put(byte, split)
                node = split
                path = split.path
            at += len(path)
            if at == len(key):
                node.value = value
                return
            above, byte = node, key[at]
            below = node.get(byte)
            if below is None:
                node.put(byte, Node(key[at + 1 :], value))
                return
            node, at = below, at + 1

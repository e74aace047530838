"""An adaptive radix tree over byte strings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node:
    """Bytes shared by all keys below (path compression), an optional value, and children by next byte.

    Four layouts, each resized into the next when full: sorted bytes beside children (4 and 16 places), an index of all bytes into
    48 places, and a place for each byte (256).
    """

    __slots__ = ("prefix", "value", "room", "keys", "kids", "count")

    def __init__(self, prefix: bytes, value: int = -1):
        self.prefix, self.value = prefix, value
        self.room, self.count = 4, 0
        self.keys: bytearray = bytearray()
        self.kids: list[Node | None] = []

    def child(self, byte: int) -> Node | None:
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < self.count and self.keys[at] == byte else None

    def put(self, byte: int, kid: Node) -> None:
        """Sets the child of a byte, new or not."""
        if self.room <= 16:
            at = bisect_left(self.keys, byte)
            if at < self.count and self.keys[at] == byte:
                self.kids[at] = kid
                return
            if self.count < self.room:
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
                self.count += 1
                return
            self._grow()
            self.put(byte, kid)
        elif self.room == 48:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = kid
            elif self.count < 48:
                self.kids.append(kid)
                self.count += 1
                self.keys[byte] = self.count
            else:
                self._grow()
                self.put(byte, kid)
        else:
            self.count += self.kids[byte] is None
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.room, self.keys = 48, index
        else:
            kids: list[Node | None] = [None] * 256
            for byte in range(256):
                if self.keys[byte]:
                    kids[byte] = self.kids[self.keys[byte] - 1]
            self.room, self.keys, self.kids = 256, bytearray(), kids

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.room == 48:
            yield from (self.kids[at - 1] for at in self.keys if at)  # type: ignore[misc]
        else:
            yield from (k for k in self.kids if k is not None)


class Tree:
    """Keys with whole numbers as values."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value: int) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, above, at, branch = self.root, None, 0, 0
        while True:
            shared = _shared(node.prefix, key, at)
            at += shared
            if shared < len(node.prefix):  # the path parts inside this node's bytes
                upper = Node(node.prefix[:shared])
                upper.put(node.prefix[shared], node)
                node.prefix = node.prefix[shared + 1 :]
                if at == len(key):
                    upper.value = value
                else:
                    upper.put(key[at], Node(key[at + 1 :], value))
                if above is None:
                    self.root = upper
                else:
                    above.put(branch, upper)
                return
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, branch, node = node, key[at], below
            at += 1


def _shared(prefix: bytes, key: bytes, at: int) -> int:
    """How many bytes of prefix stand in key from `at` on."""
    n = min(len(prefix), len(key) - at)
    if prefix[:n] == key[at : at + n]:
        return n
    lo, hi = 0, n  # the first lo bytes are equal, the first hi are not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if prefix[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo

"""The write buffer: single puts and deletions, held on the driver until they are written as a run."""

from __future__ import annotations

from sediment.model import BufferFrozen, BufferFull


def entry_size(key, value) -> int:
    """Bytes that an entry counts for; a deletion counts for its key."""
    size = lambda x: len(x.encode()) if isinstance(x, str) else len(x) if isinstance(x, (bytes, bytearray)) else 8
    return size(key) + (0 if value is None else size(value))


class Buffer:
    """The latest value of each key (None: deleted), up to ``limit`` bytes (0: any)."""

    def __init__(self, limit: int = 0):
        self.limit, self.size, self.frozen = limit, 0, False
        self._entries: dict = {}

    def __len__(self) -> int:
        return len(self._entries)

    def __contains__(self, key) -> bool:
        return key in self._entries

    @property
    def full(self) -> bool:
        return bool(self.limit) and self.size >= self.limit

    def freeze(self) -> None:
        self.frozen = True

    def set(self, key, value, *, alone: bool = False) -> None:
        """Raise BufferFull for what would grow beyond the limit; ``alone`` lets the only entry of a buffer do so."""
        if self.frozen:
            raise BufferFrozen
        grown = entry_size(key, value) - (entry_size(key, self._entries[key]) if key in self._entries else 0)
        if self.limit and grown > 0 and self.size + grown > self.limit and not (alone and not self._entries):
            raise BufferFull
        self._entries[key] = value
        self.size += grown

    def get(self, key):
        return self._entries[key]

    def items(self) -> list[tuple]:
        """(key, value) in order of key."""
        return sorted(self._entries.items(), key=lambda e: e[0])

"""Tables that a Python worker keeps between tasks: bounded in bytes, and one operator's at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}
_holder: list[str] = []

#: What Python takes for an entry beside the letters of its key and the bytes of its value.
ENTRY_BYTES = 180


class Halves(dict):
    """What ``learnt`` says of words, kept in two halves of at most ``most`` bytes.

    The young half is the dict itself. Full, it becomes the old one; a word found in the old half
    moves to the young one, so frequent words stay. Words over ``longest`` letters are not kept.
    """

    def __init__(self, most: int, longest: int = 64):
        super().__init__()
        self.most, self.longest, self.taken = most, longest, 0
        self.old: dict = {}

    def learnt(self, word: str):
        raise NotImplementedError

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.learnt(word)
        if len(word) <= self.longest:
            self.taken += len(word) + (len(value) if isinstance(value, bytes) else 0) + ENTRY_BYTES
            if self.taken > self.most:
                self.old, self.taken = dict(self), 0
                self.clear()
            self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.taken = {}, 0


def register(name: str, clear: Callable[[], None]) -> None:
    _clear[name] = clear


def claim(name: str) -> None:
    """To be called as a task begins: empties the tables of every other operator and gives their memory back."""
    if _holder == [name]:
        return
    for other, clear in _clear.items():
        if other != name:
            clear()
    _holder[:] = [name]
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

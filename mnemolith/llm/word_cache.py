"""Per-worker memory of what a tokenizer makes of a word."""

from __future__ import annotations

import sys
from collections.abc import Callable

#: Bytes that one cache may take, and what an entry takes besides the word and the value.
ROOM, ENTRY = 32 << 20, 100


class WordCache(dict):
    """word -> value, made on first sight; emptied when its words and values take ``room`` bytes, so that memory stays bounded."""

    def __init__(self, make: Callable[[str], object], room: int = ROOM):
        super().__init__()
        self.make, self.room, self.used = make, room, 0

    def __missing__(self, word: str) -> object:
        value = self.make(word)
        self.used += ENTRY + sys.getsizeof(word) + sys.getsizeof(value)
        if self.used > self.room:
            self.clear()
            self.used = 0
        self[word] = value
        return value

"""Result caches on the driver, for repeated small queries."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from functools import wraps
from typing import Any


class ResultCache:
    """The results used most lately, at most ``capacity`` of them; 0 keeps none. Safe to share between threads."""

    def __init__(self, capacity: int = 1000):
        if capacity < 0:
            raise ValueError("capacity can't be negative")
        self.capacity = capacity
        self._held: OrderedDict = OrderedDict()
        self._lock = threading.Lock()
        self.hits = self.misses = 0

    def get(self, key: Any) -> Any:
        with self._lock:
            if key not in self._held:
                self.misses += 1
                return None
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]

    def put(self, key: Any, value: Any) -> None:
        with self._lock:
            self._held[key] = value
            self._held.move_to_end(key)
            while len(self._held) > self.capacity:
                self._held.popitem(last=False)

    def clear(self) -> None:
        with self._lock:
            self._held.clear()
            self.hits = self.misses = 0

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self._held), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def memoized(f: Callable) -> Callable:
    """``f`` that computes each result once, for arguments that can be hashed; ``info()`` counts, ``known`` holds the results."""
    known: dict = {}
    count = {"hits": 0}

    @wraps(f)
    def once(*args, **named):
        key = args, frozenset(named.items())
        if key in known:
            count["hits"] += 1
        else:
            known[key] = f(*args, **named)
        return known[key]

    once.known = known
    once.info = lambda: {"size": len(known), "hits": count["hits"]}
    return once

"""What a Python worker keeps between tasks: one large object at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

_slot: dict[Hashable, Any] = {}


def kept(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object under ``key``, built once; another key's object goes first.

    Workers outlive a stage, so vocabularies, tables and memos of earlier stages would add up.
    """
    if key not in _slot:
        _slot.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
        _slot[key] = build()
    return _slot[key]

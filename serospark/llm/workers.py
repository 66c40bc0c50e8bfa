"""Things that a Python worker makes once and keeps for all tasks it runs."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import Any

_NAME = "_serospark_worker"


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, once per worker process and ``key``.

    Task code travels by value, so globals of a module begin anew with every task; what is kept here hangs on a
    module of the process instead. It may be lost with the worker at any time and is then made again.
    """
    store = sys.modules.get(_NAME)
    if store is None:
        store = sys.modules.setdefault(_NAME, ModuleType(_NAME))
    kept = store.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]

"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType


def kept(key: object, make: Callable[[], object]) -> object:
    """The worker's value for ``key``, made at its first use. Only for values that bear on speed, never on results."""
    store = vars(sys.modules.setdefault("casemill_worker_values", ModuleType("casemill_worker_values")))
    if key not in store:
        store[key] = make()
    return store[key]

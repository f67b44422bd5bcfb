"""K3, K4: caller-supplied models inside Spark tasks.

A model is made by a function that the caller gives, at its first use in a
Python worker, and kept there for the worker's later tasks and batches.  The
driver never holds it and nothing but the function travels.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable


def worker_model(make: Callable):
    """``get()`` that returns ``make()``'s result, made once a Python worker."""
    name = uuid.uuid4().hex

    def get():
        # functions travel by value with globals of their own, so the worker's interpreter holds the models
        models = sys.__dict__.setdefault("_quarry_models", {})
        if name not in models:
            models[name] = make()
        return models[name]
    return get


def in_batches(rows: list, size: int):
    for at in range(0, len(rows), size):
        yield rows[at:at + size]

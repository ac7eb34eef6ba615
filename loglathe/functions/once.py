"""Columns that are built once an application.

A column of a few hundred expressions takes a second or more to build from
Python, call by call; it is the same each time, so it is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession


def once(build: Callable) -> Callable:
    """Keep what ``build`` returns for its arguments (hashable ones), as long as the application is the same."""
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = SparkSession.active().sparkContext.applicationId, args
        if key not in kept:
            for old in [k for k in kept if k[0] != key[0]]:
                del kept[old]
            kept[key] = build(*args)
        return kept[key]

    return get

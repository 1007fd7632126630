"""Names for an operator's own columns that no given column has."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name with as many underscores after it as set it apart from the taken names, in any case."""
    lowered = {name.lower() for name in taken}
    out = []
    for name in wanted:
        while name.lower() in lowered:
            name += "_"
        lowered.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns that are called like an operator's `own` renamed, and what gives them their names back."""
    names = {name.lower() for name in own}
    clashing = [c for c in df.columns if c.lower() in names]
    fresh = unused([*df.columns, *own], *clashing)
    renamed = df.withColumnsRenamed(dict(zip(clashing, fresh)))
    return renamed, lambda out: out.withColumnsRenamed(dict(zip(fresh, clashing)))

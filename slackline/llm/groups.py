"""Whole groups from batches of rows that are sorted by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows at the end."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    if n:
        new[0] = True
    return np.append(np.flatnonzero(new), n)


def whole_groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Frames that end where a group ends; at most one group is held over."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = bool(held) and all(held[0][k].iloc[0] == batch[k].iloc[0] for k in keys)
        if held and not same:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        last = int(starts(*(batch[k].to_numpy() for k in keys))[-2])
        if last:
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = [batch.iloc[last:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)

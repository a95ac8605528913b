"""What the operators of this subpackage share: hashes, names of their own columns, and the shared folder and lineage cuts of the session."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from trialytics.session import cut, free, shared_folder, shared_root, written

__all__ = ["cut", "free", "mix64", "own_names", "shared_folder", "shared_root", "written"]


def own_names(docs: DataFrame, own: Iterable[str]) -> dict[str, str]:
    """The names that an operator's own columns have beside those of docs: where docs has a column of such a name, the operator's gets one more underscore in front, and the input's column stays."""
    taken = {c.lower() for c in docs.columns}
    out = {}
    for name in own:
        free_name = name
        while free_name.lower() in taken:
            free_name = f"_{free_name}"
        taken.add(free_name.lower())
        out[name] = free_name
    return out

#: 64-bit odd multipliers of a finaliser (fixed values).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))

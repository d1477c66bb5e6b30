"""Code points of a block of texts as one numpy array, with tables of their classes."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np


@functools.cache
def classes() -> dict[str, np.ndarray]:
    """Boolean tables over all code points: letter, upper, digit."""
    found = np.array([unicodedata.category(chr(k)) for k in range(sys.maxunicode + 1)])
    return {"letter": np.char.startswith(found, "L"), "upper": found == "Lu", "digit": np.char.startswith(found, "N")}


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text with a line break behind it, and where each text starts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths

"""Whole texts as code-point arrays, and tables over code points."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Tables cover the planes that hold letters; code points beyond count as no letter.
TABLE = 0x32400


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts on end, and each text's length."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.fromiter(map(len, texts), np.int64, len(texts))


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(TABLE)), bool, TABLE)


@cache
def alphanumerics() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(TABLE)), bool, TABLE)


@cache
def lowered() -> np.ndarray:
    """Each code point's lower case where that is one code point, else itself."""
    low = (chr(c).lower() for c in range(TABLE))
    return np.fromiter((ord(x) if len(x) == 1 else c for c, x in enumerate(low)), np.uint32, TABLE)


def looked_up(table: np.ndarray, codes: np.ndarray, beyond=0) -> np.ndarray:
    out = table[np.minimum(codes, len(table) - 1)]
    if len(codes) and codes.max() >= len(table):
        out = out.copy()
        out[codes >= len(table)] = beyond
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slabs(texts, most: int = 2_000_000, rows: int = 10_000):
    """Lists of up to `rows` consecutive texts of about `most` code points in all (one text may have more), with their first index."""
    start, total, part = 0, 0, []
    for n, x in enumerate(texts):
        if part and (total + len(x) > most or len(part) == rows):
            yield start, part
            start, total, part = n, 0, []
        part.append(x)
        total += len(x)
    if part:
        yield start, part

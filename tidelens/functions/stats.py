"""Hash draws that do not depend on partitioning, and the Student t tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def draw_block(*parts: Column | str | int) -> Column:
    """128 pseudo-random bits for a key tuple (seed, group, replicate, block)."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def u32(block: Column, part: int) -> Column:
    """One of the four 32-bit draws of a block."""
    return F.conv(F.substring(block, 1 + 8 * part, 8), 16, 10).cast("bigint")


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_UP = [[np.uint32(s) for s in four] for four in _MD5_SHIFTS]
_DOWN = [[np.uint32(32 - s) for s in four] for four in _MD5_SHIFTS]


def md5_words(pieces: list[bytes | np.ndarray]) -> list:
    """Words of padded texts, all of one length: a piece is the same bytes for every text, or a row of bytes for each.

    A word that is the same for all texts stays a number.
    """
    columns = [c for piece in pieces for c in (piece if isinstance(piece, bytes) else piece.T)]
    size = len(columns)
    columns += b"\x80" + bytes((55 - size) % 64) + (8 * size).to_bytes(8, "little")
    words = []
    for at in range(0, len(columns), 4):
        word = 0
        for shift, c in zip((0, 8, 16, 24), columns[at:at + 4]):
            word = word + (c << shift if isinstance(c, int) else c.astype(np.uint32) << np.uint32(shift))
        words.append(word if isinstance(word, int) else word.astype(np.uint32, copy=False))
    return words


def md5_draws(words: list, rows: int) -> np.ndarray:
    """The four 32-bit draws (4, rows) of texts packed by :func:`md5_words`; the same as ``draw_block`` and ``u32`` give."""
    state = [np.full(rows, v, np.uint32) for v in _MD5_START]
    f, high = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
                g = 7 * i % 16
            word = words[block + g]
            f += a
            if isinstance(word, int):
                f += np.uint32((word + _MD5_SINES[i]) & 0xFFFFFFFF)
            else:
                f += word
                f += np.uint32(_MD5_SINES[i])
            np.left_shift(f, _UP[i // 16][i % 4], out=high)
            f >>= _DOWN[i // 16][i % 4]
            f |= high
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return np.stack(state).byteswap()


def decimal_bytes(n: np.ndarray, width: int) -> np.ndarray:
    """Decimal digits of numbers that all have ``width`` of them, a row each."""
    return np.stack([n // 10**k % 10 + 48 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8)


def by_width(lo: int, hi: int):
    """The numbers from lo to hi - 1 as ranges (lo, hi, width) of equal width in decimal."""
    while lo < hi:
        width = len(str(lo))
        end = min(hi, 10**width)
        yield lo, end, width
        lo = end


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    out = np.where(xx <= 0, 0.0, front * _beta_fraction(aa, bb, xx))
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """SCA-17: two-sided p value; one row per test."""
    ok = t.notna() & df.notna()
    out = pd.Series(np.nan, index=t.index, dtype=float)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(ok, None)

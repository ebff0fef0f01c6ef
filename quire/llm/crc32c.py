"""CRC-32C of many records at once, in numpy: the checksum of length-delimited record files."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLY = 0x82F63B78  # Castagnoli, reflected
MASK_DELTA = 0xA282EAD8  # fixed value of the record format
BLOCK = 128


@lru_cache(maxsize=None)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    return t


@lru_cache(maxsize=None)
def _shift_tables(power: int) -> np.ndarray:
    """Four tables that advance a remainder over 2**power zero bytes."""
    if power == 0:
        t, x = _byte_table(), np.arange(256, dtype=np.uint32)
        return np.stack([t[x << (8 * k) & 0xFF] ^ (x << np.uint32(8 * k)) >> np.uint32(8) for k in range(4)])
    half = _shift_tables(power - 1)
    return np.stack([_apply(half, half[k]) for k in range(4)])


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFF] ^ tables[1][c >> 8 & 0xFF] ^ tables[2][c >> 16 & 0xFF] ^ tables[3][c >> 24]


def crc32c(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32C of each ``data[begin : begin + length]`` (bytes)."""
    table, n = _byte_table(), len(begin)
    blocks = -(-length // BLOCK)
    pad = blocks * BLOCK - length  # zeros in front leave a remainder that starts at zero as it is
    last = np.cumsum(blocks)
    total = int(last[-1]) if n else 0
    lanes = np.zeros((total, BLOCK), np.uint8)
    first = last - blocks
    flat = lanes.reshape(-1)
    for to, at, size in zip((first * BLOCK + pad).tolist(), begin.tolist(), length.tolist(), strict=True):
        flat[to : to + size] = data[at : at + size]
    part = np.zeros(total, np.uint32)
    columns = np.ascontiguousarray(lanes.T)
    for k in range(BLOCK):
        part = table[(part ^ columns[k]) & 0xFF] ^ (part >> np.uint32(8))
    shift, out = _shift_tables(BLOCK.bit_length() - 1), np.zeros(n, np.uint32)
    order = np.argsort(-blocks, kind="stable")
    live, turn = n, 0
    falling = blocks[order]
    while True:
        live = int(np.searchsorted(-falling[:live], -turn, side="left"))
        if not live:
            break
        at = order[:live]
        out[at] = _apply(shift, out[at]) ^ part[first[at] + turn]
        turn += 1
    ahead = np.full(n, 0xFFFFFFFF, np.uint32)
    for power in range(int(length.max()).bit_length() if n else 0):
        at = np.flatnonzero(length >> power & 1)
        ahead[at] = _apply(_shift_tables(power), ahead[at])
    return out ^ ahead ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)

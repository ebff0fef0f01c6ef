"""Arrays of non-negative integers packed into bytes: what batches hand on through a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack(arrays: list[np.ndarray]) -> bytes:
    """Each array in the bytes that its largest value needs, by planes, compressed together."""
    out = []
    for a in arrays:
        width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
        planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(len(a), 8)[:, :width].T
        out += [len(a).to_bytes(8, "little"), bytes([width]), planes.tobytes()]
    data = zstandard.ZstdCompressor(level=1).compress(b"".join(out))
    return len(data).to_bytes(8, "little") + data


def unpack(data: bytes) -> Iterator[list[np.ndarray]]:
    """The array lists of packs that follow one another."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        raw, k, arrays = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]), 0, []
        at += 8 + size
        while k < len(raw):
            n, width = int.from_bytes(raw[k : k + 8], "little"), raw[k + 8]
            planes = np.frombuffer(raw, np.uint8, n * width, k + 9).reshape(width, n)
            a = np.zeros(n, np.int64)
            for b in range(width):
                a |= planes[b].astype(np.int64) << (8 * b)
            arrays.append(a)
            k += 9 + n * width
        yield arrays

"""Patched frame-of-reference coding of unsigned integers, in blocks of ``BLOCK`` values.

A block subtracts its minimum and packs the rest at the width that holds ``PERCENTILE`` of its values;
the high bits of the others go to an exception list. Layout of a block, little-endian: minimum u32,
width u8, spare u8, exceptions u16, values u32, packed bits (lowest first), exceptions' places (u16
each), then their high parts (u32 each).
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK, PERCENTILE = 1024, 95
HEAD = struct.Struct("<IBBHI")


def encode_blocks(values: np.ndarray) -> list[bytes]:
    """The blocks of ``values`` in order; only the last may be short."""
    values = values.astype(np.uint32, copy=False)
    n = len(values)
    if not n:
        return []
    count = -(-n // BLOCK)
    grid = np.empty((count, BLOCK), np.uint32)
    grid.reshape(-1)[:n] = values
    grid.reshape(-1)[n:] = values[-1]
    low = grid.min(axis=1)
    grid -= low[:, None]
    rank = BLOCK * PERCENTILE // 100
    common = np.partition(grid, rank, axis=1)[:, rank]
    widths = np.frexp(common.astype(np.float64))[1].astype(np.int64)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        rows = grid[at]
        if width:
            bits = ((rows[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        high = rows >> np.uint32(width) if width < 32 else np.zeros_like(rows)
        for k, block in enumerate(at):
            size = min(BLOCK, n - block * BLOCK)
            places = np.flatnonzero(high[k, :size])
            body = packed[k, : (size * width + 7) // 8].tobytes() if width else b""
            out[block] = (
                HEAD.pack(low[block], width, 0, len(places), size)
                + body
                + places.astype("<u2").tobytes()
                + high[k, places].astype("<u4").tobytes()
            )
    return out


def decode_block(raw: bytes | memoryview) -> np.ndarray:
    low, width, _, exceptions, size = HEAD.unpack_from(raw)
    end = HEAD.size + (size * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, end - HEAD.size, HEAD.size), count=size * width, bitorder="little")
        pad = np.zeros((size, 32), np.uint8)
        pad[:, :width] = bits.reshape(size, width)
        values = np.packbits(pad, axis=1, bitorder="little").view("<u4").reshape(size).astype(np.uint32)
    else:
        values = np.zeros(size, np.uint32)
    if exceptions:
        places = np.frombuffer(raw, "<u2", exceptions, end)
        values[places] |= np.frombuffer(raw, "<u4", exceptions, end + 2 * exceptions) << np.uint32(width)
    return values + np.uint32(low)

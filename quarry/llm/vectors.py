"""Vectors as whole numbers: each component c, as a double, becomes floor(256 * c).

A vector is packed to bytes: one byte with the width (2, 4 or 8) that its largest component needs,
then its components, little-endian. So equal vectors have equal bytes, and most take a quarter of
what doubles take. Components beyond a long are cut to the nearest double within it. A vector that is
null, or holds a component that is null or not finite, is left out; so an empty one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCALE = 256.0
#: The greatest double below 2**63.
MOST = 9223372036854774784.0
WIDTHS = (2, 4, 8)


def pack(vectors: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which vectors (lists of double) take part, and these as bytes."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is not a number here
    row = np.repeat(np.arange(len(sizes)), sizes)
    fit = ~vectors.is_null().to_numpy(zero_copy_only=False)
    fit[row[~np.isfinite(flat)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(SCALE * flat), -MOST, MOST)
    most = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        most[some] = np.maximum.reduceat(np.where(np.isfinite(whole), np.abs(whole), 0), (np.cumsum(sizes) - sizes)[some])
    out: list[bytes | None] = [None] * len(sizes)
    ends = np.cumsum(sizes)
    width = np.where(most < 1 << 15, 2, np.where(most < float(1 << 31), 4, 8))
    for w in WIDTHS:
        rows = np.flatnonzero(fit & (width == w))
        mine = np.zeros(len(sizes), bool)
        mine[rows] = True
        raw = whole[mine[row]].astype(np.int64).astype(f"<i{w}").tobytes()
        at = 0
        for k in rows.tolist():
            n = w * int(ends[k] - (ends[k - 1] if k else 0))
            out[k] = bytes([w]) + raw[at : at + n]
            at += n
    return fit, pa.array([b for b, f in zip(out, fit, strict=True) if f], pa.binary())


def unpack(packed: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the number of components: the places of such vectors in the list, and a matrix of them."""
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, raw in enumerate(packed):
        kinds.setdefault((raw[0], (len(raw) - 1) // raw[0]), []).append(k)
    out: dict[int, list] = {}
    for (w, length), rows in kinds.items():
        data = np.frombuffer(b"".join(packed[k] for k in rows), np.uint8).reshape(len(rows), -1)[:, 1:]
        out.setdefault(length, []).append((rows, np.ascontiguousarray(data).view(f"<i{w}").reshape(len(rows), length).astype(np.int64)))
    return {length: (np.concatenate([np.array(r) for r, _ in parts]), np.concatenate([x for _, x in parts])) for length, parts in out.items()}


def length(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]

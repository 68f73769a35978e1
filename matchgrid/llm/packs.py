"""Arrays as one compressed value, for messages between blocks of documents and buckets of keys."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the smallest type that holds them."""
    x = np.asarray(x)
    if x.dtype.kind not in "ui":
        return x
    top = int(x.max()) if len(x) else 0
    return x.astype(np.min_scalar_type(top))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (or bytes) as a compressed value. Integers must not be negative."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        a = np.frombuffer(a, np.uint8) if isinstance(a, bytes) else narrow(a)
        if a.dtype.itemsize > 1 and a.dtype.kind in "uf":  # bytes of equal weight side by side compress better
            raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        else:
            raw = np.ascontiguousarray(a).tobytes()
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(raw)
    return zstandard.ZstdCompressor(level=5).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    kinds = [struct.unpack_from("<2sQ", raw, 4 + 10 * k) for k in range(n)]
    at, out = 4 + 10 * n, []
    for kind, count in kinds:
        t = np.dtype(kind.decode())
        size = t.itemsize * count
        if t.itemsize > 1 and t.kind in "uf":
            a = np.frombuffer(raw, np.uint8, size, at).reshape(t.itemsize, count).T.copy().view(t).reshape(count)
        else:
            a = np.frombuffer(raw, t, count, at)
        out.append(a)
        at += size
    return out

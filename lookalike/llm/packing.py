"""Compressed arrays inside binary columns."""

from __future__ import annotations

LEVEL = 3


def pack(values, kind) -> bytes:
    """Compressed, all low bytes first, then the next ones."""
    import numpy as np
    import zstandard

    flat = np.ascontiguousarray(values, kind)
    planes = flat.view(np.uint8).reshape(-1, flat.itemsize).T
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def unpack(data: bytes, kind):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)

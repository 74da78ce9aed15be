"""PNG bytes of small pixel grids, with the standard library alone."""

from __future__ import annotations

import struct
import zlib

# Signature and colour types of the format, by number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPES = {1: 0, 3: 2, 4: 6}


def encode(pixels: bytes, width: int, height: int, channels: int) -> bytes:
    """An eight-bit image of rows of interleaved channels."""
    if len(pixels) != width * height * channels:
        raise ValueError("the pixels do not fill the image")

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[channels], 0, 0, 0)
    line = width * channels
    rows = b"".join(b"\0" + pixels[i : i + line] for i in range(0, len(pixels), line))
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

"""Image formats and sizes from bytes, without an imaging library."""

from __future__ import annotations

import struct

#: Signatures, MIME types and extensions.
SIGNATURES = [(b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff")]
MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff"}
EXTENSION = {"png": "png", "jpeg": "jpg", "gif": "gif", "bmp": "bmp", "tiff": "tiff"}
BY_EXTENSION = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}


def sniff(data: bytes) -> str | None:
    return next((name for mark, name in SIGNATURES if data.startswith(mark)), None)


def format_of(path: str, data: bytes) -> str | None:
    """By the path's extension, else by the first bytes."""
    return BY_EXTENSION.get(path.rpartition(".")[2].lower()) or sniff(data)


def size(data: bytes) -> tuple[int, int] | None:
    """Width and height in pixels."""
    try:
        kind = sniff(data)
        if kind == "png":
            return struct.unpack(">II", data[16:24])
        if kind == "gif":
            return struct.unpack("<HH", data[6:10])
        if kind == "bmp":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if kind == "jpeg":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                if data[at + 1] in {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}:
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None

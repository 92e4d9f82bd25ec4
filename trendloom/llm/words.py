"""Words of a text as bytes: digits, letters and everything beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
_TABLE[48:58] = bytes(range(48, 58))
_TABLE[97:123] = bytes(range(97, 123))
_TABLE[65:91] = bytes(range(97, 123))
_TABLE = bytes(_TABLE)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()

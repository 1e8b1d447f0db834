"""Words of UTF-8 bytes: runs of digits, letters and bytes outside ASCII, with A-Z lower-cased."""

from __future__ import annotations

_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(raw: bytes | None) -> list[bytes]:
    """All words in text order; null has none. Only A-Z change case, other letters stay as they are."""
    return raw.translate(_FOLD).split() if raw else []

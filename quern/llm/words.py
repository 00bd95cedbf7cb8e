"""Words of a text: runs of digits, letters and everything beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

#: Bytes of a word stay (A-Z become a-z); all others become blanks. Bytes beyond ASCII are parts of longer characters.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a whole text in UTF-8, in order; null and empty texts have none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()

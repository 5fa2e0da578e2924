"""Words of the decontamination and near-duplicate operators."""

from __future__ import annotations

#: Bytes of UTF-8 with A-Z lowered; ASCII that is neither digit nor letter becomes a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def norm_words(text: str | None) -> list[bytes]:
    """The ASCII-lowered words of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()

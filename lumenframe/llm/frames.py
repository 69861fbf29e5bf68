"""Texts as independent zstandard frames with running counts, so that any part is read without the rest.

A text is cut after about ``FRAME`` bytes, always at the end of a unit (white space and the word after it; white space at the
end of a text is a unit of its own). Every frame is compressed alone; beside the frames stand the units, code points and bytes up to
the end of each. A cut between two units opens one frame, a digest reads ranges of bytes frame by frame.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import zstandard

from lumenframe.llm import arrays as A

FRAME = 1 << 16

_SHRINK = zstandard.ZstdCompressor(level=1)
_GROW = zstandard.ZstdDecompressor()


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where each unit of one text (or of a part that begins and ends between units) stops."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = A.SPACE[data]
    last = np.empty(len(data), bool)
    np.greater(space[1:], space[:-1], out=last[:-1])  # a byte of a word before white space
    last[-1] = True
    return np.flatnonzero(last) + 1


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes but those that go on with a character."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _next_end(data: np.ndarray, at: int) -> int:
    """The first place between two units at ``at`` or after it."""
    while at < len(data):
        part = A.SPACE[data[at - 1 : at + 4096]]
        hit = np.flatnonzero(part[1:] & ~part[:-1])
        if len(hit):
            return at + int(hit[0])
        at += 4096
    return len(data)


class Frames:
    """Frames in order, with the running counts ``units``, ``chars`` and ``sizes`` at the end of each."""

    def __init__(self, units: list[int], chars: list[int], sizes: list[int], blobs: list[bytes]):
        self.units, self.chars, self.sizes, self.blobs = units, chars, sizes, blobs
        self._open: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of_text(cls, data: np.ndarray, frame: int = FRAME) -> Frames:
        """Frames of one text, cut between units."""
        units, chars, sizes, blobs = [], [], [], []
        a, u, c = 0, 0, 0
        while a < len(data):
            b = _next_end(data, a + frame)
            part = data[a:b]
            u += len(unit_ends(part))
            c += _points(part)
            units.append(u)
            chars.append(c)
            sizes.append(b)
            blobs.append(_SHRINK.compress(part.tobytes()))
            a = b
        return cls(units, chars, sizes, blobs)

    @classmethod
    def of_chunks(cls, chunks: Iterable[bytes], frame: int = FRAME) -> Frames:
        """Frames of bytes that come in pieces; no more than a frame and a piece is held. Only bytes are counted."""
        sizes, blobs, held, n, total = [], [], [], 0, 0

        def close():
            nonlocal held, n, total
            total += n
            sizes.append(total)
            blobs.append(_SHRINK.compress(b"".join(held)))
            held, n = [], 0

        for chunk in chunks:
            held.append(chunk)
            n += len(chunk)
            if n >= frame:
                close()
        if n:
            close()
        return cls([], [], sizes, blobs)

    @property
    def n_units(self) -> int:
        return self.units[-1] if self.units else 0

    @property
    def size(self) -> int:
        return self.sizes[-1] if self.sizes else 0

    def part(self, k: int) -> bytes:
        """The bytes of frame k; the frame opened last stays open."""
        if self._open[0] != k:
            self._open = (k, _GROW.decompress(self.blobs[k]))
        return self._open[1]

    def read(self, a: int, b: int) -> Iterator[bytes]:
        """Bytes a to b in pieces, from the frames that hold them."""
        if a >= b:
            return
        k = int(np.searchsorted(self.sizes, a, side="right"))
        at = self.sizes[k - 1] if k else 0
        while at < b:
            piece = self.part(k)
            yield piece[max(a - at, 0) : b - at]
            at, k = at + len(piece), k + 1

    def cut(self, unit: int) -> tuple[int, int]:
        """``(bytes, code points)`` before a cut after so many units; opens one frame."""
        if unit <= 0:
            return 0, 0
        k = int(np.searchsorted(self.units, unit))
        units, size, chars = (self.units[k - 1], self.sizes[k - 1], self.chars[k - 1]) if k else (0, 0, 0)
        data = np.frombuffer(self.part(k), np.uint8)
        end = int(unit_ends(data)[unit - units - 1])
        return size + end, chars + _points(data[:end])

    def find(self, mark: bytes, after: int = 0) -> int:
        """The first place of ``mark`` at ``after`` or later, -1 if none; frames are scanned in order."""
        tail, at = b"", after
        for piece in self.read(after, self.size):
            seen = tail + piece
            hit = seen.find(mark)
            if hit >= 0:
                return at - len(tail) + hit
            at += len(piece)
            tail = seen[len(seen) - min(len(seen), len(mark) - 1) :]
        return -1

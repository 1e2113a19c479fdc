"""Bytes of one artifact: at hand in a row, or in a file that is read by ranges."""

from __future__ import annotations

import io
import os
from typing import BinaryIO

#: Bytes of documents (source, JSON, templates) that are read whole.
WHOLE = 256 << 20


class Blob:
    """``content`` holds the artifact's first bytes; where it has fewer than ``size`` and there is a ``uri``, the file is opened for more."""

    def __init__(self, content: bytes | None, uri: bytes | None = None, size: int | None = None):
        self.content = content or b""
        self.at_hand = uri is None or (size is not None and len(self.content) >= size)
        self.uri, self._file = uri, None
        self.size = len(self.content) if self.at_hand else os.stat(uri).st_size

    def open(self) -> BinaryIO:
        """A seekable file at its start."""
        if self._file is None:
            self._file = io.BytesIO(self.content) if self.at_hand else open(self.uri, "rb")
        self._file.seek(0)
        return self._file

    def read(self, start: int, n: int) -> bytes:
        end = min(start + n, self.size)
        if end <= len(self.content):
            return self.content[start:end]
        file = self.open()
        file.seek(start)
        return file.read(max(end - start, 0))

    def whole(self, most: int = WHOLE) -> bytes:
        if self.size > most:
            raise ValueError(f"{self.size} bytes aren't read whole")
        return self.read(0, self.size)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()

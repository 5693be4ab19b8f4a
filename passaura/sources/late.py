"""Bytes of images fetched by the task that looks at them.

An image is known by a file and, where the file holds several, a part: a name in a workbook's zip, or page/ord of a PDF
page. So tables of images are narrow, and no picture goes through a shuffle.
"""

from __future__ import annotations

import zipfile
from dataclasses import dataclass, field

from . import opened, pdf


@dataclass
class Fetch:
    """fetch(file, part) gives an image's bytes. The file last opened stays open, as a task's images come from few files."""

    backend: object = pdf.default_backend
    last: tuple = field(default=(None, None, None), init=False, repr=False)

    def __getstate__(self):
        return {"backend": self.backend, "last": (None, None, None)}

    def _held(self, file: str, made):
        if self.last[0] != file:
            if self.last[1] is not None:
                self.last[1].close()
            stream = opened.opened(file)
            self.last = (file, stream, made(stream))
        return self.last[2]

    def __call__(self, file: str, part: str | None = None) -> bytes:
        if part is None:
            return opened.content(file)
        if file.lower().endswith(".pdf"):
            page, ord = map(int, part.split("/"))
            return self._held(file, lambda f: pdf.document(self.backend, f)).images(page - 1)[ord - 1]["content"]
        return self._held(file, zipfile.ZipFile).read(part)

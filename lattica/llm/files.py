"""Files in the shared folder, by URI, from driver and executors alike."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


class Committed:
    """A file written under a temporary name, which gets its own name when it is complete; a repeated task writes the same bytes again."""

    def __init__(self, folder: str, name: str):
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)

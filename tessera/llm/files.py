"""Files that tasks write and read themselves in the shared folder."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Hadoop writes it, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfs": "abfss"}.get(scheme, scheme) + mark + rest)


class Committed:
    """A file that is written under a temporary name and moved to its own name when it is whole.

    A task that runs twice, for a lost executor or by speculation, writes the same
    bytes under another temporary name and moves them to the same place.
    """

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path = store, path
        self.temporary = f"{os.path.dirname(path)}/_temporary-{uuid.uuid4().hex}"
        self.sink = store.open_output_stream(self.temporary)

    def __enter__(self) -> Committed:
        return self

    def __exit__(self, kind, *_) -> None:
        """Commit, or leave nothing behind if the task failed."""
        if kind is None:
            self.commit()
        else:
            self.abort()

    def commit(self) -> None:
        self.sink.close()
        self.store.move(self.temporary, self.path)

    def abort(self) -> None:
        if not self.sink.closed:
            self.sink.close()
        self.store.delete_file(self.temporary)

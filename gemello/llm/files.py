"""Binary files in the shared folder, written and read by executor tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri)


def attempt_path(folder: str, part: int, suffix: str) -> str:
    """A name that no other attempt of the same task uses: only the attempt whose manifest row is committed is ever read."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}{suffix}"

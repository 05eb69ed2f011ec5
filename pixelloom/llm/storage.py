"""Files that workers write to and read from a folder all executors share."""

from __future__ import annotations

import uuid


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(folder: str, name: str, data) -> str:
    """Writes a new file under a name that no other attempt of a task uses; gives its URI.

    A file counts only once its row, sent on by the attempt that succeeded, names it: what lost attempts leave behind is never read."""
    stem, dot, kind = name.partition(".")
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{dot}{kind}"
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)
    return uri


def read_bytes(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_stream(path) as src:
        return src.read()

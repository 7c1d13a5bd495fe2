"""Files of other formats in the shared folder, written and range-read on executors."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


@contextlib.contextmanager
def written(uri: str):
    """A stream whose content takes its name when it is whole, so that a lost or repeated task leaves no torn file."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(draft) as out:
        yield out
    if system.get_file_info(path).type == fs.FileType.File:  # an earlier attempt of the task wrote the same
        system.delete_file(path)
    system.move(draft, path)

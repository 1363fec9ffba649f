"""Files of any store that pyarrow opens, by URI; bare paths are local."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write under another name, then rename: readers see all or nothing."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_whole(uri: str) -> bytes | None:
    """The bytes of a file, or None if there is none."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as src:
        return src.read()


def names(uri: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, path = open_fs(uri)
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)))

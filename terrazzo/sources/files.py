"""Small files of a dataset on any file system that Arrow reads: local paths and URIs alike."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(str(path)) if "://" in str(path) else (fs.LocalFileSystem(), str(path))


def join(path: str, *parts: str) -> str:
    return posixpath.join(str(path), *parts)


def kind(path: str) -> str:
    """file, folder or none."""
    where, root = store(path)
    got = where.get_file_info(root).type
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(got, "none")


def exists(path: str) -> bool:
    return kind(path) != "none"


def write_bytes(path: str, data: bytes) -> None:
    where, root = store(path)
    where.create_dir(posixpath.dirname(root), recursive=True)
    with where.open_output_stream(root) as f:
        f.write(data)


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())


def read_bytes(path: str) -> bytes:
    where, root = store(path)
    with where.open_input_stream(root) as f:
        return f.read()


def read_text(path: str) -> str:
    return read_bytes(path).decode()


def listing(path: str, deep: bool = False) -> list[fs.FileInfo]:
    """What a folder holds, by name; nothing for a folder that does not exist."""
    where, root = store(path)
    return sorted(where.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=deep)), key=lambda i: i.path)


def delete(path: str) -> None:
    """Deletes a file, or a folder with all it holds; nothing happens where there is none."""
    where, root = store(path)
    if (found := kind(path)) == "folder":
        where.delete_dir(root)
    elif found == "file":
        where.delete_file(root)

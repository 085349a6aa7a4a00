"""File-system helpers over ``pyarrow.fs`` (local paths, ``file://``, ``s3://``, ``hdfs://``, ``gs://``)."""

from __future__ import annotations

import fnmatch
import posixpath

import pyarrow.fs as pafs


def filesystem(path: str):
    """``(FileSystem, path inside it)`` for a URI or a local path."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _static_prefix(pattern: str) -> str:
    parts = pattern.split("/")
    keep = []
    for p in parts:
        if any(ch in p for ch in "*?["):
            break
        keep.append(p)
    return "/".join(keep) or "/"


def _matches(path: str, pattern: str) -> bool:
    """Segment by segment: a wildcard never crosses a ``/``."""
    a, b = path.strip("/").split("/"), pattern.strip("/").split("/")
    return len(a) == len(b) and all(map(fnmatch.fnmatchcase, a, b))


def _hidden(path: str, base: str) -> bool:
    """Below ``base``, in a folder or file that a job in progress or a tool keeps to itself."""
    return any(s[:1] in ("_", ".") for s in posixpath.relpath(path, base).split("/"))


def expand(pattern: str, recursive: bool = False, sizes: dict | None = None) -> list[str]:
    """Files matching a glob pattern, sorted (file order decides "first" in dedup).

    ``sizes`` gets the size of every file that the listing met, matching or not.
    """
    fs, p = filesystem(pattern)
    scheme = pattern[: pattern.index("://") + 3] if "://" in pattern else ""
    host = ""
    if scheme and not pattern.startswith("file://"):
        rest = pattern[len(scheme):]
        host = rest[: len(rest) - len(p)] if rest.endswith(p) else ""
    if not any(ch in p for ch in "*?["):
        info = fs.get_file_info(p)
        if info.type == pafs.FileType.File:
            return [pattern]
        if info.type == pafs.FileType.Directory:
            sel = pafs.FileSelector(p, recursive=recursive)
            found = {scheme + host + i.path: i.size for i in fs.get_file_info(sel) if i.type == pafs.FileType.File and not _hidden(i.path, p)}
            if sizes is not None:
                sizes.update(found)
            return sorted(found)
        return []
    base = _static_prefix(p)
    info = fs.get_file_info(base)
    if info.type != pafs.FileType.Directory:
        return []
    depth = p.count("/") - base.rstrip("/").count("/")
    sel = pafs.FileSelector(base, recursive=recursive or depth > 1)
    out = []
    for i in fs.get_file_info(sel):
        if i.type != pafs.FileType.File:
            continue
        if _hidden(i.path, base):
            continue
        if sizes is not None:
            sizes[scheme + host + i.path] = i.size
        if _matches(i.path, p) or (recursive and fnmatch.fnmatchcase(posixpath.basename(i.path), posixpath.basename(p))):
            out.append(scheme + host + i.path)
    return sorted(out)


def read_range(path: str, offset: int, length: int) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        return f.read_at(length, offset)


def read_all(path: str) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        return f.read()


def exists(path: str) -> bool:
    fs, p = filesystem(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def write_bytes(path: str, data: bytes) -> None:
    fs, p = filesystem(path)
    fs.create_dir(posixpath.dirname(p), recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)


def write_chunks(path: str, chunks) -> None:
    fs, p = filesystem(path)
    fs.create_dir(posixpath.dirname(p), recursive=True)
    with fs.open_output_stream(p) as f:
        for chunk in chunks:
            f.write(chunk)


def move(src: str, dst: str) -> None:
    fs, s = filesystem(src)
    _, d = filesystem(dst)
    fs.create_dir(posixpath.dirname(d), recursive=True)
    fs.move(s, d)


def delete_dir(path: str) -> None:
    fs, p = filesystem(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def list_files(path: str, recursive: bool = True) -> list[str]:
    fs, p = filesystem(path)
    if fs.get_file_info(p).type != pafs.FileType.Directory:
        return []
    return [i.path for i in fs.get_file_info(pafs.FileSelector(p, recursive=recursive)) if i.type == pafs.FileType.File]


def delete_file(path: str) -> None:
    fs, p = filesystem(path)
    fs.delete_file(p)

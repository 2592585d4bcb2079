"""Folders and small documents below a root: a local path, or a URI of any file system that pyarrow and Spark both know."""

from __future__ import annotations

from pathlib import Path


def uri(root: str | Path) -> str:
    """The root as Spark takes it; local paths become absolute."""
    root = str(root)
    if "://" in root:
        return root.rstrip("/")
    return "file://" + str(Path(root.removeprefix("file:")).resolve())


def join(root: str | Path, *parts: str) -> str:
    return "/".join([uri(root), *(p.strip("/") for p in parts if p)])


def opened(root: str | Path):
    """(file system, path within it) of a root. Local paths are taken as they are written, without escapes."""
    from pyarrow import fs as pafs

    at = uri(root)
    if at.startswith("file://"):
        return pafs.LocalFileSystem(), at.removeprefix("file://")
    return pafs.FileSystem.from_uri(at)


def _children(at: str, recursive: bool) -> list:
    from pyarrow import fs as pafs

    files, base = opened(at)
    base = base.rstrip("/")
    found = files.get_file_info(pafs.FileSelector(base, recursive=recursive, allow_not_found=True))
    return [(f.path[len(base) :].lstrip("/"), f) for f in found]


def names(at: str, recursive: bool = True) -> list[str]:
    """Relative paths of the files below a folder, sorted; none where there is no such folder."""
    return sorted(name for name, f in _children(at, recursive) if f.is_file)


def folders(at: str) -> list[str]:
    """Names of the folders in a folder, sorted."""
    return sorted(name for name, f in _children(at, False) if not f.is_file)


def exists(at: str) -> bool:
    from pyarrow import fs as pafs

    files, path = opened(at)
    return files.get_file_info(path).type != pafs.FileType.NotFound


def read_text(at: str) -> str:
    files, path = opened(at)
    with files.open_input_stream(path, compression=None) as f:
        return f.read().decode("utf-8")


def write_text(at: str | Path, text: str) -> None:
    """Write beside and move, so that a reader never sees half a document."""
    import uuid

    files, path = opened(at)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as f:
        f.write(text.encode("utf-8"))
    files.move(part, path)


def remove(at: str) -> None:
    """A file, or a folder with what is in it, if it is there."""
    from pyarrow import fs as pafs

    files, path = opened(at)
    kind = files.get_file_info(path).type
    if kind == pafs.FileType.File:
        files.delete_file(path)
    elif kind == pafs.FileType.Directory:
        files.delete_dir(path)

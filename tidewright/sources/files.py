"""Opens files by path or URI, local or in any store that PyArrow knows."""

from __future__ import annotations

from pyarrow import fs


def file_system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_input(path: str):
    """A file with ``read``, ``seek`` and ``tell``."""
    system, name = file_system(path)
    return system.open_input_file(name)


def open_output(path: str):
    system, name = file_system(path)
    return system.open_output_stream(name, compression=None)


def file_sizes(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """The path itself if it is a file, else the files below it, in order, with their bytes; comma-separated paths one by one."""
    found: list[tuple[str, int]] = []
    for one in path.split(","):
        system, name = file_system(one)
        info = system.get_file_info(name)
        prefix = one[: len(one) - len(name)] if one.endswith(name) else ""
        if info.type == fs.FileType.Directory:
            below = system.get_file_info(fs.FileSelector(name, recursive=True))
            found += sorted((prefix + x.path, x.size) for x in below if x.is_file and x.path.endswith(suffix) and not x.base_name.startswith(("_", ".")))
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        else:
            found.append((one, info.size))
    return found


def list_files(path: str, suffix: str = "") -> list[str]:
    return [name for name, _ in file_sizes(path, suffix)]


def make_folder(path: str) -> None:
    system, name = file_system(path)
    system.create_dir(name, recursive=True)

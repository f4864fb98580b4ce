"""Binary files in the shared folder, opened from tasks."""

import pyarrow as pa
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened_output(uri: str) -> pa.NativeFile:
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def opened_input(uri: str) -> pa.NativeFile:
    system, path = located(uri)
    return system.open_input_stream(path)

"""Binary files in the folder that the cluster shares."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pyarrow.fs as pafs


def open_shared(uri: str, mode: str):
    """A file of the shared folder: a plain path, or any store that pyarrow knows."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, mode)
    fs, path = pafs.FileSystem.from_uri(uri)
    if "w" in mode:
        fs.create_dir(os.path.dirname(path), recursive=True)
        return fs.open_output_stream(path)
    return fs.open_input_file(path)


def rename_shared(old: str, new: str) -> None:
    if urlparse(old).scheme in ("", "file"):
        os.replace(urlparse(old).path, urlparse(new).path)
    else:
        fs, path = pafs.FileSystem.from_uri(old)
        fs.move(path, pafs.FileSystem.from_uri(new)[1])

"""Ranged reads and atomic writes on any store that pyarrow reaches, by URI or plain path."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


#: Bytes between two ranges that are read along rather than sought over, and the most that is read at once for several ranges.
GAP, RUN = 1 << 16, 8 << 20


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def read_range(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def runs(ranges: list[tuple[str, int, int]], gap: int = GAP, most: int = RUN) -> list[tuple[str, int, int, list[int]]]:
    """Ranges (uri, offset, length) as (uri, offset, length, their numbers): neighbours no further apart than gap go together up to most bytes."""
    out: list[tuple[str, int, int, list[int]]] = []
    for k in sorted(range(len(ranges)), key=ranges.__getitem__):
        uri, at, n = ranges[k]
        if out:
            same, first, length, held = out[-1]
            end = max(first + length, at + n)
            if same == uri and at - (first + length) <= gap and end - first <= most:
                out[-1] = (uri, first, end - first, [*held, k])
                continue
        out.append((uri, at, n, [k]))
    return out


def read_ranges(ranges: list[tuple[str, int, int]], gap: int = GAP, most: int = RUN) -> Iterator[tuple[int, memoryview]]:
    """The bytes of each range with its number, in the order of files and offsets; one file is open at a time, and each run is read once."""
    opened, f = None, None
    try:
        for uri, at, length, held in runs(ranges, gap, most):
            if uri != opened:
                if f is not None:
                    f.close()
                store, path = store_of(uri)
                opened, f = uri, store.open_input_file(path)
            data = memoryview(f.read_at(length, at))
            for k in held:
                yield k, data[ranges[k][1] - at : ranges[k][1] - at + ranges[k][2]]
    finally:
        if f is not None:
            f.close()


def exists(uri: str) -> bool:
    store, path = store_of(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def delete(uri: str) -> None:
    """Delete a folder."""
    store, path = store_of(uri)
    store.delete_dir(path)


def beside(uri: str, name: str) -> str:
    """A file of the same folder."""
    return f"{uri.rstrip('/').rsplit('/', 1)[0]}/{name}" if "/" in uri else name


@contextmanager
def writing(uri: str):
    """A stream to another name, renamed when all is written, so that no reader and no rerun sees half a file."""
    store, path = store_of(uri)
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft, compression=None) as f:
            yield f
    except BaseException:
        store.delete_file(draft)
        raise
    store.move(draft, path)


def write_whole(uri: str, data: bytes) -> None:
    with writing(uri) as f:
        f.write(data)

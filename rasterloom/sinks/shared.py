"""One file that many tasks write: a draft beside it, to which they add, and which is renamed when all is there.

Where the store is a file system that driver and tasks share, each piece is appended to the draft itself under a lock, and
its offset is known at once; what a failed attempt has appended is never named and stays as a gap. Elsewhere each task writes
a part, and finish() lines the parts up, some bytes at a time. No piece passes through the driver but in that second case.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

from pyarrow import fs

from rasterloom.sources import files

STEP = 8 << 20


class SharedFile:
    """dest: the file to be; head: bytes at its start that are written last."""

    def __init__(self, dest: str, head: int):
        self.dest, self.head = dest, head
        folder, _, name = dest.rstrip("/").rpartition("/")
        self.draft = f"{folder}/.{name}.{uuid.uuid4().hex}" if folder else f".{name}.{uuid.uuid4().hex}"

    @property
    def local(self) -> bool:
        return isinstance(files.store_of(self.dest)[0], fs.LocalFileSystem)

    def appender(self) -> Appender:
        return Appender(self)

    def place(self, at: int, data: bytes) -> None:
        """Write a piece whose offset is known; a local store only. Writing it again changes nothing."""
        _, draft = files.store_of(self.draft)
        os.makedirs(os.path.dirname(draft) or ".", exist_ok=True)
        f = os.open(draft, os.O_CREAT | os.O_RDWR, 0o644)
        try:
            view = memoryview(data)
            while view:
                n = os.pwrite(f, view, at)
                view, at = view[n:], at + n
        finally:
            os.close(f)

    def finish(self, parts: Iterable[str], tail: Callable[[dict[str, int], int], tuple[bytes, bytes]]) -> None:
        """Add the end and the head, which tail() gives from where each part begins and from where the end begins."""
        store, draft = files.store_of(self.draft)
        if self.local:
            os.makedirs(os.path.dirname(draft) or ".", exist_ok=True)
            with open(os.open(draft, os.O_CREAT | os.O_RDWR, 0o644), "r+b") as f:
                at = max(self.head, f.seek(0, os.SEEK_END))
                at += -at % 8
                head, end = tail({"": 0}, at)
                f.seek(at)
                f.write(end)
                f.seek(0)
                f.write(head)
            self.rename()
            return
        starts, at = {}, self.head
        for part in sorted(set(parts)):
            starts[part] = at
            at += store.get_file_info(f"{draft}/{part}").size
        head, end = tail(starts, at + -at % 8)
        with files.writing(self.dest) as out:
            out.write(head)
            for part in starts:
                with store.open_input_file(f"{draft}/{part}") as f:
                    while block := f.read(STEP):
                        out.write(block)
            out.write(bytes(-at % 8) + end)
        self.drop()

    def rename(self) -> None:
        os.replace(files.store_of(self.draft)[1], files.store_of(self.dest)[1])

    def drop(self) -> None:
        """Delete what has been written."""
        store, draft = files.store_of(self.draft)
        kind = store.get_file_info(draft).type
        if kind == fs.FileType.Directory:
            store.delete_dir(draft)
        elif kind == fs.FileType.File:
            store.delete_file(draft)


class Appender:
    """A task's way to add to a shared file; part names what it wrote, empty for the draft itself."""

    def __init__(self, file: SharedFile):
        self.file, self.part = file, ""

    def __enter__(self) -> Appender:
        store, draft = files.store_of(self.file.draft)
        if self.file.local:
            os.makedirs(os.path.dirname(draft) or ".", exist_ok=True)
            self.out = open(os.open(draft, os.O_CREAT | os.O_RDWR, 0o644), "r+b", buffering=0)  # noqa: SIM115
        else:
            self.part, self.at = f"part-{uuid.uuid4().hex}", 0
            store.create_dir(draft)
            self.out = store.open_output_stream(f"{draft}/{self.part}", compression=None)
        return self

    def put(self, data: bytes) -> int:
        """Add a piece; returns its offset in the draft or part."""
        if self.part:
            at = self.at
            self.out.write(data)
            self.at += len(data)
            return at
        import fcntl

        fcntl.lockf(self.out, fcntl.LOCK_EX)
        try:
            at = max(self.file.head, self.out.seek(0, os.SEEK_END))
            self.out.seek(at)
            view = memoryview(data)
            while view:
                view = view[self.out.write(view) :]
            return at
        finally:
            fcntl.lockf(self.out, fcntl.LOCK_UN)

    def __exit__(self, *failed) -> None:
        self.out.close()

"""Byte files in the shared folder, written and range-read by tasks."""

import uuid


def opened(path: str):
    """(file system, path in it) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Roller:
    """Files under a folder, a new one after `most` bytes. Names are new each attempt, so a retried task never
    writes into a file that another attempt's rows name."""

    def __init__(self, folder: str, suffix: str, most: int, end: bytes = b""):
        self.folder, self.suffix, self.most, self.end, self.out = folder, suffix, most, end, None

    def write(self, data: bytes) -> tuple[str, int]:
        """-> (URI, offset) of the data."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.name = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            system, path = opened(self.folder)
            system.create_dir(path)
            self.out, self.at = system.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}", compression=None), 0
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.write(self.end)
            self.out.close()
            self.out = None


class Ranges:
    """Range reads that keep the last file open."""

    def __init__(self):
        self.name = self.file = None

    def read(self, name: str, start: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            system, path = opened(name)
            self.file, self.name = system.open_input_file(path), name
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise EOFError(f"{name}: {len(data)} of {length} bytes at {start}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

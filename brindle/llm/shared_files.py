"""Opening files of the shared folder from tasks, by URI."""

from __future__ import annotations

from contextlib import suppress


def filesystem(uri: str):
    """(file system, path) of a URI: a mounted folder, an object store or HDFS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://") if uri.startswith("file:") else f"file://{uri}")


def publish(uri: str, write) -> int:
    """Run write(stream) on a file of this attempt's own name, then move it to uri. Returns its bytes.
    A task that is run again writes the same bytes, so whichever attempt comes last leaves the same file."""
    import uuid

    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(own) as stream:
            write(stream)
            size = stream.tell()
        system.move(own, path)
    except BaseException:
        with suppress(OSError):
            system.delete_file(own)
        raise
    return size

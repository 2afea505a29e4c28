"""Files of the shared store, opened by tasks."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The store (one that pyarrow opens: local, HDFS, S3, GCS) and the path in it."""
    return fs.FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


@contextmanager
def replaced(uri: str, attempt: str):
    """A stream whose bytes become the file once the block ends; after an error, or a lost task, the file is as it was.

    Attempts of one task write beside each other under their own names.
    """
    store, path = located(uri)
    draft = f"{path}.{attempt}.partial"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with store.open_output_stream(draft, compression=None) as out:
            yield out
        store.move(draft, path)
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise

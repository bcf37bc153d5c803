"""Record batches set aside on the executor's disk until all of a file is read."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes that stay in memory.
HELD = 1 << 22


def kept(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batches again, once all of them are there: whoever fails among them fails here, before the first one goes on."""
    f = tempfile.SpooledTemporaryFile(HELD)
    try:
        with pa.ipc.new_stream(f, schema) as out:
            for b in batches:
                out.write_batch(b)
    except BaseException:
        f.close()
        raise
    return _read(f)


def _read(f) -> Iterator[pa.RecordBatch]:
    with f:
        f.seek(0)
        yield from pa.ipc.open_stream(f)

"""Rows packed into compressed blobs by bucket, so that whole texts cross a shuffle at a fraction of their size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from lumenfold.llm.words import pieces, tidied

SCHEMA = "bucket long, blob binary"
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blobs: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def packer(assign: Callable[[pa.RecordBatch], list[np.ndarray]], limit: int = 16 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: assign gives, for each copy of the rows, a bucket per row (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=limit):
                names, blobs = [], []
                for buckets in assign(part):
                    order = np.argsort(buckets, kind="stable")
                    values, starts = np.unique(buckets[order], return_index=True)
                    for v, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                        if v >= 0:
                            names.append(v)
                            blobs.append(pack(part.take(pa.array(order[a:b]))))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return tidied(run)

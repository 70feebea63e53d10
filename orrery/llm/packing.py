"""Concatenate and cut: every document's tokens, one after the other, in fixed windows.

Two passes. The first tokenises each partition once and writes its rows with their offsets in the partition; the
totals of the partitions, summed up in order, are the partitions' global offsets. The second reads those rows, of
which each then knows its global place, and cuts windows; only the pieces of windows that cross tasks are shuffled.

Defined results: documents without text (null or empty) give no tokens and appear in no window; every other
document, however long, is followed by one end token. Rows are taken in the order in which Spark splits the stored files,
repeated rows and ids each for itself. That order is the same in every run over the same files with the same
spark.sql.files.maxPartitionBytes and openCostInBytes; it is not an order by key, so other settings or files that are cut
in another way give other windows of the same documents. A null doc_id stays null in the boundary records. The last window
may be short. An empty table gives no windows. Other columns are not looked at, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import doc_columns, trim, written
from ._tokens import TOKENIZERS, byte_tokens, file_bytes

SCHEMA = "window_id long, n_tokens int, tokens array<int>, segments array<struct<doc_id:long,start:int,end:int,doc_start:long>>"
SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("doc_start", pa.int64())])
PIECE = SCHEMA + ", piece_start int"


def tokenised(docs: DataFrame, ranks: bytes, end_id: int) -> DataFrame:
    """part, seq, doc_id, start (offset in the part), tokens (packed uint16)."""

    def run(batches):
        tokens, end = byte_tokens(ranks), np.uint16(end_id).tobytes()
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            ids, starts, packed = [], [], []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                if text := text.as_py():
                    ids.append(doc)
                    starts.append(at)
                    packed.append(tokens(text) + end)
                    at += len(packed[-1]) // 2
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())],
                ["part", "seq", "doc_id", "start", "tokens"],
            )
            seq += n
        trim()

    return docs.mapInArrow(run, "part int, seq long, doc_id long, start long, tokens binary")


def cut(window: int, bases: dict[int, int], whole: bool):
    """A task's runs of adjoining rows, cut into windows: the whole ones, or the pieces at the ends of runs."""

    def run(batches):
        def emit(buf, first, segs):
            """Windows of the tokens buf, the first of which is at the global place first; the rest comes back."""
            rows = []
            at, last = first, first + len(buf)
            while at < last:
                stop = min((at // window + 1) * window, last)
                if stop == last and stop % window and not closing:
                    break
                base = at // window * window
                if (stop - at == window) == whole:
                    own = [(d, max(a, at) - base, min(b, stop) - base, max(0, at - a)) for d, a, b in segs if a < stop and b > at]
                    rows.append((at // window, buf[at - first : stop - first], own, at - base))
                at = stop
                segs = [s for s in segs if s[2] > at]
            return rows, buf[at - first :], at, segs

        def batch(rows):
            tokens = [r[1] for r in rows]
            sizes = np.array([len(t) for t in tokens], np.int32)
            counts = np.array([len(r[2]) for r in rows], np.int32)
            flat = [s for r in rows for s in r[2]]
            segs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], f.type) for k, f in enumerate(SEGMENT)], fields=list(SEGMENT))
            offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(offsets(sizes), pa.array(np.concatenate(tokens).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets(counts), segs),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                ["window_id", "n_tokens", "tokens", "segments", "piece_start"],
            )

        kept, segs, first, size, closing = [], [], 0, 0, False
        for b in batches:
            rows = []
            for part, doc, start, packed in zip(b["part"].to_pylist(), b["doc_id"].to_pylist(), b["start"].to_pylist(), b["tokens"], strict=True):
                ids = np.frombuffer(packed.as_buffer(), np.uint16)
                at = bases[part] + start
                if at != first + size:
                    if size:
                        closing = True
                        rows += emit(np.concatenate(kept), first, segs)[0]
                        closing = False
                    kept, segs, first, size = [], [], at, 0
                kept.append(ids)
                segs.append((doc, at, at + len(ids)))
                size += len(ids)
                if first // window != (first + size) // window and (size >= 64 * window or len(ids) > window):
                    done, rest, first, segs = emit(np.concatenate(kept), first, segs)
                    kept, size, rows = [rest], len(rest), rows + done
                if len(rows) * window > 1_000_000:
                    yield batch(rows)
                    rows = []
            # what a later batch goes on with must not keep this batch's memory
            kept = [np.concatenate(kept).copy()] if kept else []
            if rows:
                yield batch(rows)
        closing = True
        if size and (rows := emit(np.concatenate(kept), first, segs)[0]):
            yield batch(rows)
        trim()

    return run


def pack(docs: DataFrame, window: int = 2048, end_id: int = 50256, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """window_id, n_tokens, tokens, segments (what the window holds of which document: [start, end) in the window,
    and the place in the document's tokens where that begins)."""
    rows = written(tokenised(doc_columns(docs), file_bytes(vocabulary, folder), end_id), "tokens")
    totals = rows.select("part", (F.col("start") + F.length("tokens") / 2).cast("long").alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    bases, at = {}, 0
    for part, n in sorted(map(tuple, totals.collect())):  # a row for each task of the first pass, whatever its size
        bases[part] = at
        at += n
    whole = rows.mapInArrow(cut(window, bases, True), PIECE).drop("piece_start")
    pieces = rows.mapInArrow(cut(window, bases, False), PIECE)
    joined = pieces.groupBy("window_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece_start", "tokens", "segments"))).alias("p"))
    joined = joined.select("window_id", "n_tokens", F.flatten(F.col("p.tokens")).alias("tokens"), F.flatten(F.col("p.segments")).alias("segments"))
    return whole.unionByName(joined)

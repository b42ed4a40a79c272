"""Sum-of-squares online packing of token ids into windows.

Each partition is an online stream. A document's full windows are cut off its front; the rest goes to the open window
whose fill level minimises the sum of squared counts of partially filled windows, read from an array of counts by fill
level. Ties take the fullest window. The pieces of windows that are open at the end of a stream are placed again, in streams
over the leftovers of all: round by round there are fewer, until one stream of at most `stream_pieces` is left, or a round
places less than half. What is then open in a stream is joined and cut anew into full windows, so padding stays near none
whatever the sizes are, and what remains, less than one window, leaves as sequences whose lengths are powers of two, which
need no padding. A stream holds at most `max_open` open windows; beyond that they are joined as at the end.

The column `how` says how a piece came into its sequence: `whole` (a full window of one document), `placed` (by sum of
squares) or `joined` (cut anew).

Defined results: null or empty text is the end id alone; null and repeated doc_ids are packed row by row; an empty
table gives no piece; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import staged
from graphloom.llm.tokens import WordEncoder, default_tokenizer, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, how string"
#: Bits of a sequence_id below the round's and below the stream's number.
ROUND_BITS, STREAM_BITS = 58, 34


class SumOfSquares:
    """Open windows by fill level. place() takes a piece and returns the windows that are full by it."""

    def __init__(self, width: int, max_open: int):
        self.width, self.max_open = width, max_open
        self.counts = np.zeros(width + 1, np.int64)  # open windows at each fill level
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The fill level at which a piece of `size` raises the sum of squares least."""
        n = self.counts
        top = self.width - size
        cost = 2 * (n[size : self.width + 1] - n[: top + 1]) + 2  # one window leaves level h, one comes to h + size
        cost[0] = 2 * n[size] + 1 if size < self.width else 0  # a new window leaves no level
        if top:
            cost[top] = 1 - 2 * n[top]  # a full window comes to no level
        usable = n[: top + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list[list]:
        size = piece[2]
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + size == self.width:
            return [window]
        self._keep(window, level + size)
        return []

    def _keep(self, window: list, level: int) -> None:
        self.open.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.n_open += 1

    def join(self) -> list[list]:
        """Cuts the open windows anew into full ones; less than one stays open."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        full, rest = cut(pieces, self.width)
        if rest:
            self._keep(rest, sum(p[2] for p in rest))
        return full

    def leave(self) -> list[list]:
        """All open windows as they are."""
        out, self.open, self.n_open = [w for ws in self.open.values() for w in ws], {}, 0
        self.counts[:] = 0
        return out

    def finish(self) -> list[list]:
        """All that is still open: full windows, then sequences of powers of two."""
        out = self.join()
        rest = [p for w in self.leave() for p in w]
        left = sum(p[2] for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            (first,), rest = cut_once(rest, size)
            out.append(first)
            left -= size
        return out


def cut_once(pieces: list, width: int) -> tuple[list[list], list]:
    first, rest, room = [], [], width
    for doc, start, size, ids, total in pieces:
        if room >= size:
            first.append((doc, start, size, ids, total))
            room -= size
        elif room:
            first.append((doc, start, room, ids[: room * 4], total))
            rest.append((doc, start + room, size - room, ids[room * 4 :], total))
            room = 0
        else:
            rest.append((doc, start, size, ids, total))
    return [first], rest


def cut(pieces: list, width: int) -> tuple[list[list], list]:
    full, current, fill = [], [], 0
    for doc, start, size, ids, total in pieces:
        at = 0
        while at < size:
            take = min(size - at, width - fill)
            current.append((doc, start + at, take, ids[at * 4 : (at + take) * 4], total))
            at, fill = at + take, fill + take
            if fill == width:
                full.append(current)
                current, fill = [], 0
    return full, current


class Stream:
    """One task's stream: pieces in, batches of finished pieces out."""

    def __init__(self, width: int, max_open: int, round_: int):
        from pyspark import TaskContext

        self.packer, self.width, self.max_open = SumOfSquares(width, max_open), width, max_open
        self.sequence, self.rows = (round_ << ROUND_BITS) + (TaskContext.get().partitionId() << STREAM_BITS), []

    def add(self, windows: list[list], how: str | None) -> None:
        """Finished windows; with `how` None, windows that are open for the next round."""
        for window in windows:
            offset = 0
            for doc, start, size, ids, total in window:
                self.rows.append((doc, start, size, ids, total, self.sequence, offset, how))
                offset += size
            self.sequence += 1

    def document(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.width
        whole = total - total % step
        self.add([[(doc, at, step, ids[at * 4 : (at + step) * 4], total)] for at in range(0, whole, step)], "whole")
        if whole < total:
            self.place((doc, whole, total - whole, ids[whole * 4 :], total))

    def place(self, piece: tuple) -> None:
        self.add(self.packer.place(piece), "placed")
        if self.packer.n_open > self.max_open:
            self.add(self.packer.join(), "joined")

    def batch(self):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("how", pa.string())])
        columns, self.rows = [*zip(*self.rows, strict=True)] or [[]] * len(schema), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, width: int = 2048, max_open: int = 8192, stream_pieces: int = 16_384) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset, how."""
    path = tokenizer or default_tokenizer()

    def first_round(batches):
        encoder, stream = WordEncoder.of(path), Stream(width, max_open, 0)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder.ids(part["text"]), strict=True):
                    stream.document(doc, ids + end)
                yield stream.batch()
        stream.add(stream.packer.leave(), None)
        yield stream.batch()

    def again(round_: int, last: bool):
        def run(batches):
            stream = Stream(width, max_open, round_)
            for batch in batches:
                for part in slices(batch, column="ids"):
                    for row in part.to_pylist():
                        stream.place(tuple(row[c] for c in ("doc_id", "start", "length", "ids", "doc_tokens")))
                    yield stream.batch()
            if last:
                stream.add(stream.packer.finish(), "joined")
            else:
                stream.add(stream.packer.leave(), None)
            yield stream.batch()

        return run

    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first_round, SCHEMA), "pieces")
    done, round_, before = pieces.where("how IS NOT NULL"), 0, None
    while True:
        left, round_ = pieces.where("how IS NULL"), round_ + 1
        n = left.count()
        streams = max(-(-n // stream_pieces), 1)
        last = streams == 1 or before is not None and n > before / 2
        pieces, before = staged(left.coalesce(streams).mapInArrow(again(round_, last), SCHEMA), "pieces"), n
        done = done.unionByName(pieces.where("how IS NOT NULL"))
        if last:
            return done


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "how")


def op6_packing(spark, sf_dir):
    return pieces_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))

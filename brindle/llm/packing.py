"""Mixture-controlled packing of documents into token windows.

Documents are dealt to parts by a hash of their ids, so every part holds each
source in about its share and no source, however large, sits in one place. A
task streams through its parts with one queue a source. Each window is filled
by deficit round-robin: every source is owed its target share of the window,
the sources with the largest deficit are served first, and what a source got
too little or too much is carried to the next window. What a part starts with
is carried from the parts before it: the running difference between target
and supply of each source, which one aggregation and one window give. A window
pays back at most half a source's share, so a large debt is spread over many.
The rest of a part goes into windows whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import text_slices
from brindle.llm.token_counts import TokenIds, merge_table

WINDOW = 2048
#: Id after each document.
END_ID = 1
#: Bytes of text in a part.
PART_BYTES = 8 << 20
#: What is left of a window is filled in pieces of so many tokens, or of half a source's part of it if that is less.
LEAST_PIECE = 128
#: Parts of its target share that a source gets of a window at least and at most, while it and others have tokens.
LEAST_SHARES, MOST_SHARES = 0.5, 1.5
#: Tokens that wait in a task before windows are filled, for a choice of sources.
WAITING = 64 * WINDOW

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Packer:
    """Queues of one part and the windows filled from them.

    Shares and carried debts come in bytes of text; they are turned into tokens
    by what the part's own texts come to, source by source. With ``by_tokens``
    shares are of tokens already.
    """

    def __init__(self, part: int, window: int, by_tokens: bool = False):
        self.window, self.next_id, self.by_tokens = window, part << 32, by_tokens
        self.share: dict[str, float] = {}
        self.owed: dict[str, float] = {}
        self.carried: dict[str, float] = {}
        self.bytes: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.queues: dict[str, deque] = {}
        self.held: dict[str, int] = {}
        self.waiting = 0
        self.out: list[tuple] = []

    def source(self, name: str, share: float, carried: float) -> None:
        self.share[name], self.carried[name] = share, carried
        self.owed.setdefault(name, 0.0)

    def add(self, name: str, doc_id: int, ids: np.ndarray, size: int = 0) -> None:
        self.queues.setdefault(name, deque()).append([doc_id, ids, 0])
        self.held[name] = self.held.get(name, 0) + len(ids)
        self.tokens[name] = self.tokens.get(name, 0) + len(ids)
        self.bytes[name] = self.bytes.get(name, 0) + (size or len(ids))
        self.owed.setdefault(name, 0.0)
        self.share.setdefault(name, 0.0)
        self.waiting += len(ids)

    def targets(self) -> dict[str, float]:
        """Tokens a byte of each source, then its share of a window's tokens."""
        every = sum(self.tokens.values()) / max(1, sum(self.bytes.values()))
        rate = {n: self.tokens[n] / self.bytes[n] if self.bytes.get(n) else every for n in self.share}
        for n, gap in self.carried.items():
            self.owed[n] += gap * rate[n]
        self.carried = {}
        part = {n: x * (1 if self.by_tokens else rate[n]) for n, x in self.share.items()}
        whole = sum(part.values()) or 1.0
        return {n: x / whole for n, x in part.items()}

    def fill(self, size: int) -> None:
        """One sequence of ``size`` tokens; so many must wait."""
        share = self.targets()
        for name, x in share.items():
            self.owed[name] += x * size
        queued = sorted((n for n in self.held if self.held[n]), key=lambda n: (-self.owed[n], n))
        low = {n: LEAST_SHARES * share[n] * size for n in queued}
        due = {n: min(max(self.owed[n], low[n]), MOST_SHARES * share[n] * size) for n in queued}
        over, spare = sum(due.values()) - size, sum(due.values()) - sum(low.values())
        if over > 0 and spare > 0:  # what goes beyond the least shares is cut alike
            due = {n: low[n] + (due[n] - low[n]) * max(0.0, 1 - over / spare) for n in queued}
        elif over < 0 and (whole := sum(due.values())):  # some sources are dry: the others fill their room
            due = {n: x * size / whole for n, x in due.items()}
        room, offset = size, 0
        for name in queued:
            take = min(room, self.held[name], int(due[name]))
            if take:
                offset, room = self.take(name, take, offset), room - take
        while room:  # what rounding and short queues leave goes to the largest debts
            name = min((n for n in self.held if self.held[n]), key=lambda n: (-self.owed[n], n))
            take = min(room, self.held[name], max(int(min(LEAST_PIECE, share[name] * size / 2)), int(self.owed[name]), 1))
            offset, room = self.take(name, take, offset), room - take
        self.next_id += 1
        self.waiting -= size

    def take(self, name: str, tokens: int, offset: int) -> int:
        self.owed[name] -= tokens
        self.held[name] -= tokens
        queue = self.queues[name]
        while tokens:
            doc_id, ids, start = head = queue[0]
            n = min(tokens, len(ids) - start)
            self.out.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.next_id, offset))
            offset, tokens = offset + n, tokens - n
            head[2] += n
            if head[2] == len(ids):
                queue.popleft()
        return offset

    def drain(self, down_to: int) -> None:
        while self.waiting >= max(down_to, self.window):
            self.fill(self.window)

    def finish(self) -> None:
        self.drain(0)
        while self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 7)], names=NAMES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, targets: DataFrame | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all ``docs`` (doc_id, source, text).

    A document is its token ids and END_ID; it may be cut anywhere, and each id
    lies in exactly one piece. Every sequence has ``window`` tokens but the
    last few of each part, whose sizes are powers of two. ``targets`` (source,
    share of tokens) sets the mixture; by default it is each source's own share.
    When a source runs dry the others fill its room.

    A null text is empty (one id, END_ID). A null source is a source of its
    own, named ''. Rows that repeat an id are packed each; a null id stays
    null. Documents of any length are taken whole. Other columns aren't read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // part_bytes) or 1  # how texts are dealt, not how many tasks there are
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(parts))
    supply = rows.select("source", part.alias("part"), size.alias("size")).groupBy("part", "source").agg(F.sum("size").alias("size"))
    by_source = supply.groupBy("source").agg(F.sum("size").alias("all"))
    if targets is None:
        shares = by_source.select("source", (F.col("all") / F.lit(max(total, 1))).alias("share"))
    else:
        given = targets.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("share").cast("double").alias("share"))
        shares = by_source.select("source").join(given, "source", "left").select("source", F.coalesce("share", F.lit(0.0)).alias("share"))
    part_size = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = supply.groupBy("part").agg(F.sum("size").alias("part_size"))
    # running difference of target and supply before each part, in bytes
    ahead = supply.join(sizes, "part").join(shares, "source").withColumn("gap", F.col("share") * F.col("part_size") - F.col("size"))
    carried = ahead.select("part", "source", "share", F.coalesce(F.sum("gap").over(part_size), F.lit(0.0)).alias("carried"))
    heads = carried.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "source", F.lit(None).cast("string").alias("text"), "share", "carried")
    body = rows.select(part.alias("part"), F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text",
        F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("carried"))
    dealt = heads.unionByName(body).repartition("part").sortWithinPartitions("part", "kind", F.xxhash64("doc_id"), "doc_id")

    by_tokens = targets is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, now = TokenIds(merge_table(tokenizer_path)), None, None
        for batch in batches:
            which, kinds, ids, sources = (batch.column(i).to_pylist() for i in range(4))
            share, carry = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            texts = batch.column(4)
            for a, b, _, offsets in text_slices(batch):
                size = np.diff(offsets) + 1
                encoded = encoder.encode([x or "" for x in texts.slice(a, b - a).to_pylist()])
                for i, tokens in zip(range(a, b), encoded, strict=True):
                    if which[i] != now:
                        if packer is not None:
                            packer.finish()
                            yield packer.batch()
                        now = which[i]
                        packer = Packer(now, window, by_tokens)
                    if kinds[i] == 0:
                        packer.source(sources[i], share[i], carry[i])
                    else:
                        packer.add(sources[i], ids[i], np.append(tokens, np.uint32(END_ID)).astype("<u4"), int(size[i - a]))
                packer.drain(WAITING)
                yield packer.batch()
        if packer is not None:
            packer.finish()
            yield packer.batch()

    return dealt.mapInArrow(run, PIECES)

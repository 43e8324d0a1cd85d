"""Hierarchical multi-length packing.

Documents become token ids. Whole windows are cut off long documents; what remains of each
is routed to the tier of the smallest context size that holds it. Each tier is packed into
windows of its own context size, from the longest tier down: a window opens with the tier's
longest document, its gap is filled with the longest ones of any shorter tier that fit, and
the last bit with a piece cut off the next. What can't fill a window at the end goes to
full windows of smaller powers of two. Sequences of all tiers are dealt to step groups so
that their attention costs are even.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_id long"


class Tokenizer:
    """Ids of a byte-level BPE file; its special strings in a text are their tokens. Texts that
    the fast library gives up on (it panics on some very long runs) go to the slow one."""

    def __init__(self, ranks: str, pattern: str, slow: str) -> None:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(slow, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens=special)
        self.path, self.slow = slow, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # the library's own; it has no importable name
                raise
        if self.slow is None:
            from tokenizers import Tokenizer as Slow

            self.slow = Slow.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def tier_of(length: int, window: int, smallest: int) -> int:
    """The smallest context size, halving from window to smallest, that holds length."""
    size = window
    while size // 2 >= max(length, smallest):
        size //= 2
    return size


class Tiers:
    """What is left to pack: (length, -document, start) by context size, shortest first."""

    def __init__(self, sizes: list[int], window: int, lengths: list[int]) -> None:
        self.sizes = sizes  # the longest first
        self.items: dict[int, list[tuple[int, int, int]]] = {s: [] for s in sizes}
        for doc, length in enumerate(lengths):
            if rest := length % window:
                self.items[tier_of(rest, window, sizes[-1])].append((rest, -doc, length - rest))
        for items in self.items.values():
            items.sort()
        self.left = sum(x[0] for items in self.items.values() for x in items)

    def longest(self, gap: int, size: int, kept: dict[int, int]) -> tuple[int, int, int] | None:
        """Takes the longest document of at most gap ids; longer windows leave a tier what it keeps."""
        for s in self.sizes:
            items = self.items[s]
            if len(items) > (kept[s] if s < size else 0) and items[0][0] <= gap:
                return items.pop(bisect.bisect_right(items, (gap, 1, 0)) - 1)
        return None

    def cut(self, room: int, size: int) -> tuple[int, int, int]:
        """Cuts at most room ids off the longest document for windows of size or less (else the
        next longer); the rest goes to its tier."""
        at = self.sizes.index(max(size, self.sizes[-1]))
        length, doc, start = next(self.items[s] for s in [*self.sizes[at:], *reversed(self.sizes[:at])] if self.items[s]).pop()
        took = min(room, length)
        if took < length:
            bisect.insort(self.items[tier_of(length - took, self.sizes[0], self.sizes[-1])], (length - took, doc, start + took))
        return took, doc, start

    def fill(self, size: int, spare: int, kept: dict[int, int]) -> list[tuple[int, int, int]]:
        """The pieces (document, start, length) of a window: its tier's longest document, the
        longest ones that fit, then pieces cut to what room is left, unless that is at most spare."""
        pieces, room = [], size
        while room > spare and self.left:
            own = self.items.get(size)
            length, doc, start = own.pop() if own and not pieces else self.longest(room, size, kept) or self.cut(room, size)
            pieces.append((-doc, start, length))
            room -= length
            self.left -= length
        return pieces


def pack(lengths: list[int], window: int, min_piece: int, smallest: int = 128, keep: float = 0.25) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (context size, pieces), a piece as (document, start, length).

    Every id lies in one piece. Each tier is packed into windows of its own context size, from
    the longest down; a window opens with the longest document of its tier. Longer windows
    leave each tier the share keep of its documents. Only windows of the longest size may
    keep a gap, below min_piece; all others are powers of two and full. Of documents of one
    length the first comes first.
    """
    sizes = [window]
    while sizes[-1] // 2 >= smallest:
        sizes.append(sizes[-1] // 2)
    out = [(window, [(doc, start, window)]) for doc, length in enumerate(lengths) for start in range(0, length - window + 1, window)]
    tiers = Tiers(sizes, window, lengths)
    kept = {s: int(keep * len(items)) for s, items in tiers.items.items()}
    for size in sizes:
        while tiers.items[size] and tiers.left >= size:
            out.append((size, tiers.fill(size, min_piece - 1 if size == window else 0, kept)))
    size, none = window, dict.fromkeys(sizes, 0)
    while tiers.left:  # less than a window of the tier: full windows of smaller powers of two
        if tiers.left < size:
            size //= 2
        else:
            out.append((size, tiers.fill(size, 0, none)))
    return out


def step_groups(costs: list[int], group: int) -> list[int]:
    """A step for each sequence, group of them to a step, so that the steps' costs are even:
    from the costliest on, rounds of one to each step, back and forth."""
    steps = max(1, -(-len(costs) // group))
    out = [0] * len(costs)
    for i, at in enumerate(sorted(range(len(costs)), key=lambda j: (-costs[j], j))):
        turn, place = divmod(i, steps)
        out[at] = place if turn % 2 == 0 else steps - 1 - place
    return out


def pack_documents(
    docs: DataFrame,
    *,
    ranks: str,
    pattern: str,
    slow: str,
    window: int = 2048,
    end_id: int = 1,
    min_piece: int = 8,
    block_tokens: int = 4_000_000,
    group: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece (PIECES); context is the sequence's size, step_id its step group.

    A document is its text's ids, then end_id; a null text counts as empty. Each partition is
    packed by itself in blocks of block_tokens ids, so nothing is shuffled and memory is
    bounded; a document over that is a block of its own. Documents keep their order in
    blocks; a task that runs again over the same stored rows gives the same sequences. Ids of
    documents may repeat or be null; such rows are packed like any other. Of documents of one
    length the first in the partition is packed first. An empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks, pattern, slow)
        base, used = TaskContext.get().partitionId() << 33, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal used, size
            packed = pack([len(x) for x in ids], window, min_piece)
            steps = step_groups([sum(p[2] ** 2 for p in pieces) for _, pieces in packed], group)
            cols: list[list] = [[] for _ in range(9)]
            for k, (context, pieces) in enumerate(packed):
                offset = 0
                for doc, start, length in pieces:
                    whole = ids[doc]
                    row = (names[doc], start, length, crc32(whole[start : start + length]), len(whole), base + used + k, offset, context, base + used + steps[k])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += length
            used += len(packed)
            ids.clear()
            names.clear()
            size = 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                found = np.append(tokenizer.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                ids.append(found)
                names.append(doc_ids[i])
                size += len(found)
                if size >= block_tokens:
                    yield flush()
                    tidy()
        if ids:
            yield flush()
        del tokenizer
        tidy()

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out

"""Filling windows of a fixed number of tokens with documents: bounded-space online packing.

Every partition keeps at most OPEN open windows. A document goes into the open window it fits best (the one it leaves
the least room in); if it fits into none, the fullest window is emitted and a new one opened. Only a document that
exceeds the capacity by itself is split, into full windows and a remainder that is packed like any other. What is left
open at the end of the partitions, a bounded number of windows each, is merged by the same packing over groups of
partitions.

Defined results: null texts and texts without tokens are placed nowhere (they have nothing to place); equal texts are
placed each; every token of every other document is placed exactly once; windows hold at most the capacity; an empty
table gives no rows; further columns are ignored. Which documents share a window depends on the order they are read in.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PLACED = "window string, doc_id bigint, token_from bigint, token_to bigint, left_open boolean"


def token_counter(content: bytes) -> Callable[[list[str]], list[int]]:
    """Sizes of texts in tokens of a tokenizer file's content, one "base64 rank" pair a line."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


class Packer:
    """Open windows by free room; emits windows as (number, parts)."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.rooms: list[tuple[int, int]] = []  # (room, number), sorted
        self.parts: dict[int, list[tuple[int, int, int]]] = {}
        self.next = 0

    def add(self, parts: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
        """Place parts (document, from, to) of one size in one window; the windows that had to be emitted."""
        out = []
        at = bisect_right(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
            self.parts[number] += parts
        else:
            if len(self.rooms) >= self.most_open:
                out.append(self.parts.pop(self.rooms.pop(0)[1]))
            number, room = self.next, self.capacity
            self.next += 1
            self.parts[number] = list(parts)
        if room == size:
            out.append(self.parts.pop(number))
        else:
            insort(self.rooms, (room - size, number))
        return out

    def leftovers(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        return [(self.capacity - room, self.parts[number]) for room, number in self.rooms]


def _batch(windows: list[tuple[str, list, bool]]) -> pa.RecordBatch:
    rows = [(name, *part, left) for name, parts, left in windows for part in parts]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["window", "doc_id", "token_from", "token_to", "left_open"])


def pack(documents: DataFrame, capacity: int = 2048, most_open: int = 64, tokenizer: str = TOKENIZER, merge_fan: int = 16) -> DataFrame:
    """documents: doc_id, text. (window, doc_id, token_from, token_to): which tokens of which document lie in which window.

    The open windows of about merge_fan partitions at a time are merged, so a merging task holds a bounded number of them.
    """
    from pathlib import Path

    from sableflow.session import cut

    content = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())  # only the driver needs the file; a vocabulary has a few megabytes

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, packer, n, tag = None, Packer(capacity, most_open), 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            count = count or token_counter(content.value)
            ids = batch.column(0).to_pylist()
            tag = tag or f"{ids[0]}-"
            full: list[tuple[str, list, bool]] = []

            def emit(windows: list, full: list = full) -> None:
                nonlocal n
                for w in windows:
                    full.append((f"{tag}{n}", w, False))
                    n += 1

            for doc, size in zip(ids, count(batch.column(1).to_pylist()), strict=True):
                whole = size - size % capacity if size > capacity else 0
                emit([[(doc, a, a + capacity)] for a in range(0, whole, capacity)])
                if size > whole:
                    emit(packer.add([(doc, whole, size)], size - whole))
            yield _batch(full)
        yield _batch([(f"{tag}o{k}", parts, True) for k, (_, parts) in enumerate(packer.leftovers())])

    def merge(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, n, tag = Packer(capacity, most_open), 0, ""
        held: dict[str, list] = {}
        for df in groups:
            for row in df.itertuples(index=False):
                held.setdefault(row.window, []).append((row.doc_id, row.token_from, row.token_to))
        out = []
        for name in sorted(held, key=lambda w: (-sum(b - a for _, a, b in held[w]), w)):  # large windows first leave less room unused
            tag = tag or f"m{name}-"
            size = sum(b - a for _, a, b in held[name])
            # a window is opened up: its documents may go to different windows
            for part in sorted(held[name], key=lambda p: p[1] - p[2]) if size < capacity * 0.9 else [None]:
                done = packer.add([part], part[2] - part[1]) if part else [held[name]]
                for w in done:
                    out += [(f"{tag}{n}", *p, False) for p in w]
                    n += 1
        for _, parts in packer.leftovers():
            out += [(f"{tag}{n}", *p, False) for p in parts]
            n += 1
        if out:
            yield pd.DataFrame(out, columns=["window", "doc_id", "token_from", "token_to", "left_open"])

    texts = documents.select("doc_id", "text").where("text is not null and text != ''")
    placed = cut(texts.mapInArrow(of, PLACED))
    groups = -(-placed.rdd.getNumPartitions() // merge_fan)
    left = placed.where("left_open").repartition(groups, F.xxhash64("window")).mapInPandas(merge, PLACED)
    return placed.where("not left_open").unionByName(left).drop("left_open")


def fill_rate(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Windows, tokens and the share of room that is used."""
    return placed.groupBy("window").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used")).agg(
        F.count("*").alias("windows"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill_rate"),
    )



"""Token counts of a byte-level BPE vocabulary without emitting identifiers.

Each pre-token starts as a doubly linked list of byte symbols with a heap of its adjacent pairs. The
pair of lowest rank (leftmost among equals) is popped and merged until no pair has a rank; stale heap
entries are recognised by the symbols they name. The count is the initial symbols less the merges, in
O(n log n) for a run of n bytes. Workers remember the counts of short pre-tokens, in a bounded table
that is emptied when full; it changes no result.

Defined cases: null text counts as empty (0 bytes, 0 tokens); added special tokens inside a text count
as one token each, as the library does by default; texts are never cut; rows and ids are passed on as
they are, null or repeated; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfuse.session import ship

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBER, SHORT = 1 << 20, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Counts(dict):
    """Pre-token -> number of tokens; computes what it lacks."""

    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))
        vocab = model["model"]["vocab"]
        self.first = [vocab[c] for c in byte_symbols()]
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 20 | vocab[right]] = r << 20 | vocab[left + right]
        self.special = [t["content"] for t in model.get("added_tokens", []) if t["content"]]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(SPLIT)

    def __missing__(self, token: str) -> int:
        n = self.merged(token.encode("utf-8", "surrogatepass"))
        if len(token) <= SHORT:
            if len(self) >= REMEMBER:
                self.clear()
            self[token] = n
        return n

    def merged(self, data: bytes) -> int:
        """Initial symbols less merges."""
        rank, first = self.rank, self.first
        sym = [first[b] for b in data]
        n = len(sym)
        if n < 2:
            return n
        get = rank.get
        # a heap entry holds rank, place and the merged symbol: r << 60 | place << 20 | new
        heap = []
        for i in range(n - 1):
            r = get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                heap.append((r >> 20) << 60 | i << 20 | (r & 0xFFFFF))
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            e = heappop(heap)
            i = e >> 20 & 0xFFFFFFFFFF
            j = after[i]
            a = sym[i]
            if a < 0 or j >= n:
                continue
            r = get(a << 20 | sym[j])
            if r is None or (r >> 20) != e >> 60:
                continue
            new = e & 0xFFFFF
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = get(new << 20 | sym[k])
                if r is not None:
                    heappush(heap, (r >> 20) << 60 | i << 20 | (r & 0xFFFFF))
            h = before[i]
            if h >= 0:
                r = get(sym[h] << 20 | new)
                if r is not None:
                    heappush(heap, (r >> 20) << 60 | h << 20 | (r & 0xFFFFF))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if len(text) <= 1 << 22:
            return sum(map(self.__getitem__, self.split.findall(text)))
        return sum(self[m.group()] for m in self.split.finditer(text))


@lru_cache(maxsize=4)
def counts(path: str) -> Counts:
    return Counts(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row. path: the vocabulary's file, which each
    executor opens itself (it comes with the installed package)."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counts(path)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array((counter.count(t.as_py()) for t in texts), pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    out = slim.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

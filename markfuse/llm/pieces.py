"""SentencePiece encoding and decoding by one pass of an Aho-Corasick automaton over the pieces.

The automaton reads a text once; at each position it follows the output links to every piece that ends
there and relaxes the best score of a path to that position (Viterbi). A piece's score is the model's; a
character that no piece holds costs ten less than the worst piece and becomes byte pieces, or the unknown
piece where the model has none. Of equally good paths, the one whose last piece is longer wins. For
unigram models this is the library's own segmentation.

Byte-pair models score a piece by its merge order, and the library does not maximise the sum of these
scores but merges pair by pair. The best path over the model's scores is therefore another segmentation
into the same pieces, with the same exact round trip; `by="merges"` gives the library's, from a heap of
adjacent pairs.

No piece has a word character before a space mark, so texts are encoded word by word, and workers
remember short words in two bounded tables, of which the older is dropped when the newer is full and both
when a task ends; that changes no result. (Models that do have such pieces are encoded text by text.)

Decoding joins the pieces, gives bytes back their characters, turns marks into spaces and takes away
the one the encoder put in front. The round trip is exact but for the mark U+2581 itself, which comes
back as a space, and for models that normalise.

Defined cases: null counts as empty and has no pieces; whole texts are encoded whatever their length;
ids and other chosen columns pass through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfuse.session import ship

MARK = "▁"
REMEMBER, SHORT = 1 << 17, 48
NORMAL, UNKNOWN, CONTROL, BYTE, USER = 1, 2, 3, 6, 4
NOWHERE: dict[str, int] = {}  # the steps of all states that have none


class Automaton:
    """Aho-Corasick over strings: `next` has the trie's steps of each state, `fail` the state of the longest
    proper suffix, `ends` what ends at a state, longest first, along the output links: (length, score,
    number) of each. Nothing is added once it is built."""

    def __init__(self, items: list[tuple[str, int]], score: Sequence[float]):
        nexts: list[dict[str, int]] = [{}]
        own, level = [-1], [[]]
        for text, number in items:
            at = 0
            for depth, c in enumerate(text, 1):
                after = nexts[at].get(c)
                if after is None:
                    if nexts[at] is NOWHERE:
                        nexts[at] = {}
                    after = nexts[at][c] = len(own)
                    own.append(-1)
                    nexts.append(NOWHERE)
                    if depth == len(level):
                        level.append([])
                    level[depth].append((at, c))
                at = after
            own[at] = number
        self.next, self.fail = nexts, array("i", bytes(4 * len(own)))
        self.ends: list[tuple[tuple[int, float, int], ...]] = [()] * len(own)
        for depth, steps in enumerate(level):  # by depth, so what a state falls back to is known
            for before, c in steps:
                at = nexts[before][c]
                back = self.fail[at] = self.step(self.fail[before], c) if before else 0
                p = own[at]
                self.ends[at] = (((depth, score[p], p),) if p >= 0 else ()) + self.ends[back]

    def step(self, state: int, c: str) -> int:
        after = self.next[state].get(c)
        while after is None and state:
            state = self.fail[state]
            after = self.next[state].get(c)
        return after or 0


class Pieces(dict):
    """A model; as a mapping, word -> its piece numbers as bytes of int32."""

    def __init__(self, data: bytes, by: str = "score"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap:
            raise ValueError("models with a normalisation table are not supported")
        self.path = {"score": self.best, "merges": self.merged}[by]
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        text, kind = [p.piece for p in model.pieces], [p.type for p in model.pieces]
        self.score = array("d", [p.score for p in model.pieces])
        self.length = array("i", map(len, text))
        self.unknown = kind.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(text, kind, strict=True)) if k == BYTE}
        mark = MARK.encode()
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else t.encode().replace(mark, b" ") for t, k in zip(text, kind, strict=True)]
        plain = [(t, i) for i, (t, k) in enumerate(zip(text, kind, strict=True)) if k in (NORMAL, USER)]
        self.number = dict(plain) if by == "merges" else {}
        self.auto = Automaton(plain if by == "score" else [], self.score)
        self.unknown_score = min((self.score[i] for _, i in plain), default=0.0) - 10.0
        self.older: dict[str, bytes] = {}
        crossing = any(MARK in t.lstrip(MARK) for t, _ in plain)
        chars = {c for t, _ in plain for c in t}
        stop = "".join(c for c in "\n\r\t" if c not in chars)
        # spaces become marks word by word: words of plain letters take less room with spaces
        gap = f"[ {MARK}]"
        self.split = re.compile("(?s).+" if crossing else (f"[{stop}]|" if stop else "") + f"{gap}*[^ {MARK}{stop}]+|{gap}+")

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = array("i", self.path(word.replace(" ", MARK))).tobytes()
        if len(word) <= SHORT:
            if len(self) >= REMEMBER:  # what was not met since the last time is forgotten
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def best(self, word: str) -> list[int]:
        """Piece numbers of the path of best score, in one pass."""
        nexts, fail, ends, unknown = self.auto.next, self.auto.fail, self.auto.ends, self.unknown_score
        length = self.length
        last, best = [-1], [0.0]  # the piece that ends the best path to each position; that path's score
        state = i = 0
        for c in word:
            after = nexts[state].get(c)
            while after is None and state:
                state = fail[state]
                after = nexts[state].get(c)
            state = after or 0
            i += 1
            top, found, n = -1e300, -1, 0
            for n, gain, p in ends[state]:
                total = best[i - n] + gain
                if total > top:
                    top, found = total, p
            if n != 1:  # no piece of this character alone
                total = best[-1] + unknown
                if total > top:
                    top, found = total, -1
            last.append(found)
            best.append(top)
        ids: list[int] = []
        while i:
            p = last[i]
            if p >= 0:
                ids.append(p)
                i -= length[p]
            else:
                i -= 1
                ids += self.odd(word[i], ids)[::-1]
        ids.reverse()
        return ids

    def merged(self, word: str) -> list[int]:
        """Piece numbers as byte-pair merging leaves them: the adjacent pair whose piece scores best, the
        leftmost of equal ones, is joined until no pair is a piece."""
        number, score, n = self.number, self.score, len(word)
        part: list[str] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int, j: int) -> tuple | None:
            p = number.get(part[i] + part[j])
            return None if p is None else (-score[p], i, part[i] + part[j])

        heap = [x for x in (pair(i, i + 1) for i in range(n - 1)) if x]
        heapify(heap)
        while heap:
            _, i, text = heappop(heap)
            j = after[i]
            if j >= n or part[i] + part[j] != text:  # one of the two has been joined elsewhere
                continue
            part[i], part[j] = text, ""
            k = after[i] = after[j]
            for a, b in ((before[i], i), (i, k)):
                x = pair(a, b) if a >= 0 and b < n else None
                if x:
                    heappush(heap, x)
            if k < n:
                before[k] = i
        ids: list[int] = []
        for text in part:
            if text:
                p = number.get(text)
                ids += self.odd(text, ids) if p is None else [p]
        return ids

    def odd(self, c: str, beside: list[int]) -> list[int]:
        """What stands for a character without a piece; unknown pieces side by side are one."""
        if self.bytes:
            return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [] if beside and beside[-1] == self.unknown else [self.unknown]

    def encode(self, text: str | None) -> bytes:
        """Piece numbers as bytes of int32."""
        if not text:
            return b""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return b""
        if self.prefix:
            text = " " + text
        return b"".join(map(self.__getitem__, self.split.findall(text)))

    def decode(self, ids: Iterable[int]) -> str:
        whole = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return whole[1:] if self.prefix and whole.startswith(" ") else whole


@lru_cache(maxsize=1)
def pieces(path: str, by: str = "score") -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read(), by)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), check: bool = False, by: str = "score") -> DataFrame:
    """id, the columns of `keep`, n_pieces, pieces array<int> and, with check, round_trip (decoding gives
    the text back). path: the model's file, which each executor opens itself. by: score (best path) or
    merges (a byte-pair model as the library applies it)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), *(F.col(k) for k in keep), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    names = slim.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, by)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                flat, offsets, same = array("i"), [0], []
                for value in batch.column(len(names)):
                    text = value.as_py()
                    ids = model.encode(text)
                    flat.frombytes(ids)
                    offsets.append(len(flat))
                    if check:
                        same.append(model.decode(flat[offsets[-2] :]) == text)
                lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                out = [*batch.columns[: len(names)], pa.array(np.diff(offsets).astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([*out, pa.array(same, pa.bool_())] if check else out, [*names, "n_pieces", "pieces", *["round_trip"] * check])
        model.forget()  # the worker may serve other steps next

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*[F.col(f"`{n}`") for n in names]).schema)
    return slim.mapInArrow(run, f"{kinds}, n_pieces bigint, pieces array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, path: str, id_col: str = "id", pieces_col: str = "pieces") -> DataFrame:
    """id, text. Null piece lists give null texts."""
    ship(encoded.sparkSession)
    slim = encoded.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            text = [None if v is None else model.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text string")

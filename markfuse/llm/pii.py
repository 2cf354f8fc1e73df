"""Personal data: base patterns, and a skip-chain conditional random field over what resembles them.

Base spans come from four linear-time scanners (email, ip, card, phone). The field's nodes are the
mentions of a text, in order: every base span, every other numeric run of seven digits or more, and
every other token around an at sign. Node potentials weigh the mention's shape and the word before it,
chain potentials tie neighbours, and skip potentials tie each mention to the hub of its key (the same
last seven digits; the same letters and digits of an address), however far away. A key met n times costs
n links at most, not n**2 / 2. Base spans are observed, and so is the hub of a key that has any: it takes
their kinds (by share, should they differ), so each bare repeat meets that evidence at first hand, however
many repeats there are. The hub of a key without base spans is hidden. Loopy sum-product passing over all
links settles the other mentions, and those that reach a kind with probability `sure` become added spans.
Words that are no mention have no label but "other" by definition of the field, so they need
no node.

Training maximises the pseudo-likelihood on at most `sample` texts that have mentions, `longest` mentions
at most (those of lowest hash of id); inference covers all texts. The sample is labelled by the base patterns; mentions that share a key with a base span carry no label,
neither as examples nor as the other end of a link.

Defined cases: null counts as empty; whole texts are scanned whatever their length; repeated rows and
null ids are judged alike; without any mention in the table the field stays untrained and adds nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfuse.session import ship

from .common import scratch, stage

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}")
_NEXT = re.compile(r"[^\s@]*")
_WORD = re.compile(r"(\w+)\W*$")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each at sign, so long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            done = m.end()
            out.append((a, done))
            at = text.find("@", done)
        else:
            # a later start may not reach back over this sign: @ is no local character
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, 1, b) for a, b in ips(text)]
        out += [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


# ---------------------------------------------------------------- the field

FEATURES = 64


def _shape(piece: str, before: str) -> list[int]:
    digits = sum(c.isdigit() for c in piece)
    flags = ["@" in piece, piece[:1] == "+", "(" in piece, "-" in piece, " " in piece, piece.count(".") == 3, any(c.isalpha() for c in piece), "/" in piece]
    m = _WORD.search(before)
    cue = int(hashlib.md5(m.group(1).lower().encode()).hexdigest(), 16) % 24 if m else 24
    return [0, 1 + min(digits, 20), *(23 + i for i, x in enumerate(flags) if x), 32 + cue]


def _key(piece: str) -> str:
    if "@" in piece:
        letters = "".join(c for c in piece.lower() if c.isalnum())
        return "@" + (letters if len(letters) <= 64 else hashlib.sha256(letters.encode("utf-8", "surrogatepass")).hexdigest())
    return "".join(c for c in piece if "0" <= c <= "9")[-7:]


def tokens_at(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping runs without white space around one at sign; each sign is widened to both
    sides up to the run before, so every character is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and not text[a - 1].isspace():
            a -= 1
        done = _NEXT.match(text, at + 1).end()
        out.append((a, done))
        at = text.find("@", done)
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[int]]]:
    """(start, end, base kind or OTHER, key, features) of every mention by start."""
    found = {(a, b): k for a, k, b in spans}
    taken = sorted(found)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (b, -1))
        return i == 0 or all(taken[j][1] <= a for j in range(max(0, i - 4), i))

    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            if free(*m.span()):
                found.setdefault(m.span(), OTHER)
    if "@" in text:
        for a, b in tokens_at(text):
            if b - a > 2 and free(a, b):
                found.setdefault((a, b), OTHER)
    return [(a, b, k, _key(text[a:b]), _shape(text[a:b], text[max(0, a - 40) : a])) for (a, b), k in sorted(found.items())]


def hubs(kinds: list[int], keys: list[str]) -> list[tuple[list[int], np.ndarray]]:
    """(mentions, base spans by kind) of each key that two mentions or more share."""
    met: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if k:
            met.setdefault(k, []).append(i)
    return [(at, np.bincount([kinds[i] for i in at], minlength=LABELS)[:OTHER]) for at in met.values() if len(at) > 1]


def unary(theta: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    return np.array([theta[:, f].sum(1) for f in feats]).reshape(-1, LABELS)


def train(texts: list[tuple[list[int], list[str], list[list[int]]]], rounds: int = 150, rate: float = 0.5, penalty: float = 1e-3, agree: float = 8.0):
    """Pseudo-likelihood ascent. texts: (kinds, keys, features) of the mentions of each text. The skip
    potentials have a prior centred on agreement (`agree` for equal kinds), the others on zero."""
    theta, chain, prior = np.zeros((LABELS, FEATURES)), np.zeros((LABELS, LABELS)), agree * np.eye(LABELS)
    skip = prior.copy()
    rows, labels, side = [], [], []  # features; label; (which table, label of the other end, share) of each tie
    for kinds, keys, feats in texts:
        known = {k for k, kind in zip(keys, kinds, strict=True) if kind != OTHER}
        bare = [kind == OTHER and k in known for k, kind in zip(keys, kinds, strict=True)]
        ties: list[list[tuple[int, int, float]]] = [[] for _ in kinds]
        for i, j in zip(range(len(kinds) - 1), range(1, len(kinds)), strict=True):
            if not bare[j]:
                ties[i].append((0, kinds[j], 1.0))
            if not bare[i]:
                ties[j].append((0, kinds[i], 1.0))
        for at, base in hubs(kinds, keys):
            for i in at:
                if not base.any():
                    ties[i].append((1, OTHER, 1.0))
                elif kinds[i] != OTHER and base.sum() > 1:  # the hub as the key's other base spans make it
                    rest = base - (np.arange(OTHER) == kinds[i])
                    ties[i] += [(1, int(k), rest[k] / rest.sum()) for k in rest.nonzero()[0]]
        for i, kind in enumerate(kinds):
            if bare[i]:
                continue
            rows.append(feats[i])
            labels.append(kind)
            side.append(ties[i])
    n = len(rows)
    if not n:
        return theta, chain, skip
    x = np.zeros((n, FEATURES))
    near = np.zeros((2, n, LABELS))
    for i, f in enumerate(rows):
        x[i, f] = 1
        for table, other, share in side[i]:
            near[table, i, other] += share
    y = np.eye(LABELS)[labels]
    for _ in range(rounds):
        z = x @ theta.T + near[0] @ chain + near[1] @ skip
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        d = (y - p / p.sum(1, keepdims=True)) / n
        theta += rate * (d.T @ x - penalty * theta)
        chain += rate * (sym(near[0].T @ d) - penalty * chain)
        skip += rate * (sym(near[1].T @ d) - penalty * (skip - prior))
    return theta, chain, skip


def sym(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def marginals(node: np.ndarray, chain: np.ndarray, skip: np.ndarray, skips: list[tuple[int, int]], rounds: int | None = None, chained: int | None = None) -> np.ndarray:
    """Loopy sum-product over chain and skip links: label probabilities of each node. The first `chained`
    nodes (default: all) form the chain; the others are hubs. Messages are logarithms; passing ends once
    none moves by 1e-6, at the latest after `rounds` (default: 100 and four a node; half-damped news takes
    about two a link). A round works out again only what has not settled or has news at its source."""
    n = len(node)
    ends = [(i, i + 1, chain) for i in range((n if chained is None else chained) - 1)] + [(i, j, skip) for i, j in skips]
    node = node - node.max(1, keepdims=True)
    if not ends:
        return np.exp(node - _logsum(node))
    src = np.array([e for i, j, _ in ends for e in (i, j)])
    dst = np.array([e for i, j, _ in ends for e in (j, i)])
    pot = np.array([t for _, _, t in ends for _ in (0, 1)])
    back = np.arange(len(src)) ^ 1
    msg = np.full((len(src), LABELS), -np.log(LABELS))
    belief = node.copy()
    np.add.at(belief, dst, msg)
    live = np.arange(len(src))
    for _ in range(100 + 4 * n if rounds is None else rounds):
        out = belief[src[live]] - msg[back[live]]
        new = _logsum(out[:, :, None] + pot[live], 1)[:, 0]
        new -= _logsum(new)
        moves = np.abs(new - msg[live]).max(1) >= 1e-6
        if not moves.any():
            break
        live = live[moves]
        step = 0.5 * (new[moves] - msg[live])
        msg[live] += step
        np.add.at(belief, dst[live], step)
        news = np.zeros(n, bool)
        news[dst[live]] = True
        again = news[src]
        again[live] = True
        live = again.nonzero()[0]
    return np.exp(belief - _logsum(belief))


def _logsum(a: np.ndarray, axis: int = -1) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return top + np.log(np.exp(a - top).sum(axis, keepdims=True))


def settle(kinds: list[int], keys: list[str], feats: list[list[int]], model, sure: float) -> list[int]:
    """The label of each mention; base spans keep theirs."""
    theta, chain, skip = model
    node = unary(theta, feats)
    for i, k in enumerate(kinds):
        if k != OTHER:
            node[i] = -60.0
            node[i, k] = 0.0
    skips, hidden = [], 0
    for at, base in hubs(kinds, keys):
        if base.any():  # an observed hub sends the same whatever the repeats send to it
            bare = [i for i in at if kinds[i] == OTHER]
            node[bare] += base / base.sum() @ skip[:OTHER]
        else:
            skips += [(i, len(kinds) + hidden) for i in at]
            hidden += 1
    node = np.concatenate([node, np.zeros((hidden, LABELS))])
    p = marginals(node, chain, skip, skips, chained=len(kinds))[: len(kinds)]
    best = p[:, :OTHER].argmax(1)
    return [k if k != OTHER else int(b) if p[i, b] >= sure else OTHER for i, (k, b) in enumerate(zip(kinds, best, strict=True))]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_SCAN = "n array<bigint>, base string, starts array<bigint>, ends array<bigint>, kinds array<int>, keys array<string>, feats array<array<int>>"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what a row's mentions take as Python objects lives no longer than these."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out: dict[str, list] = {c: [] for c in ("n", "base", "starts", "ends", "kinds", "keys", "feats")}
        for value in batch.column(1):
            text = value.as_py()
            spans = base_spans(text)
            found = mentions(text, spans)
            out["n"].append([sum(k == kind for _, k, _ in spans) for kind in range(OTHER)])
            out["base"].append(_joined(spans))
            for c, i in (("starts", 0), ("ends", 1), ("kinds", 2), ("keys", 3), ("feats", 4)):
                out[c].append([m[i] for m in found])
        kinds = {"n": pa.list_(pa.int64()), "base": pa.string(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kinds": pa.list_(pa.int32()), "keys": pa.list_(pa.string()), "feats": pa.list_(pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], t) for c, t in kinds.items())], ["id", *kinds])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, sure: float = 0.9, longest: int = 1000) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans, as
    kind:start:end, code points), n_added, n_spans (base and added). Training takes `sample` texts of at most `longest` mentions, so
    that it fits the driver; longer texts are judged by what the others teach."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    scanned = stage(slim.mapInArrow(_scan, f"id {kind}, {_SCAN}"), "mentions")
    rows = scanned.where(F.size("kinds").between(1, longest)).select("kinds", "keys", "feats", F.xxhash64(F.col("id").cast("string")).alias("h"), "base")
    got = rows.orderBy("h", "base").limit(sample).select("kinds", "keys", "feats").toArrow().to_pylist()
    model = spark.sparkContext.broadcast(train([(r["kinds"], r["keys"], r["feats"]) for r in got]))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            spans, added = [], []
            for r in batch.select(["base", "starts", "ends", "kinds", "keys", "feats"]).to_pylist():
                if OTHER not in r["kinds"]:
                    spans.append(r["base"])
                    added.append(0)
                    continue
                labels = settle(r["kinds"], r["keys"], r["feats"], model.value, sure)
                more = [(a, k, b) for a, b, k, was in zip(r["starts"], r["ends"], labels, r["kinds"], strict=True) if was == OTHER and k != OTHER]
                had = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r["base"].split(",") if s)]
                spans.append(_joined(had + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["id", "n", "base", "spans", "n_added"])

    out = scanned.mapInArrow(infer, f"id {kind}, n array<bigint>, base string, spans string, n_added bigint")
    return out.select("id", *(F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", (F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x) + F.col("n_added")).alias("n_spans"))

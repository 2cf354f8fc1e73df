"""Language ID, personal data, tokens, pieces, fingerprints."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from markfuse.llm import langid, pieces, pii, simhash, tokens

from .conftest import odd_rows


def fuzz(n=600, seed=1):
    rng = random.Random(seed)
    parts = [*"aeioths  \n\t.,▁éüñ한글日本😀\x00\x85　", "  ", "ing", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "'s", "123"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 50))) for _ in range(n)]


# ---------------------------------------------------------------- tokens and pieces


def test_token_counts_match_the_library(spark, odd, none, path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [r[1] for r in odd_rows()] + fuzz()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in tokens.count_tokens(docs, path("byte_bpe_50k.json")).collect()}
    want = [len(e) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 1024) for i, t in enumerate(texts))
    assert tokens.count_tokens(odd, path("byte_bpe_50k.json")).count() == odd.count()
    assert tokens.count_tokens(none, path("byte_bpe_50k.json")).count() == 0


def test_long_run_stays_fast(path):
    c = tokens.counts(path("byte_bpe_50k.json"))
    assert c.count("ab" * 200_000) > 0


def test_pieces_match_the_library(spark, odd, none, path):
    import sentencepiece

    model = path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [r[1] for r in odd_rows()] + fuzz()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(docs, model, check=True, by="merges").cache()
    got = {r.id: r for r in coded.collect()}
    assert [got[i].pieces for i in range(len(texts))] == [lib.encode(t or "") for t in texts]
    assert all(r.round_trip == ((texts[i] or "").replace("▁", " ") == (texts[i] or "")) for i, r in got.items())
    back = {r.id: r.text for r in pieces.decode(coded, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    out = pieces.encode(odd, model, keep=("lang", "source"))
    assert out.columns == ["id", "lang", "source", "n_pieces", "pieces"] and out.count() == odd.count()
    assert pieces.encode(none, model).count() == 0


def unigram():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    m.normalizer_spec.name = "identity"
    rng = random.Random(4)
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        p = m.pieces.add()
        p.piece, p.type, p.score = name, kind, 0.0
    made = {"a", "b", "c", "▁"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(30)} | {"▁ab", "▁c"}
    for t in sorted(made):
        p = m.pieces.add()
        p.piece, p.score = t, -rng.random() * 10
    return m.SerializeToString()


def test_unigram_viterbi_matches_the_library():
    import sentencepiece

    data = unigram()
    lib, mine = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice("abc  z") for _ in range(rng.randrange(0, 25)))
        assert np.frombuffer(mine.encode(t), np.int32).tolist() == lib.encode(t), t


def best_brute(model, word):
    """Best sum of scores over all ways to cut a word, by trying each last piece (memoised, no automaton)."""
    number = {bytes(r).decode("utf-8", "replace").replace(" ", pieces.MARK): i for i, r in enumerate(model.raw) if i not in model.bytes.values() and len(r) and i != model.unknown}
    best = [0.0]
    for i in range(1, len(word) + 1):
        ends = [best[j] + model.score[number[word[j:i]]] for j in range(max(0, i - 20), i) if word[j:i] in number]
        if word[i - 1] not in number:
            ends.append(best[i - 1] + model.unknown_score)
        best.append(max(ends))
    return best[-1]


def test_pieces_of_best_score(spark, odd, none, path):
    file = path("piece_bpe_32k.model")
    model = pieces.Pieces(open(file, "rb").read())
    texts = [r[1] or "" for r in odd_rows()][:80] + fuzz(200, 5) + ["unbelievably internationalisation", "  tabs\there ", "a" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in pieces.encode(docs, file, check=True).collect()}
    odd_ids = set(model.bytes.values())
    for i, text in enumerate(texts):
        assert got[i].round_trip == (text.replace("▁", " ") == text)
        if not text:
            assert got[i].n_pieces == 0
            continue
        ids, total, k = got[i].pieces, 0.0, 0
        while k < len(ids):
            if ids[k] in odd_ids:  # the bytes of one character
                n = 1
                while (model.raw[ids[k]][0] >= 0xC0) and k + n < len(ids) and ids[k + n] in odd_ids and model.raw[ids[k + n]][0] & 0xC0 == 0x80:
                    n += 1
                total, k = total + model.unknown_score, k + n
            else:
                total, k = total + model.score[ids[k]], k + 1
        assert math.isclose(total, best_brute(model, (" " + text).replace(" ", pieces.MARK)), rel_tol=1e-9), text
    assert pieces.encode(odd, file).count() == odd.count() and pieces.encode(none, file).count() == 0
    assert pieces.decode(pieces.encode(none, file), file).count() == 0


# ---------------------------------------------------------------- language ID


def speak(rng, lang, n):
    letters = {"en": "etaoinsh", "de": "enisratäü", "fr": "esaitnéèç"}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_language_accuracy_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(i, speak(rng, lang, rng.randrange(5, 60)), lang) for i in range(900) for lang in [rng.choice(["en", "de", "fr"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.col("doc_id") % 3 != 1, sample=300)
    assert model.codes.shape == (3, 3)
    got = {r.id: r for r in langid.predict(docs, model).collect()}
    held = [i for i, *_ in rows if i % 3 == 1]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    # nothing but the text decides
    other = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 1)
    assert {r.id - 1: r.lang_pred for r in langid.predict(other, model).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_language_odd_cases(odd, none, spark):
    model = langid.learn(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(odd_rows()) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.id in (103, 104, 105))
    assert langid.predict(none, model).count() == 0
    empty = langid.learn(none)
    assert empty.langs == [] and {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    single = langid.learn(odd.where("lang = 'de'"))
    assert {r.lang_pred for r in langid.predict(odd, single).collect()} == {"de", "und"}


@pytest.mark.parametrize("n", [2, 3, 5, 9, 20])
def test_codewords_keep_their_distance(n):
    c = langid.codebook(n)
    far = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
    assert far >= max(1, c.shape[1] // 4)
    m = langid.Model([str(i) for i in range(n)], c, np.zeros((1, 1)), np.ones(c.shape[1]))
    flipped = c.copy()
    flipped[:, 0] *= -1 if far > 2 else 1
    assert (langid.decode(flipped * 4.0, m)[0] == np.arange(n)).all()


def test_near_codewords_are_flagged():
    c = langid.codebook(3)
    m = langid.Model(["a", "b", "c"], c, np.zeros((1, 1)), np.ones(3))
    at, score, margin = langid.decode(np.array([[0.0, 0.0, 0.0], [5.0, 5.0, 5.0]]), m)
    assert margin[0] < 0.05 < margin[1]


# ---------------------------------------------------------------- personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    parts = [*"0123456789" * 2, *".@ -+()%_a", "a.b@c-d.org", "+49 30 1234567", "4111 1111 1111 1111", "10.0.0.255", "٣", "é"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(t) == base_brute(t), t


def test_tokens_around_signs_match_the_pattern():
    rng = random.Random(13)
    for _ in range(3000):
        t = "".join(rng.choice([*"ab.@@ \n\x1c é", "x@y"]) for _ in range(rng.randrange(0, 30)))
        assert pii.tokens_at(t) == [m.span() for m in re.finditer(r"[^\s@]*@[^\s@]*", t)], t


@pytest.mark.parametrize("long", ["a" * 5_000_000, "a" * 5_000_000 + " b@", "b@ " + "1" * 2_000_000, "x@" * 500_000, "+1 " * 500_000, "1.1 " * 500_000])
def test_long_tokens_take_linear_time(long):
    began = time.perf_counter()
    text = "write to a.b@c.org or " + long + " @ end"
    pii.mentions(text, pii.base_spans(text))
    assert time.perf_counter() - began < 15


def exact_marginals(node, ties):
    """By enumeration of all labellings; ties: (i, j, potential)."""
    n = len(node)
    grid = np.indices((pii.LABELS,) * n).reshape(n, -1)
    w = sum(node[i][grid[i]] for i in range(n)) + sum(t[grid[i], grid[j]] for i, j, t in ties)
    w = np.exp(w - w.max())
    p = np.stack([np.bincount(grid[i], w, pii.LABELS) for i in range(n)])
    return p / p.sum(1, keepdims=True)


def test_skip_links_match_enumeration():
    """Hubs over a chain: exact where the graph is a tree; on loops within a tolerance, and never another
    label where enumeration is sure of one."""
    rng = np.random.default_rng(21)
    for _ in range(40):
        node, chain, skip = rng.normal(size=(6, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), pii.sym(rng.normal(size=(pii.LABELS, pii.LABELS)))
        skips = [(0, 5), (2, 5), (4, 5)]
        tree = exact_marginals(node, [(i, j, skip) for i, j in skips])
        assert np.allclose(pii.marginals(node, chain, skip, skips, chained=5), tree, atol=1e-3)
        chain = pii.sym(rng.normal(size=(pii.LABELS, pii.LABELS))) * 0.5
        loops = exact_marginals(node, [(i, j, skip) for i, j in skips] + [(i, i + 1, chain) for i in range(4)])
        got = pii.marginals(node, chain, skip, skips, chained=5)
        assert np.abs(got - loops).mean() < 0.05
        sure = loops.max(1) > 0.9
        assert (got.argmax(1) == loops.argmax(1))[sure].all()


def test_added_spans_match_enumeration():
    """settle() against enumeration of the field with all its nodes, observed hubs included."""
    rng = np.random.default_rng(22)
    same = 0
    for _ in range(60):
        keys = [str(k) for k in rng.integers(0, 3, 5)]
        kinds = [int(k) if k < pii.OTHER else pii.OTHER for k in rng.integers(0, 9, 5)]
        feats = [[int(f)] for f in rng.integers(0, pii.FEATURES, 5)]
        theta, chain, skip = rng.normal(size=(pii.LABELS, pii.FEATURES)), 0.3 * pii.sym(rng.normal(size=(pii.LABELS, pii.LABELS))), 4.0 * np.eye(pii.LABELS)
        node, ties = pii.unary(theta, feats), [(i, i + 1, chain) for i in range(4)]
        for i, k in enumerate(kinds):
            if k != pii.OTHER:
                node[i] = np.where(np.arange(pii.LABELS) == k, 0.0, -60.0)
        for at, base in pii.hubs(kinds, keys):
            if base.any():
                for i in at:
                    if kinds[i] == pii.OTHER:
                        node[i] = node[i] + base / base.sum() @ skip[: pii.OTHER]
            else:
                node = np.concatenate([node, np.zeros((1, pii.LABELS))])
                ties += [(i, len(node) - 1, skip) for i in at]
        p = exact_marginals(node, ties)[:5]
        want = [k if k != pii.OTHER else int(p[i, :4].argmax()) if p[i, :4].max() >= 0.9 else pii.OTHER for i, k in enumerate(kinds)]
        got = pii.settle(kinds, keys, feats, (theta, chain, skip), 0.9)
        near = [k == pii.OTHER and abs(p[i, :4].max() - 0.9) < 0.1 for i, k in enumerate(kinds)]
        assert all(g == w or n for g, w, n in zip(got, want, near, strict=True))
        same += got == want
    assert same > 50


def spans_of(s):
    return [tuple(x.split(":")) for x in s.split(",") if x]


def test_personal_data_odd_cases(odd, none):
    rows = {r.id: r for r in pii.find(odd).collect() if r.id is not None}
    for i, t, *_ in odd_rows():
        if i is None:
            continue
        base = base_brute(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in base) for k in range(4)]
        assert set(spans_of(text)) <= set(spans_of(rows[i].spans))
    assert pii.find(odd).count() == len(odd_rows()) and pii.find(none).count() == 0


def test_repeated_mentions_take_the_same_label(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = "".join(rng.choice("0123456789") for _ in range(9))
        rows.append((i, f"call +49 {n} now. " + "word " * 200 + f"again {n[:3]}-{n[3:]} there. order {rng.randrange(10**7, 10**8)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(docs).collect()
    assert sum(r.n_added for r in got) > 0.9 * len(rows)
    for r in got:
        text = rows[r.id][1]
        for kind, a, b in spans_of(r.spans):
            assert kind == "phone" and "order" not in text[max(0, int(a) - 8) : int(a)]


@pytest.mark.parametrize("bias", [0.0, 2.0, 4.0])
@pytest.mark.parametrize("n", [5, 20, 100])
def test_many_bare_repeats_take_the_kind_of_one_base_span(n, bias):
    theta = np.zeros((pii.LABELS, pii.FEATURES))
    theta[pii.OTHER, 0] = bias
    model = theta, np.zeros((pii.LABELS, pii.LABELS)), 8.0 * np.eye(pii.LABELS)
    for base_at in (0, n // 2, n):
        kinds = [pii.OTHER] * (n + 1)
        kinds[base_at] = 3
        assert pii.settle(kinds, ["1234567"] * (n + 1), [[0]] * (n + 1), model, 0.9) == [3] * (n + 1)


def test_many_bare_repeats_are_found(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        n = "".join(rng.choice("0123456789") for _ in range(9))
        bare = (5, 20, 100)[i % 3]
        rows.append((i, f"call +49 {n} now. " + "".join(f"again {n[:3]}-{n[3:]} there. order {rng.randrange(10**7, 10**8)} " for _ in range(bare))))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_added == (5, 20, 100)[r.id % 3] for r in got)
    assert all(r.n_spans == len(spans_of(r.spans)) for r in got)
    assert all(rows[r.id][1][:int(a)].endswith(("again ", "call ")) for r in got for _, a, _ in spans_of(r.spans))


def test_marginals_match_enumeration_on_a_tree():
    from itertools import product

    rng = np.random.default_rng(2)
    node, chain = rng.normal(size=(3, pii.LABELS)), pii.sym(rng.normal(size=(pii.LABELS, pii.LABELS)))
    p = np.zeros((3, pii.LABELS))
    for y in product(range(pii.LABELS), repeat=3):
        w = np.exp(sum(node[i, y[i]] for i in range(3)) + chain[y[0], y[1]] + chain[y[1], y[2]])
        for i in range(3):
            p[i, y[i]] += w
    p /= p.sum(1, keepdims=True)
    assert np.allclose(pii.marginals(node, chain, chain, [], 60), p, atol=1e-3)


def test_training_leaves_out_texts_beyond_longest(spark, monkeypatch):
    seen = []
    learn = pii.train
    monkeypatch.setattr(pii, "train", lambda texts: seen.append(sorted(len(k) for k, _, _ in texts)) or learn(texts))
    docs = spark.createDataFrame([(i, "call +49 30 123 456 78 now. " * n) for i, n in enumerate((1, 3, 4))], "doc_id long, text string")
    assert [pii.find(docs, longest=m).count() for m in (3, 4)] == [3, 3] and seen == [[1, 3], [1, 3, 4]]


def test_evidence_passes_along_the_whole_chain():
    n, chain = 500, 8.0 * np.eye(pii.LABELS)
    node = np.zeros((n, pii.LABELS))
    node[0] = [-60, -60, -60, 0, -60]
    ahead, behind = np.zeros((n, pii.LABELS)), np.zeros((n, pii.LABELS))  # exact: forward and backward sums
    for i in range(1, n):
        ahead[i] = np.log(np.exp(ahead[i - 1] + node[i - 1]) @ np.exp(chain))
        ahead[i] -= ahead[i].max()
        behind[n - 1 - i] = np.log(np.exp(behind[n - i] + node[n - i]) @ np.exp(chain))
        behind[n - 1 - i] -= behind[n - 1 - i].max()
    p = np.exp(node + ahead + behind)
    p /= p.sum(1, keepdims=True)
    assert np.allclose(pii.marginals(node, chain, chain, []), p, atol=1e-3) and p[40, 3] > 0.9


# ---------------------------------------------------------------- fingerprints


def order(row):
    return -(2**63) if row[0] is None else row[0]


def test_edits(odd, none):
    rows = [(i, t or "") for i, t, *_ in odd_rows()]
    got = simhash.edits(odd).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=order, reverse=True)
    after = {}
    for k, r in enumerate(ordered):
        after.setdefault(r[0], []).append((r[1], ordered[(k + 1) % len(ordered)][1]))
    prints = {}
    for r in got:
        if r.id is None or len(after[r.id]) > 1:
            continue  # rows with equal ids: their order among themselves is the operator's
        text, following = after[r.id][0]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        if len(after.get(next((i for i, t in ordered if t == following), None), [])) == 1:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert simhash.edits(none).count() == 0
    plan = simhash.edits(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def print_brute(text):
    """Votes of the word pairs' hashes, in plain Python over the xxhash library."""
    import xxhash

    step = lambda data, seed: xxhash.xxh64(data, seed=seed).intdigest()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    votes = [0] * 128
    for i, w in enumerate(words):
        h = step(w.encode(), 42)
        if i + 1 < len(words):
            h = step(words[i + 1].encode(), h)
        weight = 1 if len(w) < 4 else 2 if len(w) < 8 else 3
        h = h & ~3 & (2**64 - 1) | weight
        first = step(h.to_bytes(8, "little"), 42)
        for half in (0, 1):
            bits = xxhash.xxh64((half + 1).to_bytes(4, "little"), seed=first).intdigest()
            for b in range(64):
                votes[half * 64 + b] += weight if bits >> b & 1 else -weight
    return "".join(f"{sum(1 << b for b in range(64) if votes[half * 64 + b] > 0):016x}" for half in (0, 1))


def alike(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


@pytest.mark.parametrize("scale", [3, 2**53 // 40])
def test_edits_match_brute_force(spark, scale):
    """All columns, for small and for hash-like ids beyond 2**53."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 10)))
    rows = [(i * scale + i % 7, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(600)]
    got = {r.id: r for r in simhash.edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    ordered = sorted(rows, reverse=True)
    prints = {i: print_brute(t) for i, t in rows}
    for k, (i, text) in enumerate(ordered):
        j, following = ordered[(k + 1) % len(ordered)]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        want = print_brute(edited)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i], want)
        assert r.near_edited == alike(prints[i], want) and r.near_next == alike(prints[i], prints[j])


def test_edits_of_rows_without_id_fall_into_many_buckets(spark):
    rows = [(None, f"text {i}") for i in range(2000)] + [(5, f"five {i}") for i in range(2000)] + [(i, f"id {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = simhash.with_next(docs).collect()
    real = [r for r in placed if not r.ghost]
    assert sorted((repr(r.id), r.text) for r in real) == sorted((repr(i), t) for i, t in rows)
    assert max(Counter(r.bucket for r in placed).values()) < 600
    # each text is the next of exactly one other
    assert Counter(r.next_text for r in real) == Counter(t for _, t in rows)


def test_edits_over_many_buckets(spark):
    rng = random.Random(7)
    rows = [(i * 3 - 500, "".join(rng.choice("abc é") for _ in range(rng.randrange(30)))) for i in range(700)]
    got = {r.id: r for r in simhash.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        third = len(text) // 3
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()


def test_fingerprint_matches_bit_votes(spark):
    """The packed counters against plain votes on the same term hashes."""
    texts = [" ".join(random.Random(s).choice(["a", "bcde", "fghijklm", "x"]) for _ in range(n)) for s, n in ((1, 1), (2, 50), (3, 9000), (4, 40000))] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.f0 & (2**64 - 1), r.f1 & (2**64 - 1)) for r in simhash.fingerprint(docs, ["i"]).collect()}
    terms = docs.select("i", F.explode(simhash.terms(F.col("text"))).alias("t")).groupBy("i", "t").count().select("i", "t", "count", F.xxhash64("t", F.lit(1)).alias("a"), F.xxhash64("t", F.lit(2)).alias("b")).collect()
    for i in range(len(texts)):
        votes = np.zeros((2, 64), int)
        for r in terms:
            if r.i == i:
                w = (r.t & 3) * r["count"]
                for k, h in enumerate((r.a, r.b)):
                    votes[k] += np.array([w if h >> b & 1 else -w for b in range(64)])
        assert got[i] == tuple(sum(1 << b for b in range(64) if votes[k, b] > 0) for k in (0, 1)), i


def test_hamming_search_finds_all(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(128) for _ in range(60)]
    prints = base + [x ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 6))) for x in base for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (2**64 - 1))) for x in prints]
    index = spark.createDataFrame(rows, "f0 long, f1 long")
    got = {(r.q0, r.q1, r.f0, r.f1) for r in simhash.hamming_search(index, index, 3).collect()}
    want = {(*rows[a], *rows[b]) for a in range(len(prints)) for b in range(len(prints)) if 0 < (prints[a] ^ prints[b]).bit_count() <= 3}
    assert got == want
    assert simhash.hamming_search(index.limit(0), index).count() == 0


def test_op3_searches_every_twentieth_document(spark, tmp_path):
    from markfuse.llm import queries

    rng = random.Random(12)
    words = lambda n: [rng.choice(["alpha", "beta", "gamma", "of", "x", "longer words", "niño"]) for _ in range(n)]
    base = [words(rng.randrange(60, 900)) for _ in range(20)]
    texts = [" ".join(b[:k] + b[k + 1 :]) for b in base for k in (0, 0, 5, 20, 30)] + [None, "", " "] + ["same text here"] * 5
    rows = [(i * 5, t) for i, t in enumerate(texts)] + [(None, texts[0]), (20, texts[1]), (1000, "nothing else is like this one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3(spark, str(tmp_path))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = out.collect()
    prints = [int(r.fingerprint, 16) for r in got]
    near = lambda x: sum((x ^ y).bit_count() <= 3 for y in prints) - 1
    assert len(got) == len(rows)
    assert [r.n_near for r in got] == [near(x) if r.doc_id is not None and r.doc_id % 20 == 0 else None for x, r in zip(prints, got, strict=True)]
    assert any(r.n_near for r in got) and any(r.n_near == 0 for r in got)
    apart = {(x ^ y).bit_count() for x, r in zip(prints, got, strict=True) if r.n_near is not None for y in prints}
    assert apart & {1, 2, 3}

"""Exact, substring and near dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from markfuse.llm import exact, graph, minhash, substring

from .conftest import CLASH, SCHEMA, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def order(i):
    return (i is None, i or 0)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), order(i), i))
    out = []
    for norm, g in groups.items():
        best = min(g)[2]
        out += [(i, best, len(g), i == best, sha(norm)) for _, _, i in g]
    return sorted(out, key=repr)


@pytest.mark.parametrize("track", [8, 4096])
def test_exact(odd, track):
    got = exact.judge(odd, track=track).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got], key=repr) == exact_brute(odd_rows())


def test_exact_heavy_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id div 2) END AS text")
    rows = [tuple(r) for r in docs.collect()]
    got = exact.judge(docs, track=16).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got], key=repr) == exact_brute(rows)
    assert exact.heavy_digests(exact.digests(docs), 16).count() == 1


def test_exact_drop(odd, none):
    left = exact.drop_copies(odd)
    assert left.columns == odd.columns
    kept = {(i, t) for i, k, _, good, t in exact_brute(odd_rows()) if good}
    assert {(r.doc_id, sha(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""))) for r in left.collect()} == kept
    assert left.count() == len(kept)
    assert exact.judge(none).count() == 0 and exact.drop_copies(none).count() == 0


def test_exact_plan_is_native(odd):
    plan = exact.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def substring_brute(rows, size):
    starts = defaultdict(lambda: (True, 2**70))
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in docs:
        for k in range(len(w) - size + 1):
            starts[tuple(w[k : k + size])] = min(starts[tuple(w[k : k + size])], order(i))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - size + 1):
            if starts[tuple(w[k : k + size])] < order(i):
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [4, 7, 50])
def test_substring(odd, none, size):
    got = substring.remove_repeats(odd, size).collect()
    assert sorted([tuple(r) for r in got], key=repr) == substring_brute(odd_rows(), size)
    assert substring.remove_repeats(none, size).count() == 0


def test_substring_random(spark):
    rng = random.Random(2)
    for vocabulary in (2, 4, 60):
        rows = [(rng.randrange(80), " ".join(str(rng.randrange(vocabulary)) for _ in range(rng.randrange(40)))) for _ in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = substring.remove_repeats(docs, 6, with_text=True).collect()
        assert sorted([tuple(r)[:4] for r in got], key=repr) == substring_brute(rows, 6)
        assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


def shingles(text, size=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_brute(rows, percent):
    nodes = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            nodes[i].append(shingles(t))
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    flat = [(i, s) for i, ss in nodes.items() for s in ss if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted([(i, len(shingles(t)), None if i is None else root(i), i is None or root(i) == i) for i, t, *_ in rows], key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_near(odd, none, percent):
    rows = [r for r in odd_rows()]
    got = minhash.near_duplicates(odd, percent).collect()
    assert sorted([tuple(r) for r in got], key=repr) == near_brute(rows, percent)
    assert minhash.near_duplicates(none).count() == 0


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_cancel_in_polynomial_hashes_differ(spark, n):
    """Thue-Morse words agree in every polynomial hash modulo 2**64."""
    x, y = thue_morse(n), thue_morse(n, True)
    tail = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{x} {tail}"), (2**63 - 1, f"{y} {tail}"), (3, x), (4, y), (None, f"{x} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (50, 61):
        assert sorted([tuple(r) for r in substring.remove_repeats(docs, size).collect()], key=repr) == substring_brute(rows, size)
    assert sorted([tuple(r) for r in minhash.near_duplicates(docs, 99).collect()], key=repr) == near_brute(rows, 99)


def test_substring_rows_without_id(spark):
    """Null ids are larger than all others and no row's words go because of another row without id."""
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (None, text), (None, "x " + text), (None, "alone " * 9), (7, "y " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in substring.remove_repeats(docs, 6).collect()], key=repr) == substring_brute(rows, 6)
    rows = [r for r in rows if r[0] is None]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert all(r.n_removed == 0 for r in got)


def test_hot_bucket_pairs_strangers_only(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(1, i, 9, 0, 0) for i in range(200)] + [(1, 1000 + i, 9, 0, 1000 + i) for i in range(3)]
    named = spark.createDataFrame(rows, "key long, rep long, n long, c long, label long")
    got = minhash.blocked(named).collect()
    met = defaultdict(set)
    for r in got:
        met[r.i, r.j].add(r.rep)
    pairs = {frozenset((a, b)) for reps in met.values() for a in reps for b in reps if a != b}
    stranger = [1000, 1001, 1002]
    assert all(frozenset((s, x)) in pairs for s in stranger for x in [*range(1, 200), *stranger] if x != s)
    assert len(got) < 200 + 3 * 60  # each of the many once for the block of strangers


def test_hot_keys_are_split(spark):
    """Joins of the staged tables: adaptive execution splits the frequent key of each."""
    from markfuse.llm.common import scratch, stage

    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        with scratch(spark):
            rows = stage(spark.range(0, 60000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5000 END AS h", "struct(id, id * 7 AS k) AS row"), "rows")
            again = stage(substring.across(rows, "h").select("h"), "again")
            out = rows.join(again, "h", "left_semi")
            out.write.format("noop").mode("overwrite").save()
            joined = out.groupBy().count()
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_staged_files_go(spark, odd):
    from markfuse.llm import common

    before = len(common._written)
    minhash.near_duplicates(odd).count()
    assert len(common._written) == before + 1


def test_no_local_staging_on_a_cluster():
    from types import SimpleNamespace

    from markfuse.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def chained(seed, n=220):
    """Texts that differ by steps, so that links chain, stars overlap and pairs lie near the threshold."""
    rng = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if i % 20 == 0:
            base = [str(rng.randrange(10**6)) for _ in range(rng.choice([8, 40, 120]))]
        else:
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = str(rng.randrange(10**6))
        rows.append((rng.randrange(10**9), " ".join(base)))
    return rows


def test_near_chains(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)  # many blocks a bucket
    rows = chained(4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted([tuple(r) for r in got], key=repr) == near_brute(rows, 85)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3), (7, None)]
    up = list(range(2000))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    linked = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_circulant_signature_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 4000, 8000]), 180)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15


def test_names_do_not_clash():
    assert set(CLASH) & set(SCHEMA.replace(",", "").split()) == set()
    assert F.col("a") is not None

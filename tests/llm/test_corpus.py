"""Mixing, URL filters, the registered queries and the pipeline."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from markfuse.llm import langid, mixing, queries, urls
from markfuse.plans.views import TABLES

from ..test_queries import rows as plain
from .conftest import SCHEMA, odd_rows
from .test_dedup import exact_brute, near_brute

# ---------------------------------------------------------------- mixing


def entropy(x):
    s = sum(x)
    return -sum(v / s * math.log(v / s) for v in x if v)


def sources(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 9))), name) for name, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")


def test_mixture_meets_its_entropy(spark):
    docs = sources(spark, {"a": 2000, "b": 300, "c": 200, "d": 40})
    got = mixing.judge(docs, evenness=0.5, max_repeats=None).collect()
    natural, mixed = Counter(), Counter()
    for r in got:
        natural[r.source] += r.tokens
        mixed[r.source] += r.tokens * r.repeats
    target = entropy(natural.values()) + 0.5 * (math.log(4) - entropy(natural.values()))
    assert abs(entropy(mixed.values()) - target) < 0.01
    for r in got:
        assert 0 <= r.goal - mixed[r.source] < 9  # less than a document short
    passes = {s: {r.repeats for r in got if r.source == s} for s in natural}
    assert all(max(p) - min(p) <= 1 for p in passes.values())


def test_repetition_limit(spark):
    docs = sources(spark, {"a": 2000, "b": 300, "d": 5})
    got = mixing.judge(docs, evenness=1.0, max_repeats=3).collect()
    assert max(r.repeats for r in got) <= 3 and max(r.repeats for r in got if r.source == "d") == 3
    goal, t = {r.source: r.goal for r in got}, Counter()
    for r in got:
        t[r.source] += r.tokens
    assert abs(goal["d"] / t["d"] - 3) < 0.2


def test_budget_and_tokens(spark):
    docs = sources(spark, {"a": 500, "b": 100}).withColumn("k", F.lit(7))
    got = mixing.judge(docs, budget=700, tokens=F.col("k")).collect()
    assert {r.tokens for r in got} == {7} and 650 <= sum(r.tokens * r.repeats for r in got) <= 700


def test_mix_repeats_rows(spark):
    docs = sources(spark, {"a": 400, "b": 30})
    want = {(r.id, r.source): r.repeats for r in mixing.judge(docs).collect()}
    got = Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_mix_odd_cases(odd, none, spark):
    got = mixing.judge(odd).collect()
    assert len(got) == len(odd_rows()) and all(r.repeats >= 0 for r in got)
    assert mixing.judge(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns
    one = mixing.judge(odd.where("source = 'a'")).collect()
    assert {r.weight for r in one} == {1.0} and all(r.repeats == 1 for r in one if r.tokens)
    empty = spark.createDataFrame([(1, None, "a", None, 0), (2, "", None, None, 0)], SCHEMA)
    assert [r.repeats for r in mixing.judge(empty).collect()] == [1, 1]


# ---------------------------------------------------------------- URLs


def url_brute(pages, redirects=()):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
        return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:end]

    def rule(u):
        host, path = parts(u)
        fit = [(len(r), v, r) for v, r in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fit)[1:] if fit else (None, None)

    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    bare = lambda u: u.split("#")[0]
    for a, b in redirects:
        if a and b and "://" in a and "://" in b:
            up[root(bare(a))] = root(bare(b))
    verdicts = {}
    for x in list(up):
        verdicts.setdefault(root(x), set()).add(rule(x)[0])
    out = []
    for i, u in pages:
        v, r = rule(u)
        if v is None:
            seen = verdicts.get(root(bare(u)), set()) if u and "://" in u else set()
            v = "block" if "block" in seen and "allow" not in seen else "allow"
        out.append((i, *parts(u), r, v))
    return sorted(out, key=repr)


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["x.net", "Example.NET", "a.example.com", "b.org", "net", "plain.io", "notnet", "xexample.com"]
    make = lambda: rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(["", "/", "/en/a", "/de/b?x=/fr/", "/fr/c#t", "?q", "#f"])
    pages = [(i, make()) for i in range(400)] + [(500, None), (501, "no scheme"), (502, ""), (503, "a://b://c/d"), (3, make())]
    links = [(rng.choice(pages)[1], rng.choice(pages)[1]) for _ in range(25)] + [(f"http://plain.io/{i}", f"http://plain.io/{i + 1}") for i in range(40)] + [("http://plain.io/20", "http://x.net/"), (None, "http://x.net/")]
    pages += [(600 + i, f"http://plain.io/{i}") for i in range(41)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.judge(df, redirects=spark.createDataFrame(links, "src string, dst string"), html_col=None).collect()
    assert sorted([(r.id, r.host, r.path, r.rule, r.verdict) for r in got], key=repr) == url_brute(pages, links)
    assert {r.verdict for r in got if r.id and r.id >= 600} == {"block"}


def test_urls_from_html(spark):
    html = '<link href="/c" rel="x"><link rel="canonical" href="http://b.net/x">'
    pages = [(1, "http://a.io/p", html), (2, "http://a.io/q", '<meta http-equiv="refresh" content="0; url=http://a.io/p">'), (3, "http://a.io/r", None), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "page_id AS id", "url AS host", "url AS node")
    assert {r.id: r.verdict for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "allow", None: "allow"}
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_match_sql(spark, tmp_path):
    """Relative targets, hosts in mixed case, several links a page and a hot component."""
    rng = random.Random(3)
    hosts = ["A.io", "a.io", "b.IO", "x.net", "Deep.Example.NET", "c.org", "d.example.com"]
    paths = ["", "/", "/p/q", "/en/a", "/de/b", "/fr/c", "/p/?x=1", "/p#top"]
    to = ["../x", "/hub", "other?y=2", "?z=3", "#here", "//A.io/hub", "HTTP://B.io/p/q", "http://x.NET/", "http://c.org/fr/c", "http://a.IO/p/q#s", "a&amp;b"]
    link = lambda x: rng.choice([f'<link rel="canonical" href="{x}">', f"<LINK href='{x}' rel='alternate canonical'/>", f"<link rel=canonical href={x}>", f'<meta http-equiv="Refresh" content="0; URL={x}">', f'<link rel="icon" href="{x}">'])
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "<p>" + "".join(link(rng.choice(to)) for _ in range(rng.randrange(3))) + "</p>") for i in range(60)]
    rows += [(1000 + i, f"http://hot.io/{i}", '<link rel="canonical" href="/hub">') for i in range(300)] + [(2000, "http://hot.io/hub", '<link rel="canonical" href="http://only.NET/"/>')]
    rows += [(3000, None, "<link rel=canonical href=/x>"), (3001, "no scheme", "canonical"), (3002, "http://a.io/p/q", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = queries.op7(spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE["op7_url_filter"]).df()
    assert plain(got) == plain(want)
    assert got.propagated.sum() > 290 and set(got.verdict[got.page_id.between(1000, 1299)]) == {"block"}


# ---------------------------------------------------------------- registered queries and pipeline


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_one_row_a_document(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op1(spark, sf).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right > 0.9 * n


def test_many_languages_have_a_defined_model(spark):
    rows = [(i, f"text of tongue {i % 40} here", f"l{i % 40:02}") for i in range(200)] + [(900 + i, f"more words {i}", "l39") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, sample=8)
    assert model.langs == ["l00", "l01", "l02", "l03", "l04", "l05", "l06", "l39"]
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} <= set(model.langs)
    alike = spark.createDataFrame([(None, "same text", "en")] * 500 + [(1, "other text", "de")], "doc_id long, text string, lang string")
    assert langid.learn(alike, sample=10).langs == ["de", "en"]


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language", "exact", "near", "mix", "pieces"]
    docs = spark.createDataFrame([r for r in odd_rows() if r[0] is not None], SCHEMA)
    step = dict(p.STAGES)
    columns = docs.columns

    def run(name, df):
        out = step[name](spark, df, sf)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = lambda df: [tuple(r) for r in df.collect()]
    a = run("language", docs)
    assert a.columns == columns
    good = {r.id for r in langid.predict(docs, langid.learn(docs)).collect() if r.lang_pred != "und" and not r.ambiguous}
    assert Counter(r[0] for r in rows(a)) == Counter(r[0] for r in rows(docs) if r[0] in good) and a.count() > 50
    assert all(any(c.isalpha() for c in r[1]) for r in rows(a))
    assert all(r.lang for r in a.collect())
    b = run("exact", a)
    assert b.columns == columns and {r[0] for r in rows(b)} == {k[0] for k in exact_brute(rows(a)) if k[3]}
    c = run("near", b)
    assert c.columns == columns and sorted(r[0] for r in rows(c)) == sorted(k[0] for k in near_brute(rows(b), 80) if k[3])
    d = run("mix", c)
    assert d.columns == columns
    want = Counter({r.id: r.repeats for r in mixing.judge(c).collect() if r.repeats})
    assert Counter(r[0] for r in rows(d)) == want
    e = run("pieces", d)
    assert e.count() == d.count() and e.where("NOT round_trip").count() == 0
    empty = docs.limit(0)
    for name, f in p.STAGES:
        assert f(spark, empty, sf).count() == 0, name


def test_pipeline_runs(spark, sf):
    import corpus_pipeline as p

    out = p.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "n_pieces", "pieces", "round_trip"} <= set(out.columns)

"""Golden cases of the Markdown operators, one a rule."""

import random

import pytest
from pyspark.sql import functions as F

from markfuse.functions import text as tx
from markfuse.operators import align, alt, assess, cells, fuse, gaps, normalize, ocr, postprocess, profile, score
from markfuse.sources import adapters, readers, registry, sinks


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def many(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


# ---------------------------------------------------------------- text


def test_line_models(spark):
    texts = ["a\n", "", "a\nb", "a\x0bb c\r\n"]
    assert many(spark, tx.lines_split, texts) == [["a", ""], [""], ["a", "b"], ["a\x0bb c\r", ""]]
    assert many(spark, tx.lines_read, texts) == [["a"], [], ["a", "b"], ["a\x0bb c\r"]]
    assert many(spark, tx.lines_broken, texts) == [t.splitlines() for t in texts]


def test_strip_and_tokens_as_unicode(spark):
    texts = ["　 a b \x1c", "", "  ", "é ü"]
    assert many(spark, tx.strip, texts) == [t.strip() for t in texts]
    assert many(spark, tx.tokens, texts) == [t.split() for t in texts]
    assert many(spark, tx.token_key, ["(한글)", "<u>A</u>,", "word⟨0.41⟩", "--"]) == ["한글", "a", "word", ""]


def test_universal_newlines(spark):
    assert many(spark, tx.universal, ["a\r\nb\rc\n"]) == ["a\nb\nc\n"]


def test_transcript_normalisation(spark):
    assert many(spark, tx.normalise_transcript, ["a [x] b (주의) c (ok)"]) == ["a b c (ok)"]
    assert many(spark, lambda c: tx.normalise_transcript(tx.clean_body(c)), ["a\n---\n> q\nb"]) == ["a b"]


def test_paths(spark):
    assert many(spark, tx.stem, ["/a/b.c.md", "x", "/d/.env"]) == ["b.c", "x", ".env"]
    assert many(spark, tx.extension, ["/a/B.PDF", "x", "/d/.env"]) == [".pdf", "", ""]
    assert one(spark, tx.data_url(F.col("x"), F.lit("image/png")), b"ab", "binary") == "data:image/png;base64,YWI="


def words_apart(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_word_distance_matches_brute_force(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcdeé한") for _ in range(rng.randrange(12))], [rng.choice("abcdeé한") for _ in range(rng.randrange(12))]) for _ in range(200)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.d for r in rows.select("i", tx.word_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: words_apart(*p) for i, p in enumerate(pairs)}


def test_edits_match_brute_force(monkeypatch):
    # also where a strip's edge cuts the longer sequence
    from markfuse.functions import edits

    rng = random.Random(9)
    for strip in (1, 3, 64, 4096):
        monkeypatch.setattr(edits, "STRIP", strip)
        for _ in range(300):
            a, b = ("".join(rng.choice("abcé한"[: rng.choice((1, 2, 5))]) for _ in range(rng.randrange(20))) for _ in range(2))
            assert edits.apart(a, b) == edits.apart(list(a), list(b)) == words_apart(a, b)


def test_edit_scores_match_brute_force(spark):
    # lower case may be further apart (final sigma) or longer (dotted I) than the texts are
    rng = random.Random(10)
    texts = ["", " ", "ΑΣ", "ΑΣΑ", "İx", "ix", "The Cat", "the cat", "Thc Cat", "a\u00a0b\x1cc", "𝒜b"] + ["".join(rng.choice("aAbB eE\n") for _ in range(rng.randrange(15))) for _ in range(20)]
    pairs = [(a, b) for a in texts for b in texts]
    rows = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "a string, b string").select("a", "b", F.lower("a").alias("la"), F.lower("b").alias("lb"), tx.words("a").alias("wa"), tx.words("b").alias("wb"), tx.edit_scores("a", "b").alias("e"), tx.edit_distance("a", "b").alias("d"))
    for r in rows.collect():
        if r.a is None or r.b is None:
            assert r.d is None and tuple(r.e) == (None,) * 5
        else:
            assert r.d == r.e.dist and tuple(r.e) == (words_apart(r.a, r.b), words_apart(r.la, r.lb), len(r.wa), len(r.wb), words_apart(r.wa, r.wb))


def test_python_splits_words_alike(spark):
    texts = [f"a{chr(c)}b" for c in range(0x3400) if not 0xD800 <= c < 0xE000] + ["a\ufeffb", "a\U000e0020b"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", tx.words("x").alias("w")).collect()
    assert [r.x for r in got if r.w != r.x.split()] == []


def test_white_space_of_transcripts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(" \t\n\x1c\x85\u00a0\u3000ab>-[](한)") for _ in range(rng.randrange(25))) for _ in range(400)] + ["", "---\n> a"]
    c = F.regexp_replace(F.regexp_replace("x", rf"(?dUm)^[{tx.SPACE}]*---+[{tx.SPACE}]*$", " "), rf"(?dUm)^[{tx.SPACE}]*>.*$", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", " "), rf"\([^)]*[{tx.HANGUL}][^)]*\)", " ")
    plain = tx.strip(F.regexp_replace(c, rf"(?U)[{tx.SPACE}]+", " "))
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", plain.alias("want"), tx.normalise_transcript(tx.clean_body("x")).alias("got"))
    assert [r.x for r in rows.collect() if r.want != r.got] == []


def test_long_texts_that_differ_little(spark):
    # the time of a full table of prefixes grows with the square of their length
    from time import perf_counter

    base = "lorem ipsum " * 2500
    pairs = spark.createDataFrame([(1, "a", f"{i:05}", f"A{i} {base}", f"A{i} {base[:15000]}X{base[15000:]}") for i in range(16)], "doc int, label string, item_id string, ref string, hyp string")
    began = perf_counter()
    assert {(r.dist, r.dist_folded, r.word_dist) for r in score.score_items(pairs).collect()} == {(1, 1, 1)}
    assert perf_counter() - began < 20


# ---------------------------------------------------------------- profile and gaps


def test_headings_and_tables(spark):
    m = "# A\n## 12\n## B b \n#C\n####### x\n### Z\n#  \n"
    assert many(spark, profile.headings, [m]) == [[(2, "B b")]]
    assert many(spark, profile.table_count, ["| a |\n|---|\n\n| b |\ntext", "", "  | a", "x | a"]) == [2, 0, 1, 0]
    assert many(spark, profile.line_count, ["x\n", ""]) == [2, 1]


def outputs(spark, *rows):
    full = [(1, p, "primary" if i == 0 else "secondary", i, f"{p}.md", m) for i, (p, m) in enumerate(rows)]
    return spark.createDataFrame(full, "doc int, parser string, role string, sec_ord int, file string, markdown string")


def advice(spark, *rows):
    r = gaps.recommend(outputs(spark, *rows)).first()
    return r.gap_count, r.recommendation


def test_gaps_are_a_bag(spark):
    g = gaps.heading_gaps(outputs(spark, ("p", "# Old"), ("s", "# New\n# Old\n# New"))).collect()
    assert [(r.title, r.files) for r in g] == [("New", ["s.md", "s.md"])]


@pytest.mark.parametrize(
    "rows, want",
    [
        ((("p", "\n".join(f"# H{i:02}" for i in range(10))), ("s", "# G1")), (1, "patch_needed")),
        ((("p", "\n".join(f"# H{i:02}" for i in range(10))), ("s", "# G1\n# G2")), (2, "full_fusion")),
        ((("p", "text"), ("s", "\n".join(f"# H{i:02}" for i in range(5)))), (5, "patch_needed")),
        ((("p", "\n" * 99), ("s", "\n" * 129)), (0, "primary_only")),
        ((("p", "\n" * 99), ("s", "\n" * 130)), (0, "patch_needed")),
        ((("p", None), ("s", "# Ab")), (0, "full_fusion")),
        ((("p", "# Ab"), ("s", None)), (0, "primary_only")),
    ],
)
def test_recommendation(spark, rows, want):
    assert advice(spark, *rows) == want


def test_presence(spark):
    got = {r.title: r.keep for r in gaps.presence_vote(outputs(spark, ("p", "# Both\n# Mine"), ("s", "# Both"))).collect()}
    assert got == {"Both": True, "Mine": False}


def test_gap_sample_keeps_discovery_order(spark):
    o = outputs(spark, ("p", "x"), ("s", "# Zz\n# Aa"), ("t", "# Bb\n# Zz"))
    assert gaps.gap_sample(gaps.heading_gaps(o)).first().gaps_sample == ["Zz", "Aa", "Bb"]


# ---------------------------------------------------------------- assessment


def assessed(spark, texts, **k):
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id int, page_no int, text string")
    return assess.assess_pages(spark.createDataFrame([(1,)], "doc_id int"), pages, **k).first()


@pytest.mark.parametrize("n, tier", [(15, "small"), (16, "medium"), (60, "medium"), (61, "large"), (100, "large"), (101, "xlarge")])
def test_tier_cuts(spark, n, tier):
    assert assessed(spark, ["x" * 60] * n).tier == tier


@pytest.mark.parametrize("n, tier", [(10, "medium"), (70, "xlarge"), (200, "xlarge")])
def test_scan_goes_a_tier_up(spark, n, tier):
    r = assessed(spark, [" "] * n)
    assert (r.tier, r.has_text_layer) == (tier, False)


def test_layer_and_table_limits(spark):
    assert not assessed(spark, ["x" * 50] * 3).has_text_layer
    assert assessed(spark, ["x" * 50, "x" * 50, " " + "x" * 51]).has_text_layer
    assert assessed(spark, ["|"] * 3 + ["x"] * 7).table_hint
    assert not assessed(spark, ["|"] * 2 + ["x"] * 8).table_hint
    assert not assessed(spark, ["\t\t\t"]).table_hint
    assert assessed(spark, ["\t\t\t\t"]).table_hint


def test_no_pages(spark):
    r = assessed(spark, [])
    assert (r.pages, r.has_text_layer, r.table_hint, r.tier) == (0, False, True, "medium")


def test_middle_pages_are_looked_at_again(spark):
    r = assessed(spark, [" "] * 60 + ["x" * 90] * 5 + [" "] * 60, middle=True)
    assert (r.has_text_layer, r.text_layer_recheck, r.tier) == (False, True, "xlarge")


def parsers(spark, fmt, tier, layer=True, lang="ko", ruleset="code"):
    return assess.recommend(spark.createDataFrame([(fmt, tier, layer, lang)], "format string, tier string, has_text_layer boolean, lang string"), ruleset).first().parsers


def test_recommended_parsers(spark):
    assert parsers(spark, "pdf", "small", lang="en") == ["gemini", "mistral"]
    assert parsers(spark, "pdf", "medium", layer=False, lang="en") == ["upstage", "gemini", "mistral"]
    assert parsers(spark, "pdf", "small", layer=False) == ["gemini", "upstage"]
    assert parsers(spark, "docx", "small", lang="en") == ["upstage", "llamaparse"]
    assert parsers(spark, "pdf", "large", ruleset="doc") == ["llamaparse", "opendataloader"]
    assert parsers(spark, "odd", "small") == ["upstage"]


def test_every_ruleset_is_met(spark):
    from markfuse.sources import registry

    frame = lambda fmt, tiers: spark.createDataFrame([(fmt, t, True, "ko") for t in tiers], "format string, tier string, has_text_layer boolean, lang string")
    for ruleset in {r for r, *_ in registry.STRATEGY}:
        for fmt in {f for r, f, *_ in registry.STRATEGY if r == ruleset}:
            want = {t: p for r, f, t, p in registry.STRATEGY if (r, f) == (ruleset, fmt)}
            tiers = assess.TIERS if "any" in want else list(want)
            got = assess.recommend(frame(fmt, tiers), ruleset).collect()
            assert {r.tier: r.parsers for r in got} == {t: want.get(t, want.get("any")) for t in tiers} and len(got) == len(tiers), (ruleset, fmt)


def test_files_without_pages(spark):
    rows = [("docx", 5 * 1024 * 1024 - 1), ("docx", 5 * 1024 * 1024), ("xlsx", 1), ("hwp", 10**9), ("pdf", 1)]
    got = assess.assess_files(spark.createDataFrame(rows, "format string, size_bytes long")).collect()
    assert [(r.format, r.tier, r.table_hint) for r in got] == [("docx", "small", False), ("docx", "medium", False), ("xlsx", "small", True), ("hwp", "hwpx", False)]


def test_credits_and_corrections(spark):
    rows = spark.createDataFrame([(484, "agentic"), (0, "fast"), (2, "odd"), (None, "fast")], "p int, t string")
    assert [r[0] for r in rows.select(assess.credits(F.col("p"), F.col("t"))).collect()] == [4840, None, 20, None]
    a = spark.createDataFrame([(200, False, True, "xlarge")], "pages long, has_text_layer boolean, table_hint boolean, tier string")
    assert assess.corrections(a).first().triggers == ["scan", "scan_numeric_table", "recheck_text_layer"]
    assert many(spark, assess.english_ratio, ["abc가", "12"]) == [0.75, None]
    assert many(spark, assess.english_ratio, [None, "", "가나", "aé 1 b-ß", "x"]) == [None, None, 0.0, 0.5, 1.0]


def test_registry(spark):
    got = {r.parser: r.status for r in registry.readiness(spark, ["GV_TOKEN", "GEMINI_API_KEY"]).collect()}
    assert (got["gvision"], got["gemini"], got["opendataloader"]) == ("key_needed", "usable", "usable")
    got = {r.parser: r.status for r in registry.readiness(spark, ["GV_TOKEN", "GV_PROJECT"], ["gvision"]).collect()}
    assert (got["gvision"], got["gemini"]) == ("usable", "install")


# ---------------------------------------------------------------- normaliser


def normalized(spark, lines):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, pos int, line string")
    return [(r.rule, r.text) for r in normalize.normalize(rows).orderBy("pos").collect()]


def kept(spark, lines):
    return [t for _, t in normalized(spark, lines) if t is not None]


def test_drops(spark):
    assert kept(spark, ["---", "<!-- Page 3 -->", "![a](b)", "<figcaption>x", "y"]) == ["y"]


def test_levels(spark):
    names = ["Ⅱ. a", "3. a", "3) a", "(3) a", "① a", "가. a", "abc"]
    assert kept(spark, [f"###### {n}" for n in names] + ["######"]) == [f"{'#' * n} {t}" for n, t in zip([1, 2, 3, 4, 5, 5, 3], names, strict=True)] + ["### "]
    assert kept(spark, ["###### 1. a ····· 3"]) == ["###### 1. a ····· 3"]


def test_cover(spark):
    assert kept(spark, ["# Ⅰ", "Title", "", "###### Ⅰ. Title"]) == ["# Ⅰ. Title"]
    near = ["# Ⅰ", *["x"] * 48, "###### Ⅰ. Title"]
    assert kept(spark, near) == ["# Ⅰ. Title"]
    assert kept(spark, [near[0], "x", *near[1:]])[0] == "# Ⅰ"


def test_repeated_title(spark):
    assert kept(spark, ["## T", "", "T", "", "x"]) == ["## T", "", "", "x"]
    assert kept(spark, ["##", "## T", "", "T", "", "x"])[3] == "T"


def test_promotion(spark):
    assert kept(spark, ["", "2) a", ""])[0] == "### 2) a"
    for n, want in ((59, "##### "), (60, "")):
        line = "① " + "a" * (n - 2)
        assert kept(spark, ["x", "", line, ""])[2] == want + line
    assert kept(spark, ["x", "", "---", "2) a", ""])[2] == "### 2) a"
    assert kept(spark, ["x", "", "2) a", "---", ""])[2] == "2) a"


def test_blank_lines(spark):
    got = normalized(spark, ["", "", "a", "", "", "", "", "b"])
    assert [t for _, t in got if t is not None] == ["a", "", "", "b"]
    assert [r for r, _ in got].count("blank_compressed") == 2


def test_unterminated_mark_is_no_heading(spark):
    d = spark.createDataFrame([(1, "######"), (2, "######\n")], "doc int, markdown string")
    rows = normalize.normalize(normalize.to_lines(d)).collect()
    assert {r.doc: r.rule for r in rows} == {1: "kept", 2: "h6"}


def sequential(lines):
    """The same rules, line by line, as a check on the windows."""
    import re

    chapter = "|".join([*normalize.CHAPTERS, "부록"])
    border = [x == "---" or re.match(r"#{1,6}\s", x) for x in lines]
    title = next((re.sub(r"^##\s*", "", x) for x in lines if x == "##" or x.startswith("## ")), "")
    out, skip = [], False
    for i, x in enumerate(lines):
        m = re.fullmatch(rf"#\s+({chapter})", x)
        if border[i]:
            skip = bool(m) and any(y.startswith(f"###### {m[1]}.") for y in lines[i + 1 : i + 50])
        alone = (not out or not out[-1]) and (i + 1 == len(lines) or not lines[i + 1])
        if skip or x == "---" or x.startswith(("![", "<fig", "<!-- Page 1")) or (title and x == title and alone):
            continue
        if x.startswith("######") and (len(x) == 6 or x[6] == " "):
            c = x[6:].strip()
            level = 1 if re.match(rf"({'|'.join(normalize.CHAPTERS)})[.\s]|부록", c) else 2 if re.match(r"\d+\.\s", c) else 3
            x = "#" * level + " " + c
        elif x and alone and re.match(r"\d\) \S", x):
            x = "### " + x
        out.append(x)
    final = []
    for x in out:
        if x or final[-2:] != ["", ""] and final:
            final.append(x)
    return final


def test_windows_match_line_by_line(spark):
    rng = random.Random(5)
    pool = ["", "", "", "# Ⅰ", "# 부록", "###### Ⅰ. x", "###### 부록. x", "## T", "T", "---", "![i](j)", "<figure>", "<!-- Page 1 -->", "1) a", "text", "###### 2. y", "######", "| a |", "##"]
    docs = [[rng.choice(pool) for _ in range(rng.randrange(1, 16))] for _ in range(1500)]
    rows = spark.createDataFrame([(d, i, x) for d, lines in enumerate(docs) for i, x in enumerate(lines)], "doc int, pos int, line string")
    got = {d: [] for d in range(len(docs))}
    for r in normalize.normalize(rows).where("text IS NOT NULL").orderBy("doc", "pos").collect():
        got[r.doc].append(r.text)
    bad = [(docs[d], got[d], sequential(docs[d])) for d in got if got[d] != sequential(docs[d])]
    assert not bad, bad[:2]


# ---------------------------------------------------------------- recognition results


def test_elements(spark):
    kind = "array<struct<category:string,content:struct<markdown:string>>>"
    e = [(c, (m,)) for c, m in [("header", "h"), ("paragraph", "A"), ("footer", "f"), ("paragraph", "B"), ("paragraph", "")]]
    assert one(spark, ocr.join_elements("x", F.lit("fb")), e, kind) == "A\n\nB"
    assert one(spark, ocr.join_elements("x", F.lit("fb")), [], kind) == "fb"
    assert one(spark, ocr.join_elements("x", F.lit("fb")), None, kind) == "fb"
    assert one(spark, ocr.join_elements("x", F.lit("fb")), e[:1], kind) == ""


def test_low_confidence(spark):
    words = [{"confidence": c, "symbols": [{"text": t} for t in "ab"]} for c in (0.90, 0.8999, None)]
    tree = [{"blocks": [{"paragraphs": [{"words": words}]}]}]
    assert [w.confidence for w in one(spark, ocr.low_words(ocr.words_of("x")), tree, ocr.WORD_TREE)] == [0.8999]
    assert many(spark, ocr.parse_low, ["저신뢰: foo(0.85), bar baz(0.40)\nx", "저신뢰：a(1.2.3)", "none"]) == [[("foo", 0.85), ("bar baz", 0.40)], [("a", None)], []]
    assert many(spark, ocr.body_of, ["# h\nx\n저신뢰: a(0.1)\n  ## k\ny"]) == ["x\ny"]


def test_page_text_round_trip(spark):
    low = F.array(F.struct(F.lit("w").alias("text"), F.lit(0.5).alias("confidence")))
    page = one(spark, ocr.page_text(F.lit(3), F.col("x"), low), " body ")
    assert page == "\n## p.3\n\nbody\n\n저신뢰: w(0.50)\n"
    assert one(spark, ocr.page_text(F.lit(2), F.col("x"), low, F.lit(500)), "b").startswith("\n## p.2  [HTTP 500]")


def test_drafts(spark):
    m = "pre\n## p.1\nabc\n한글\nab 한\n123\n자기 점검표\nzzz\n## p.2  [HTTP 500] x\n## p.3\n저신뢰: q(0.1)\nold\n## p.3 \nnew\n저신뢰:\nnext"
    got = ocr.draft_pages(spark.createDataFrame([(1, m)], "doc int, markdown string")).orderBy("page_no").collect()
    assert [(r.page_no, r.lines, r.low) for r in got] == [(1, ["abc"], ""), (3, ["new", "next"], "next")]
    files = ocr.draft_files(ocr.draft_pages(spark.createDataFrame([(1, m)], "doc int, markdown string"))).orderBy("file_name").collect()
    assert [f.file_name for f in files] == ["draft_p01.txt", "draft_p03.txt"]


# ---------------------------------------------------------------- scores and alignment


def test_scores(spark):
    md = lambda *items: "\n".join(f"## 학번: {i:05}\n{b}" for i, b in items)
    rows = [
        ("canon", 1, md((1, "kitten"), (2, "the cat sat on mat"), (3, ""), (4, "a"), (5, "x"), (5, "last"))),
        ("a", 1, md((1, "sitting"), (2, "the cat sit on a mat"), (3, "z"), (4, "abcd"), (5, "last"))),
        ("b", 1, md((1, "kitten"), (9, "extra"))),
    ]
    pairs = score.paired(score.parse_items(spark.createDataFrame(rows, "label string, doc int, markdown string")), ["a", "b"])
    got = {(r.label, r.item_id): r for r in score.score_items(pairs).collect()}
    assert (got["a", "00001"].dist, got["a", "00001"].ref_len) == (3, 6)
    assert (got["a", "00002"].word_dist, got["a", "00002"].ref_words) == (2, 5)
    assert (got["a", "00003"].cer, got["b", "00003"].cer) == (1.0, 0.0)
    assert got["a", "00004"].cer == 3.0 and got["a", "00005"].dist == 0 and got["b", "00005"].cer == 1.0
    s = {r.label: r for r in score.summarise(score.score_items(pairs)).collect()}
    assert s["a"].sum_ref_len == 6 + 18 + 1 + 4 and s["a"].items == 4
    assert score.best(score.summarise(score.score_items(pairs)), ["a", "b"]).first().label in ("a", "b")
    assert {(r.label, r.item_id, r.side) for r in score.mismatched(pairs).collect()} == {("b", i, "missing") for i in ("00002", "00003", "00004", "00005")} | {("b", "00009", "extra")}
    assert sinks.score_report(score.score_items(pairs), score.summarise(score.score_items(pairs))).count() == 2


def diverge(spark, a, b):
    return align.divergences(spark.createDataFrame([(a, b)], "llm string, ocr string")).first().divergences


def test_divergences(spark):
    assert diverge(spark, "the cat sat", "the bat sat") == [("replace", ["cat"], ["bat"], "the")]
    assert diverge(spark, "2026학년도", "2026 학년도") == []
    assert diverge(spark, "a , b", "a b") == []
    assert diverge(spark, "été", "t") == []
    assert diverge(spark, "", "x y") == [("insert", [], ["x", "y"], "")]


def test_different_marks_are_no_anchor(spark):
    # `##` and `,` have no letters; aligned with each other they hid that c and e are equal
    found = diverge(spark, "## p.1\nbion c dion e.", "bi0n c di0n e. , end")
    assert [(d.tag, d.llm, d.ocr) for d in found] == [("replace", ["p.1", "bion"], ["bi0n"]), ("replace", ["dion"], ["di0n"]), ("insert", [], ["end"])]
    assert [(d.tag, d.llm, d.ocr) for d in diverge(spark, "a - b", "c - d")] == [("replace", ["a"], ["c"]), ("replace", ["b"], ["d"])]
    assert diverge(spark, "a , b", "a . b") == []


def test_divergences_match_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(7)
    pairs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(15))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(15)))) for i in range(150)]
    got = {r.i: [(d.tag, d.llm, d.ocr) for d in r.divergences] for r in align.divergences(spark.createDataFrame(pairs, "i int, llm string, ocr string")).collect()}
    for i, a, b in pairs:
        x, y = a.split(), b.split()
        want = [(t, x[i1:i2], y[j1:j2]) for t, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if t != "equal" and "".join(x[i1:i2]) != "".join(y[j1:j2])]
        assert got[i] == want


def test_pages_pair_by_order(spark):
    d = spark.createDataFrame([(1, "## p.1\na\n## p.2\nb\n## p.3\nc", "x\n## p.01\na\n## p.02\nq\n저신뢰: q(0.2)")], "doc int, llm_markdown string, ocr_markdown string")
    t = align.targets(d).orderBy("idx").collect()
    assert [(r.page, r.n_llm, r.n_ocr, len(r.low)) for r in t] == [("p.1", 3, 2, 0), ("p.2", 3, 2, 1)]
    totals = {r.page: (r.divergences, r.low) for r in align.target_totals(align.targets(d)).collect()}
    assert totals[None][1] == 1 and set(totals) == {None, "p.1", "p.2"}
    assert "page numbers differ" in sinks.target_report(align.targets(d)).first().report
    whole = spark.createDataFrame([(1, "# A\nx\n# B\ny", "no pages")], "doc int, llm_markdown string, ocr_markdown string")
    assert [(r.page, r.n_llm, r.n_ocr) for r in align.pair_pages(whole).collect()] == [("p.1", 2, 1)]


# ---------------------------------------------------------------- cells, images, clean-up, fusion


def cell_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "t int, r int, col_no int, parser string, value string")


def test_cells(spark):
    t = spark.createDataFrame([(1, "x\n| a | b |\n|---|:-:|\n| 1 | 2 \\| 3 |\ny\n| z |")], "doc int, markdown string")
    got = [(r.table_no, r.row_no, r.col_no, r.value) for r in cells.parse_tables(t, "doc").orderBy("table_no", "row_no", "col_no").collect()]
    assert got == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, "2 \\| 3"), (1, 0, 0, "z")]
    assert many(spark, cells.is_skeleton, ["| | |\n|---|", "| 1 |"]) == [True, False]


def test_column_shift_is_seen_by_position_only(spark):
    c = cell_rows(spark, *[(1, 1, i, p, v) for p, vs in (("upstage", "250"), ("mistral", "520")) for i, v in enumerate([*vs, "7"])])
    sums = cells.row_sums(c, ["t", "r"], total_col=3).collect()
    assert all(r.ok for r in sums)
    assert [r.col_no for r in cells.conflicts(c, ["t", "r", "col_no"], ["upstage", "mistral"]).orderBy("col_no").collect()] == [0, 1]


def test_majority(spark):
    c = cell_rows(spark, (1, 1, 0, "upstage", "a"), (1, 1, 0, "mistral", "b"), (1, 1, 0, "llamaparse", "b"), (1, 1, 0, "gemini", "a"), (2, 1, 0, "mistral", "y"), (2, 1, 0, "upstage", "x"))
    got = {r.t: (r.value, r.votes, r.settled) for r in cells.majority(c, ["t", "r", "col_no"]).collect()}
    assert got == {1: ("b", 2, True), 2: ("x", 1, False)}


def test_cells_side_by_side(spark):
    # cells that have met give what a grouping of the single ones gives, missing and null ones too
    order, keys = ["upstage", "llamaparse", "mistral"], ["t", "r", "col_no"]
    c = cell_rows(spark, *[(i, 1, 0, p, v) for i, vs in enumerate([("a", "b", "b"), ("a", "b", "c"), ("a", None, None), (None, None, None), ("a", "a", "a")]) for p, v in zip(order, vs)], (9, 1, 0, "mistral", "z"), (10, 1, 0, "gemini", "z"))
    met = cells.meet(c, keys, order)
    assert {r.t: (r.value, r.votes, r.settled) for r in cells.majority_met(met, keys).collect()} == {0: ("b", 2, True), 1: ("a", 1, False), 2: (None, 2, True), 3: (None, 3, True), 4: ("a", 3, True), 9: ("z", 1, False)}
    assert cells.majority(c, keys).exceptAll(cells.majority_met(met, keys)).count() == 0
    assert {r.t: r["values"] for r in cells.conflicts_met(met, keys, order).where("t IN (0, 9)").collect()} == {0: "upstage=a;llamaparse=b;mistral=b", 9: "upstage=-;llamaparse=-;mistral=z"}
    assert {r.t for r in cells.conflicts(c, keys, order).collect()} == {0, 1, 2, 9}
    assert cells.majority_met(met.drop(*order), keys).count() == 0


def test_row_sums_side_by_side(spark):
    # F6
    d = spark.createDataFrame([(1, "p", 1, 2, 3), (2, "p", 1, None, 1), (3, "p", 1, 2, None)], "t int, parser string, a long, b long, c long")
    assert [(r.sum, r.total, r.ok) for r in cells.row_sums_met(d, ["t"], [F.col("a"), F.col("b")], F.col("c")).orderBy("t").collect()] == [(3, 3, True), (1, 1, True), (3, 0, False)]


def test_fill_and_numbers(spark):
    c = spark.createDataFrame([(1, 0, 0, ""), (1, 1, 0, "a"), (1, 2, 0, "")], "t int, row_no int, col_no int, value string")
    assert [r.value for r in cells.fill_merged(c, ["t"]).orderBy("row_no").collect()] == ["-", "a", "a"]
    assert one(spark, cells.missing_numbers(F.lit("total 12"), F.col("x")), "total 12 of 1,300") == ["1,300"]


def test_images(spark):
    m = "![x](page_2_image_1_v2.jpg) ![y](page_2_layout_ocr_ab.png) ![한글](page_2_layout_a.png) ![](page_2_layout_b.png)"
    d = spark.createDataFrame([(1, m)], "doc int, markdown string")
    assert [r.image_index for r in alt.extract_images(d).orderBy("match_pos").collect()] == [1, 1000, 1001, 1002]
    assert [r.image_index for r in alt.extract_images(d, skip_hangul=True).orderBy("match_pos").collect()] == [1, 1000, 1002]
    known = spark.createDataFrame([(1, "![x](page_2_image_1_v2.jpg)", "그림")], "doc int, placeholder string, ko_alt string")
    r = alt.inject(d, known).first()
    assert (r.markdown, r.replaced, r.unmapped) == ("(이미지: 그림) (이미지: y) (이미지: 한글) ", 1, 3)
    assert many(spark, alt.is_mostly_hangul, ["가a", "가ab", ""]) == [True, False, False]
    answers = spark.createDataFrame([(1, 2, 1, " one "), (1, 2, 9, "far"), (1, 2, 0, "zero"), (1, 2, 2, "")], "doc int, page int, index int, alt string")
    assert [(r.image_index, r.ko_alt) for r in alt.answer_to_map(answers, alt.extract_images(d)).collect()] == [(1, "one")]
    assert many(spark, alt.json_answers, ['so: [{"index": 1, "alt": "a"}] end', "none"]) == [[(1, "a")], None]


def test_text_rules(spark):
    p = postprocess
    assert many(spark, p.strip_page_numbers, ["a\n\n<page_number>\n3</page_number>\n\nb\n\n\n\nc"]) == ["ab\n\nc"]
    assert many(spark, p.strip_heading_icons, ["## (이미지: x) 1 T\ny"]) == ["## 1 T\ny"]
    assert many(spark, p.strip_degree_lines, ["a\n°\nb", "20°"]) == ["a\nb", "20°"]
    assert many(spark, p.strip_descriptions, ["a\n```description\nx\n```\nb"]) == ["a\nb"]
    assert many(spark, p.strip_part_labels, ["# A\nP·A·R·T # A\nP·A·R·T 5\nb"]) == ["# A\nb"]
    assert many(spark, p.strip_after_diagrams, ["```mermaid\nx\n```\n\n![a](page_1_image_2_v2.jpg)\nb"]) == ["```mermaid\nx\n```\nb"]
    assert many(spark, p.strip_placeholders, ["![a](page_1_image_2_v2.jpg)![](page_1_layout_x.png)NO_CONTENT_HERE"]) == ["(이미지: a)"]
    assert many(spark, p.final_clean, ['<label><input type="checkbox">x</label><figcaption>y</figcaption>![q](w)']) == ["□x"]
    assert many(spark, p.flatten_html_table, ['<table><tr><th colspan="2">a</th></tr><tr><td>1</td><td></td></tr></table>']) == ["| a | a |\n|---|---|\n| 1 | - |"]
    assert many(spark, p.flatten_html_table, [None, "", "<table></table>", "<tr><TD COLSPAN=3> <b></b> </TD><td>x<br>y</td></tr>", "<tr><td>colspan</td></tr>"]) == ["", "", "", "| - | - | - | x<br>y |\n|---|---|---|---|", "| colspan |\n|---|"]
    assert many(spark, p.clean, [None, ""]) == [None, ""]


def flagged(spark, f, column, lines):
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, pos int, line string")
    return [r.line for r in f(d).where(column).orderBy("pos").collect()]


def test_line_rules(spark):
    p = postprocess
    assert flagged(spark, p.heading_runs, "listed", ["# A", "", "# B", "# C", "x", "# D", "# E"]) == ["# A", "# B", "# C"]
    assert flagged(spark, p.split_headings, "part_of_heading", ["# Ⅲ", "# One two", "# Ⅲ One two", "x"]) == ["# Ⅲ", "# One two"]
    assert flagged(spark, p.split_headings, "part_of_heading", ["# IV", "one", "two three", "# Ⅳ one two three"]) == ["# IV", "one", "two three"]
    assert flagged(spark, p.split_headings, "part_of_heading", ["# Ⅱ", "", "# Ⅱ Two", "# Ⅲ", "# Ⅳ Four"]) == ["# Ⅱ"]
    assert flagged(spark, p.broken_titles, "part_of_title", ["One", "two", "three", "", "# One two three", "One", "else"]) == ["One", "two", "three"]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# Ⅰ", "# Ⅰ. A", "P·A·R·T 1", "# Ⅳ B", "P·A·R·T **Ⅴ**", "# x"])], "doc int, pos int, line string")
    assert [(r.ord, r.numeral, r.part, r.same) for r in p.chapter_check(d).orderBy("ord").collect()] == [(1, 1, 1, True), (2, 4, 5, False)]
    assert flagged(spark, p.headings_in_tables, "in_table", ["# T", "| a |", "", "# T", "", "| b |"]) == ["# T"]
    assert flagged(spark, p.repeated_footers, "footer", ["출력자: a 1", "전자서명자 b", "x 출력자", " 출력자: a 2", "전자서명자 c"]) == [" 출력자: a 2", "전자서명자 c"]
    assert flagged(spark, p.drop_running_lines, "true", ["h", "a", "h", "b", "h"]) == ["h", "a", "b"]


def test_fusion(spark):
    o = outputs(spark, ("llamaparse", "# Aa\na\n# Cc\nc"), ("upstage", "# Aa\n# Bb\nb\n# Cc"), ("hwpx_local", "# Bb\nother\n# Dd\nd"))
    f = fuse.fuse(o)
    r = f.first()
    assert r.markdown == "# Dd\nd\n# Aa\na\n# Bb\nb\n# Cc\nc" and r.inserted == 2
    assert f.select(fuse.fused_name(F.lit("d"), F.col("contributors"))).first()[0] == "d_fused_v3_llamaparse+upstage+hwpxlocal.md"
    m, n = fuse.recall(F.lit("aab 😀"), F.lit("ab😀😀"))
    assert (one(spark, m), one(spark, n)) == (3, 4)
    assert one(spark, fuse.lost_markers(F.lit("① a ② b ②"), F.lit("② ①"))) == ["②"]
    assert one(spark, fuse.lost_markers(F.lit(None).cast("string"), F.lit("①"))) == []
    runs = spark.createDataFrame([(1, "a", True), (1, "b", False)], "doc int, parser string, ok boolean")
    assert tuple(fuse.run_status(runs).first()) == (1, 1, 1, True, True)
    a = spark.createDataFrame([(1, 5, "small"), (2, 7, "small")], "doc int, pages int, tier string")
    got = {r.doc: (r.parsers, r.failed_parsers, r.lines) for r in fuse.run_summary(a, runs, f).collect()}
    assert got == {1: (["a"], ["b"], 8), 2: (None, None, None)}


def test_word_recall(spark):
    d = spark.createDataFrame([(1, "a b a c", "a\u3000b x"), (2, None, "a"), (3, "a", None), (None, " ", "")], "doc int, source string, markdown string")
    assert {r.doc: (r.matched, r.total) for r in fuse.word_recall(d).collect()} == {1: (2, 4), 2: (0, 0), 3: (0, 1), None: (0, 0)}
    assert fuse.word_recall(d.limit(0)).count() == 0


def test_cascade(spark):
    d = spark.createDataFrame([(1, "## p.1\nMr. Han\n## p.2\nsame", "## p.1\nDear me\n이름\n저신뢰: me(0.16)\n## p.2\nsame")], "doc int, llm_markdown string, ocr_markdown string")
    one, two = align.cascade(d).orderBy("page").collect()
    assert (one.draft, [x.word for x in one.low], one.look) == (["Dear me"], ["me"], True)
    assert one.divergences and two.page == "p.2" and two.draft == ["same"]


# ---------------------------------------------------------------- sources, sinks, streaming


def test_answers(spark):
    raw = '{"elements": [{"category": "footer", "content": {"markdown": "f"}}, {"category": "p", "content": {"markdown": "A"}}], "content": {"markdown": "all"}}'
    assert many(spark, adapters.layout_answer, [raw, '{"content": {"markdown": "all"}}']) == ["A", "all"]
    assert many(spark, adapters.paged_answer, ['{"pages": [{"markdown": "a"}, {"markdown": "b"}]}']) == ["<!-- Page 1/2 -->\n\na\n\n---\n\n<!-- Page 2/2 -->\n\nb"]
    assert many(spark, lambda c: adapters.full_answer(c, F.lit("")), ["m", ""]) == ["m", adapters.EMPTY]


def test_adapter_keeps_errors_in_their_row(spark):
    def call(path, content, options):
        if path == "bad":
            raise ValueError("no")
        return {"markdown": content.decode() + options["end"], "page_count": 1}

    files = spark.createDataFrame([("good", b"x"), ("bad", b"y")], "path string, content binary")
    got = {r.path: r for r in adapters.run_parser(files, "p", call, {"end": "!"}, attempts=2).collect()}
    assert (got["good"].markdown, got["good"].error, got["bad"].markdown, got["bad"].attempts) == ("x!", None, None, 2)
    assert adapters.fallback(adapters.run_parser(files, "p", call, {"end": "!"}), adapters.run_parser(files, "q", lambda p, c, o: {"markdown": "q"})).orderBy("path").collect()[0].parser == "q"


def test_adapter_wrappers(spark):
    import time

    def slow(path, content, options):
        time.sleep(30)
        return {"markdown": "late"}

    def bad(path, content, options):
        raise ValueError("no")

    good = lambda path, content, options: {"markdown": "m", "finish_reason": "MAX_TOKENS"}
    files = spark.createDataFrame([("a", b"x")], "path string, content binary")
    r = adapters.run_parser(files, "p", slow, attempts=1, seconds=0.2).first()
    assert r.error.startswith("TimeoutError") and r.markdown is None
    assert adapters.seconds_for("xlarge") == 600 and adapters.seconds_for("small") == 300
    assert adapters.first_of(bad, good)("a", b"", {})["markdown"] == "m"
    with pytest.raises(ValueError):
        adapters.first_of(good, bad)("a", b"", {}) and adapters.first_of(bad, bad)("a", b"", {})
    answers = iter([None, None, {"markdown": "done"}])
    assert adapters.polled(lambda p, c, o: 7, lambda ticket: next(answers), every=0.01)("a", b"", {}) == {"markdown": "done"}
    with pytest.raises(TimeoutError):
        adapters.polled(lambda p, c, o: 7, lambda ticket: None, every=0.05, seconds=0.1)("a", b"", {})
    texts = iter([{"markdown": None}, {"markdown": "b"}])
    assert adapters.with_text(lambda p, c, o: next(texts))("a", b"", {})["markdown"] == "b"
    assert adapters.with_text(good)("a", b"", {})["warnings"]
    with pytest.raises(ValueError, match="STOP"):
        adapters.with_text(lambda p, c, o: {"markdown": None, "finish_reason": "STOP"})("a", b"", {})
    d = spark.createDataFrame([(400, '{"error": {"code": "E1", "message": "bad", "request_id": "r"}}'), (500, "oops"), (200, "{}")], "s int, b string")
    assert [r[0] for r in d.select(adapters.answer_error("s", "b")).collect()] == ["E1 - bad (request_id: r)", "500 - oops", None]
    assert many(spark, adapters.answer_notes, ['{"warnings": ["w"], "needed_ocr": true, "ocr_pages_used": 3}', "{}"]) == [["w", "recognised pages: 3"], []]


def test_saved_alt_maps_and_stages(spark, tmp_path):
    m = spark.createDataFrame([("d", "![a](page_1_image_1_v2.jpg)", 1, 1, "a", "그림")], "doc string, placeholder string, page int, image_index int, en_alt string, ko_alt string")
    sinks.write_alt_maps(m, str(tmp_path / "maps"))
    back = readers.read_alt_maps(spark, str(tmp_path / "maps"))
    assert back.collect() == m.collect()
    docs = spark.createDataFrame([("d", "x ![a](page_1_image_1_v2.jpg)")], "doc string, markdown string")
    assert alt.inject(docs, back).first().replaced == 1
    out = spark.createDataFrame([("d", "upstage", "m")], "doc string, parser string, markdown string")
    for stage in ("parsed", "fused", "parsed"):
        sinks.write_outputs(out, str(tmp_path / "out"), stage=stage)
    assert sorted(r.stage for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["fused", "parsed"]


def test_files(spark, tmp_path):
    (tmp_path / "a_upstage.md").write_text("# A\r\nx")
    (tmp_path / "b.PDF").write_bytes(b"1234")
    (tmp_path / "c.xyz").write_bytes(b"1")
    m = readers.read_markdown(spark, str(tmp_path / "*.md")).first()
    assert (m.base, m.parser, m.markdown) == ("a", "upstage", "# A\nx")
    files = readers.read_binary(spark, str(tmp_path))
    assert {(r.ext, r.format) for r in files.select("ext", "format").collect()} == {(".md", None), (".pdf", "pdf"), (".xyz", None)}
    assert readers.discover(spark, str(tmp_path), [".pdf"]).count() == 1
    assert readers.unsupported(files).count() == 2
    assert readers.readable_by(files, "opendataloader").count() == 1
    assert readers.parsers_for(files).count() == 7
    assert {r.parser for r in readers.parsers_for_extension(files.limit(0).unionByName(files)).collect()} >= {"corepin"}
    seen = files.where("ext = '.pdf'").select(F.sha2("content", 256).alias("content_sha256"))
    assert readers.reusable(files, seen).count() == 1
    sinks.write_outputs(readers.read_markdown(spark, str(tmp_path / "*.md")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().parser == "upstage"


def test_compare_report(spark):
    import json

    o = outputs(spark, ("p", "# Aa"), ("s", "# Bb"))
    g = gaps.heading_gaps(o)
    r = json.loads(sinks.compare_report(profile.profile(o), gaps.recommend(o, g), gaps.gap_sample(g)).first().report)
    assert r["gap_count"] == 1 and r["gaps_sample"] == ["Bb"] and [x["role"] for x in r["outputs"]] == ["primary", "secondary"]


def test_stream(spark, tmp_path):
    from markfuse.streaming import ingest

    outputs(spark, ("p", "# Ab\nx")).write.parquet(str(tmp_path / "in"))
    schema = "doc int, parser string, role string, sec_ord int, file string, markdown string"
    for _ in range(2):
        ingest.profile_stream(ingest.read_outputs(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.headings for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]

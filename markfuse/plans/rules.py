"""Queries for the clean-up rules, flags, registries and joins, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfuse.functions import text as tx
from markfuse.operators import align, alt, assess, cells, fuse, postprocess, score
from markfuse.plans import views
from markfuse.plans.catalogue import _ASSESS, _ITEMS, LABELS, _pairs
from markfuse.session import spread, table
from markfuse.sources import readers, registry

# ---------------------------------------------------------------- inputs


def marked(d: views.Spark) -> str:
    """k, m: a part as a piece of parsed Markdown with most artefacts that the rules remove."""
    nl = "chr(10)"
    parts = [
        f"'Intro ' || p_name || {nl}",
        f"CASE k % 3 WHEN 0 THEN '![chart ' || k || '](page_' || (k % 9 + 1) || '_image_2_v2.jpg)' WHEN 1 THEN '![](page_3_layout_ab.png)' ELSE '![x](other.png)' END || {nl}",
        f"CASE WHEN k % 4 = 1 THEN '```description' || {nl} || 'a chart' || {nl} || '```' || {nl} ELSE '' END",
        f"CASE k % 5 WHEN 2 THEN 'P·A·R·T # Two' || {nl} WHEN 3 THEN 'P·A·R·T IV' || {nl} ELSE '' END",
        f"CASE WHEN k % 6 = 0 THEN '```mermaid' || {nl} || 'graph' || {nl} || '```' || {nl} || {nl} || '![m](page_2_layout_q1.png)' || {nl} ELSE '' END",
        f"CASE WHEN k % 7 = 0 THEN '<label><input type=\"checkbox\" checked> yes</label>' || {nl} ELSE '' END",
        f"CASE WHEN k % 8 = 0 THEN '<figcaption>Fig ' || k || '</figcaption>' || {nl} || {nl} || {nl} ELSE '' END",
        f"CASE WHEN k % 9 = 0 THEN 'NO_CONTENT_HERE' || {nl} ELSE '' END",
        "'End'",
    ]
    return f"SELECT k, {' || '.join(parts)} AS m FROM (SELECT p_partkey AS k, p_name FROM [part]) p"


def html_tables(d: views.Spark) -> str:
    """k, html: a part as an HTML table; every fourth one has a cell over two columns."""
    row = lambda tag, a, b: f"'<tr><{tag}>' || {a} || '</{tag}><{tag}>' || {b} || '</{tag}></tr>'"
    wide = "CASE WHEN k % 4 = 0 THEN '<tr><td colspan=\"2\"><b>all</b></td></tr>' ELSE '<tr><td></td><td>a<br/>b</td></tr>' END"
    return f"SELECT k, '<table>' || {row('th', chr(39) + 'key' + chr(39), chr(39) + 'name' + chr(39))} || {row('td', 'k', 'p_name')} || {wide} || '</table>' AS html FROM (SELECT p_partkey AS k, p_name FROM [part]) p"


def rule_lines(d: views.Spark) -> str:
    """doc, pos, line: orders as the lines of short documents, 40 lines each."""
    kinds = ["'# Ⅰ'", "'# Ⅱ'", "'# Ⅰ. Start'", "'# Ⅱ. Next'", "'P·A·R·T 1'", "'P·A·R·T **Ⅱ**'", "'One'", "'two'", "'One two'", "'# One two'", "'| a | b |'", "'| c |'", "'# Title'", "'# Ⅱ Start'", "'Start'", "'x'"]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(kinds))
    return f"SELECT {d.div('o_orderkey', 40)} AS doc, o_orderkey % 40 AS pos, CASE o_custkey % 18 {cases} ELSE '' END AS line FROM [orders]"


def file_list(d: views.Spark) -> str:
    """k, path, ext, format, size_bytes: parts as files of every format."""
    kinds = [(e, f) for e, f in registry.FORMATS.items()] + [(".txt", None), (".heic", None)]
    ext = " ".join(f"WHEN {i} THEN '{e}'" for i, (e, _) in enumerate(kinds))
    fmt = " ".join(f"WHEN {i} THEN '{f}'" for i, (_, f) in enumerate(kinds) if f)
    n = len(kinds)
    return f"SELECT p_partkey AS k, 'in/a b/file ' || p_partkey || '.v1' || CASE p_partkey % {n} {ext} END AS path, CASE p_partkey % {n} {ext} END AS ext, CASE p_partkey % {n} {fmt} END AS format, p_partkey * CAST(104857 AS BIGINT) AS size_bytes FROM [part]"


def alt_answers(d: views.Spark) -> str:
    """doc, page, index, alt: answers of a service to the images of alt_docs; some are out of range or empty."""
    return "SELECT user_id AS doc, CAST(event_id % 5 + 1 AS INT) AS page, CAST(event_id % 6 AS INT) AS \"index\", CASE WHEN event_id % 4 = 0 THEN ' ' ELSE ' alt ' || event_id END AS alt FROM [events] WHERE event_id % 3 = 1".replace('"index"', d.name("index"))


def grid(d: views.Spark) -> str:
    """t, row_no, col_no, value: an order's lines as a table with merged (empty) cells."""
    value = "CASE WHEN (l_orderkey + l_linenumber * i) % 3 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber || '-' || i END"
    return f"SELECT l_orderkey AS t, l_linenumber AS row_no, CAST(i AS INT) AS col_no, {value} AS value FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM [lineitem]) l {d.times('i', range(3))}"


def runs(d: views.Spark) -> str:
    """doc, parser, ok: a nation's parser runs."""
    return f"SELECT n_nationkey AS doc, parser, (n_nationkey + length(parser)) % 4 <> 1 AS ok FROM [nation] {d.times('parser', views.PARSERS)}"


# ---------------------------------------------------------------- queries


def _digest(rows: DataFrame, out, key: str = "k") -> DataFrame:
    made = rows.select(key, out.alias("__out"))  # in a step of its own: taken twice
    return made.select(key, F.length("__out").cast("long").alias("n_chars"), F.sha2("__out", 256).alias("sha256"))


def placeholder_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(views.of(spark, sf, marked), postprocess.strip_placeholders("m"))


def description_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(views.of(spark, sf, marked), postprocess.strip_descriptions("m"))


def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(views.of(spark, sf, marked), postprocess.strip_part_labels("m"))


def diagram_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(views.of(spark, sf, marked), postprocess.strip_after_diagrams("m"))


def final_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(views.of(spark, sf, marked), postprocess.final_clean("m"))


def flat_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(spread(views.of(spark, sf, html_tables), "k"), postprocess.flatten_html_table("html"))


def _flagged(spark: SparkSession, sf: str, rule, flag: str) -> DataFrame:
    return rule(views.of(spark, sf, rule_lines)).where(flag).select("doc", "pos", "line")


def embedded_contents(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf, postprocess.heading_runs, "listed")


def table_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf, postprocess.headings_in_tables, "in_table")


def broken_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf, postprocess.broken_titles, "part_of_title")


def split_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf, postprocess.split_headings, "part_of_heading")


def chapter_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that are missing on one side are 0 here."""
    c = postprocess.chapter_check(views.of(spark, sf, rule_lines))
    return c.select("doc", F.col("ord").cast("long").alias("ord"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("numeral", "part")), "same")


def first_running_lines(spark: SparkSession, sf: str) -> DataFrame:
    left = postprocess.drop_running_lines(views.of(spark, sf, rule_lines))
    return left.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("pos").cast("long").alias("sum_pos"))


def repeated_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf, postprocess.repeated_headings, "repeated")


def cover_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf, postprocess.cover_headings, "on_cover")


def caption_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return views.of(spark, sf, marked).select("k", postprocess.needs_enrichment("m").alias("needs_enrichment"))


def file_tiers(spark: SparkSession, sf: str) -> DataFrame:
    f = assess.assess_files(views.of(spark, sf, file_list).where("format IS NOT NULL"))
    return f.select("k", "format", "tier", "has_text_layer", "table_hint", F.round("size_mib", 6).alias("size_mib"))


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return views.of(spark, sf, file_list).select("k", tx.stem("path").alias("stem"), tx.extension("path").alias("ext"), fuse.output_name(tx.stem("path"), F.lit("hwpx_local")).alias("output"), tx.data_url(tx.stem("path").cast("binary"), F.col("ext")).alias("url"))


def parser_choices(spark: SparkSession, sf: str) -> DataFrame:
    f = readers.parsers_for(views.of(spark, sf, file_list).where("format IS NOT NULL"))
    return f.groupBy("k", "format").agg(F.array_join(F.sort_array(F.collect_list("parser")), ",").alias("parsers"))


def extension_choices(spark: SparkSession, sf: str) -> DataFrame:
    return readers.parsers_for_extension(views.of(spark, sf, file_list)).groupBy("ext", "parser").agg(F.count(F.lit(1)).alias("n"))


def recommend_doc(spark: SparkSession, sf: str) -> DataFrame:
    f = assess.assess_files(views.of(spark, sf, file_list).where("format IS NOT NULL")).withColumn("lang", F.lit("ko"))
    return assess.recommend(f, "doc").select("k", "format", F.array_join("parsers", ",").alias("parsers"))


def parser_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return registry.readiness_summary(registry.readiness(spark, ["GV_TOKEN", "UPSTAGE_API_KEY", "GV_PROJECT"])).withColumn("n", F.col("n").cast("long"))


def hangul_share(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.repeat(F.lit("한글"), (F.col("k") % 12).cast("int")), F.lit(" "), "m")
    return views.of(spark, sf, marked).select("k", alt.is_mostly_hangul(F.substring(t, 1, 20)).alias("hangul"))


def lost_numbers(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat_ws(" ", F.lit("n"), F.col("k").cast("string"), (F.col("k") * 7).cast("string"), F.lit("1,234.5"))
    some = F.when(F.col("k") % 3 == 0, F.regexp_replace(full, "[0-9]", "")).otherwise(full.substr(F.lit(1), F.length(full) - 8))
    lost = cells.missing_numbers(some, full)
    return views.of(spark, sf, marked).select("k", F.array_join(lost, ";").alias("lost"))


def table_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("k") % 3 == 0, "|  | |\n|---|---|\n| | |").otherwise(F.concat(F.lit("| a |\n|---|\n| "), F.col("k").cast("string"), F.lit(" |")))
    return views.of(spark, sf, marked).select("k", cells.is_skeleton(t).alias("skeleton"))


def correction_triggers(spark: SparkSession, sf: str) -> DataFrame:
    a = assess.assess_pages(None, views.of(spark, sf, views.doc_pages))
    d = F.col("doc_id")
    a = a.withColumns({"is_exam": d % 5 == 0, "english_ratio": (d % 10) / F.lit(10.0), "numeric_table": d % 4 == 0, "cross_table": d % 7 == 0})
    return assess.corrections(a).select("doc_id", F.array_join("triggers", ",").alias("triggers"))


def english_share(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    # of the letters and digits one class: matching a union of three ranges and single letters takes seven times as long
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{Alnum} éüñ]+", "")
    return docs.select("doc_id", F.round(assess.english_ratio(plain), 9).alias("ratio"))


def more_parsers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    m = views.of(spark, sf, marked).select("k", (k % 2 == 0).alias("unresolved"), (k % 3 == 0).alias("foreign"), (k % 5 == 0).alias("critical"), (k % 7 == 0).alias("new_type"), (k % 11 == 0).alias("source_typo"), (k % 4).alias("n_parsers"))
    return fuse.extra_parser_reasons(m).select("k", F.array_join("reasons", ",").alias("reasons"))


def alt_answers_joined(spark: SparkSession, sf: str) -> DataFrame:
    images = alt.extract_images(views.of(spark, sf, views.alt_docs))
    m = alt.answer_to_map(views.of(spark, sf, alt_answers), images)
    return m.groupBy("doc").agg(F.count(F.lit(1)).alias("n_mapped"), F.sum("page").cast("long").alias("sum_page"))


def roster_check(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"))
    left, right = c.where("k % 5 <> 0"), c.where("k % 7 <> 0").withColumn("value", F.when(F.col("k") % 4 == 0, F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    return cells.joined(left, right, ["k"])


def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.fill_merged(views.of(spark, sf, grid), ["t"])


def parser_runs(spark: SparkSession, sf: str) -> DataFrame:
    return fuse.run_status(views.of(spark, sf, runs))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc"), F.col("n_nationkey").cast("long").alias("pages"), F.lit("small").alias("tier"))
    fused = fuse.fuse(views.of(spark, sf, views.md_nation))
    out = fuse.run_summary(n, views.of(spark, sf, runs), fused)
    return out.select("doc", "pages", "tier", F.array_join("parsers", ",").alias("parsers"), F.array_join("failed_parsers", ",").alias("failed_parsers"))


def best_label(spark: SparkSession, sf: str) -> DataFrame:
    s = score.summarise(score.score_items(_pairs(spark, sf)))
    return score.best(s, LABELS).select("label")


def page_targets(spark: SparkSession, sf: str) -> DataFrame:
    totals = align.target_totals(align.targets(views.of(spark, sf, views.page_pairs)))
    return totals.select(F.col("doc").alias("doc_id"), F.coalesce("page", F.lit("total")).alias("page"), "divergences", "low")


def token_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "")
    words = F.transform(tx.tokens(t), tx.token_key)
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("keys_sha256"), F.sha2(tx.letters_key(tx.tokens(t)), 256).alias("letters_sha256"))


def cascade_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = align.cascade(views.of(spark, sf, views.page_pairs))
    count = lambda name: F.size(name).cast("long")
    return c.select(F.col("doc").alias("doc_id"), "page", count("draft").alias("n_draft"), count("divergences").alias("divergences"), count("low").alias("low"), "look")


def footer_lines(d: views.Spark) -> str:
    """doc, pos, line: orders as lines, some of them of footer blocks with changing values."""
    cases = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["출력자: ", " 전자서명자 ", "원본대조필 ", "본문 출력자 "]))
    return f"SELECT {d.div('o_orderkey', 40)} AS doc, o_orderkey % 40 AS pos, CASE o_custkey % 6 {cases} ELSE 'x' END || o_orderkey AS line FROM [orders]"


def footer_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return postprocess.repeated_footers(views.of(spark, sf, footer_lines)).where("footer").select("doc", "pos", "line")


def word_recall(spark: SparkSession, sf: str) -> DataFrame:
    return fuse.word_recall(views.of(spark, sf, views.md_page), "page_id")


def questions(d: views.Spark) -> str:
    """k, source, markdown: a part as a question with five choices; parsers lose or repeat some markers."""
    return """SELECT k, n || ' ① a ② b ③ c ④ d ⑤ ①' AS source,
  n || CASE k % 4 WHEN 0 THEN ' ① a ② b ③ c ④ d ⑤ ①' WHEN 1 THEN ' ① a ② b (3) c ④ d ⑤' WHEN 2 THEN ' ① ① ② ② ③ ④ ⑥' ELSE ' a' END AS markdown FROM (SELECT p_partkey AS k, p_name AS n FROM [part]) p"""


def choice_markers(spark: SparkSession, sf: str) -> DataFrame:
    q = views.of(spark, sf, questions)
    return q.select("k", F.array_join(fuse.lost_markers(F.col("source"), F.col("markdown")), "").alias("lost"))


NAMES = (
    placeholder_rules, description_blocks, part_labels, diagram_placeholders, final_clean, flat_tables, embedded_contents, table_headings, broken_titles, split_headings,
    chapter_numbers, first_running_lines, repeated_headings, cover_headings, caption_candidates, file_tiers, file_names, parser_choices, extension_choices, recommend_doc,
    parser_readiness, hangul_share, lost_numbers, table_skeletons, correction_triggers, english_share, more_parsers, alt_answers_joined, roster_check, merged_cells, parser_runs, run_report,
    best_label, page_targets, token_keys, cascade_pages, footer_repeats, word_recall, choice_markers,
)
QUERIES: dict = {f.__name__: f for f in NAMES}

# ---------------------------------------------------------------- oracles

_M = f"x AS ({views.sql(marked)})"
_L = f"l AS ({views.sql(rule_lines)})"
_F = f"f AS ({views.sql(file_list)})"
_IMAGE = r"!\[[^\]]*\]\(page_\d+_(?:image_\d+_v2\.jpg|layout_\w+\.\w+)\)"


def _text(rule: str) -> str:
    return f"WITH {_M}, y AS (SELECT k, {rule} AS m FROM x) SELECT k, length(m) AS n_chars, sha256(m) AS sha256 FROM y"


def _sub(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


_NUMBER = "CASE WHEN {0} IN ('Ⅰ', 'I', '1') THEN 1 WHEN {0} IN ('Ⅱ', 'II', '2') THEN 2 WHEN {0} IN ('Ⅳ', 'IV') THEN 4 END"
_SUPPORT = ", ".join(f"('{p}', '{f}')" for p, fs in registry.FORMAT_SUPPORT.items() for f in fs)
_TAKES = ", ".join(f"('{p}', '{e}')" for p, fs in registry.FORMAT_SUPPORT.items() for e in [*(e for e, f in registry.FORMATS.items() if f in fs), *registry.MORE_EXTENSIONS.get(p, [])])

# The misread text differs from the transcript token by token, so each run of differing tokens is one
# divergence; the page header, which the recogniser's text lacks, and its added last words are one each,
# or part of the run they touch.
_ALIGNED = r"""c AS (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS a, replace(replace(replace(coalesce(text, ''), ' la ', ' Ia '), ' la ', ' Ia '), 'ion', 'i0n') AS b FROM conversations),
w AS (SELECT doc_id, turn, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS idx, regexp_extract_all(a, '[^\s]+') AS a, regexp_extract_all(b, '[^\s]+') AS b FROM c),
k AS (SELECT doc_id, turn, len(a) AS n, list_transform(range(1, len(a) + 1), lambda i: (lower(a[i]) <> lower(b[i]))::INT) AS d FROM w),
r AS (SELECT doc_id, turn, n, CASE WHEN n = 0 THEN 1 ELSE list_sum(list_transform(range(1, n + 1), lambda i: d[i] * (1 - CASE WHEN i > 1 THEN d[i - 1] ELSE 0 END))) END AS replaced,
             CASE WHEN n = 0 THEN 0 ELSE 1 - d[1] END AS deleted, CASE WHEN n = 0 THEN 0 ELSE 1 - d[n] END AS inserted FROM k)"""

ORACLE: dict = {
    "placeholder_rules": _text(_sub(_sub(_sub("m", "NO_CONTENT_HERE"), r"!\[([^\]\s][^\]]*)\]\(page_\d+_(?:image_\d+_v2\.jpg|layout_\w+\.\w+)\)", r"'(이미지: \1)'"), _IMAGE)),
    "description_blocks": _text(_sub("m", r"(?sm)^```description\b.*?^```[^\S\n]*\n?")),
    "part_labels": _text(_sub("m", r"(?m)^[^\S\n]*P·A·R·T(?: #[^\n]*|[^\S\n]+\S+)[^\S\n]*(?:\n|\z)")),
    "diagram_placeholders": _text(_sub("m", rf"(?sm)(^```mermaid\b.*?^```[^\S\n]*\n)\s*{_IMAGE}[^\S\n]*\n?", r"'\1'")),
    "final_clean": _text(_sub(_sub(_sub(_sub("m", r'(?i)(?:<label>)?\s*<input\s+type="?checkbox"?[^>]*>', "'□'"), "(?is)<figcaption>.*?</figcaption>|</label>"), r"!\[[^\]]*\]\([^)]*\)"), r"\n{3,}", "chr(10) || chr(10)")),
    "flat_tables": """WITH y AS (SELECT k, '| key | name |' || chr(10) || '|---|---|' || chr(10) || '| ' || k || ' | ' || p_name || ' |' || chr(10)
  || CASE WHEN k % 4 = 0 THEN '| all | all |' ELSE '| - | a<br/>b |' END AS m FROM (SELECT p_partkey AS k, p_name FROM part))
SELECT k, length(m) AS n_chars, sha256(m) AS sha256 FROM y""",
    "embedded_contents": f"""WITH {_L}, r AS (SELECT *, regexp_matches(line, '^#\\s+\\S') AS h FROM l),
g AS (SELECT *, sum((NOT h AND line <> '')::INT) OVER (PARTITION BY doc ORDER BY pos) AS run FROM r),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc, run) AS n FROM g) SELECT doc, pos, line FROM n WHERE h AND n >= 3""",
    "table_headings": f"""WITH {_L}, r AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after, row_number() OVER (PARTITION BY doc, line ORDER BY pos) AS n FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos, line FROM r WHERE line LIKE '# %' AND n > 1 AND before LIKE '|%' AND after LIKE '|%'""",
    "broken_titles": f"""WITH {_L}, t AS (SELECT *, CASE WHEN line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '|%' THEN line END AS t FROM l),
h AS (SELECT doc, list(DISTINCT trim(regexp_replace(line, '^#+', ''))) AS hs FROM l WHERE line LIKE '#%' GROUP BY doc),
p AS (SELECT t.*, hs, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3 FROM t JOIN h USING (doc) WINDOW w AS (PARTITION BY doc ORDER BY pos)),
s AS (SELECT *, CASE WHEN list_contains(hs, t || ' ' || t1 || ' ' || t2 || ' ' || t3) THEN 4 WHEN list_contains(hs, t || ' ' || t1 || ' ' || t2) THEN 3 WHEN list_contains(hs, t || ' ' || t1) THEN 2 ELSE 0 END AS size FROM p)
SELECT doc, pos, line FROM (SELECT *, size > 0 OR lag(size, 1, 0) OVER w > 1 OR lag(size, 2, 0) OVER w > 2 OR lag(size, 3, 0) OVER w > 3 AS f FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos)) WHERE f""",
    "split_headings": f"""WITH {_L}, r AS (SELECT *, trim(regexp_replace(line, '^#+', '')) AS t, regexp_matches(line, '^# *[ⅠⅡIV]+ *$') AS lone, line LIKE '# %' AS head FROM l WHERE line <> ''),
v AS (SELECT *, {_NUMBER.format("regexp_extract(t, '^([ⅠⅡIV]+)(?:[. ]|$)', 1)")} AS num FROM r),
p AS (SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3, lead(t, 4) OVER w AS t4, lead(head, 1) OVER w AS h1, lead(head, 2) OVER w AS h2, lead(head, 3) OVER w AS h3, lead(head, 4) OVER w AS h4, lead(num, 1) OVER w AS n1
  FROM v WINDOW w AS (PARTITION BY doc ORDER BY pos)),
s AS (SELECT *, CASE WHEN NOT lone THEN 0
  WHEN h2 AND ends_with(t2, t1) AND length(t2) <= length(t1) + 5 THEN 2
  WHEN h3 AND ends_with(t3, t1 || ' ' || t2) AND length(t3) <= length(t1 || ' ' || t2) + 5 THEN 3
  WHEN h4 AND ends_with(t4, t1 || ' ' || t2 || ' ' || t3) AND length(t4) <= length(t1 || ' ' || t2 || ' ' || t3) + 5 THEN 4
  WHEN h1 AND n1 = num AND length(t1) > length(t) THEN 1 ELSE 0 END AS size FROM p)
SELECT doc, pos, line FROM (SELECT *, size > 0 OR lag(size, 1, 0) OVER w > 1 OR lag(size, 2, 0) OVER w > 2 OR lag(size, 3, 0) OVER w > 3 AS f FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos)) WHERE f""",
    "chapter_numbers": f"""WITH {_L}, v AS (SELECT doc, pos, {_NUMBER.format("regexp_extract(line, '^# *([ⅠⅡIV]+)(?:[. ]|$)', 1)")} AS numeral, {_NUMBER.format("regexp_extract(line, '^P·A·R·T [*]*([ⅠⅡIV]+|[0-9]+)', 1)")} AS part FROM l),
a AS (SELECT doc, numeral, row_number() OVER (PARTITION BY doc ORDER BY pos) AS ord FROM (SELECT *, lag(numeral) OVER (PARTITION BY doc ORDER BY pos) AS was FROM v WHERE numeral IS NOT NULL) WHERE was IS DISTINCT FROM numeral),
b AS (SELECT doc, part, row_number() OVER (PARTITION BY doc ORDER BY pos) AS ord FROM (SELECT *, lag(part) OVER (PARTITION BY doc ORDER BY pos) AS was FROM v WHERE part IS NOT NULL) WHERE was IS DISTINCT FROM part)
SELECT doc, ord, coalesce(numeral, 0) AS numeral, coalesce(part, 0) AS part, numeral IS NOT DISTINCT FROM part AS same FROM a FULL JOIN b USING (doc, ord)""",
    "first_running_lines": f"""WITH {_L}, r AS (SELECT *, count(*) OVER (PARTITION BY doc, line) AS n, row_number() OVER (PARTITION BY doc, line ORDER BY pos) AS i FROM l)
SELECT doc, count(*) AS n_lines, sum(pos)::BIGINT AS sum_pos FROM r WHERE line = '' OR n < 3 OR i = 1 GROUP BY doc""",
    "repeated_headings": f"""WITH {_L}, r AS (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY pos) AS was FROM l WHERE line LIKE '#%')
SELECT doc, pos, line FROM r WHERE line = was""",
    "cover_headings": f"""WITH {_L}, r AS (SELECT doc, pos, line, trim(regexp_replace(line, '^#+', '')) AS t FROM l WHERE line LIKE '# %'),
b AS (SELECT *, lead(t) OVER (PARTITION BY doc ORDER BY pos) AS t1 FROM r) SELECT doc, pos, line FROM b WHERE t = t1""",
    "caption_candidates": f"WITH {_M} SELECT k, regexp_matches(m, '(?is)<figcaption>.*?</figcaption>') AS needs_enrichment FROM x",
    "file_tiers": f"""WITH {_F} SELECT k, format, CASE WHEN format IN ('hwpx', 'hwp') THEN 'hwpx' WHEN size_bytes < 5242880 THEN 'small' ELSE 'medium' END AS tier, true AS has_text_layer, format = 'xlsx' AS table_hint,
  round(size_bytes / 1048576.0::DOUBLE, 6) AS size_mib FROM f WHERE format IS NOT NULL AND format <> 'pdf'""",
    "file_names": f"WITH {_F} SELECT k, 'file ' || k || '.v1' AS stem, ext, 'file ' || k || '.v1_hwpxlocal.md' AS output, 'data:' || ext || ';base64,' || base64(encode('file ' || k || '.v1')) AS url FROM f",
    "parser_choices": f"WITH {_F}, s(parser, format) AS (VALUES {_SUPPORT}) SELECT k, format, string_agg(parser, ',' ORDER BY parser) AS parsers FROM f JOIN s USING (format) GROUP BY k, format",
    "extension_choices": f"WITH {_F}, s(parser, ext) AS (VALUES {_TAKES}) SELECT ext, parser, count(*) AS n FROM f JOIN s USING (ext) GROUP BY ext, parser",
    "recommend_doc": f"""WITH {_F} SELECT k, format, CASE WHEN format IN ('hwp', 'hwpx') THEN 'hwpx_local' WHEN format = 'image' THEN 'upstage,gemini' ELSE 'upstage,llamaparse' END AS parsers
FROM f WHERE format IS NOT NULL AND format <> 'pdf'""",
    "parser_readiness": "SELECT * FROM (VALUES ('usable', 4::BIGINT), ('key_needed', 4::BIGINT)) v(status, n)",
    "hangul_share": f"""WITH {_M}, t AS (SELECT k, substring(repeat('한글', (k % 12)::INT) || ' ' || m, 1, 20) AS t FROM x)
SELECT k, length(regexp_replace(t, '[^가-힣]', '', 'g')) * 2 >= length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS hangul FROM t""",
    "lost_numbers": """WITH x AS (SELECT p_partkey AS k, [k::VARCHAR, (k * 7)::VARCHAR, '1,234.5'] AS n FROM part)
SELECT k, CASE WHEN k % 3 = 0 THEN array_to_string(list_filter(n, lambda v, i: list_position(n, v) = i), ';') ELSE '1,234.5' END AS lost FROM x""",
    "table_skeletons": "SELECT p_partkey AS k, p_partkey % 3 = 0 AS skeleton FROM part",
    "correction_triggers": f"""WITH {_ASSESS} SELECT doc_id, concat_ws(',', CASE WHEN NOT has_text_layer THEN 'scan' END, CASE WHEN NOT has_text_layer AND doc_id % 7 = 0 THEN 'cross_table_image' END,
  CASE WHEN NOT has_text_layer AND (table_hint OR doc_id % 4 = 0) THEN 'scan_numeric_table' END, CASE WHEN doc_id % 5 = 0 THEN 'exam' END, CASE WHEN doc_id % 10 >= 5 THEN 'english' END,
  CASE WHEN pages <= 20 THEN 'visual_check' END, CASE WHEN tier = 'xlarge' AND NOT has_text_layer THEN 'recheck_text_layer' END) AS triggers FROM t""",
    "english_share": """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 éüñ]', '', 'g') AS t FROM documents),
n AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-zéüñ]', '', 'g')) AS a, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS b FROM t)
SELECT doc_id, CASE WHEN a > 0 THEN round(b / a, 9) END AS ratio FROM n""",
    "more_parsers": """SELECT p_partkey AS k, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'unresolved' END, CASE WHEN k % 3 = 0 THEN 'foreign' END, CASE WHEN k % 5 = 0 AND k % 4 <= 2 THEN 'critical' END,
  CASE WHEN k % 7 = 0 THEN 'new_type' END, CASE WHEN k % 11 = 0 THEN 'source_typo' END) AS reasons FROM part""",
    "alt_answers_joined": f"""WITH i AS (SELECT user_id AS doc, event_id, (event_id % 5 + 1)::INT AS page, CASE WHEN event_id % 3 = 0 THEN 999 + row_number() OVER (PARTITION BY user_id, event_id % 5, event_id % 3 = 0 ORDER BY event_id) ELSE event_id % 7 END AS image_index,
  '![' || CASE WHEN event_type = 'error' THEN '' ELSE event_type END || '](page_' || (event_id % 5 + 1) || CASE WHEN event_id % 3 = 0 THEN '_layout_ocr_ab' || event_id || '.png' ELSE '_image_' || (event_id % 7) || '_v2.jpg' END || ')' AS placeholder FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY image_index, event_id) AS ix FROM i), a AS ({views.sql(alt_answers)}),
m AS (SELECT DISTINCT n.doc, n.page, placeholder FROM n JOIN a ON a.doc = n.doc AND a.page = n.page AND a."index" = n.ix WHERE trim(a.alt) <> '')
SELECT doc, count(*) AS n_mapped, sum(page)::BIGINT AS sum_page FROM m GROUP BY doc""",
    "roster_check": """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS value FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS k, c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '?' ELSE '' END AS other FROM customer WHERE c_custkey % 7 <> 0)
SELECT k, value, other, value IS NOT DISTINCT FROM other AS same FROM a FULL JOIN b USING (k)""",
    "merged_cells": f"""WITH g AS ({views.sql(grid)})
SELECT t, row_no, col_no, coalesce(last_value(nullif(value, '') IGNORE NULLS) OVER (PARTITION BY t, col_no ORDER BY row_no ROWS UNBOUNDED PRECEDING), '-') AS value FROM g""",
    "parser_runs": f"WITH r AS ({views.sql(runs)}) SELECT doc, sum(ok::INT)::BIGINT AS parsers_ok, sum((NOT ok)::INT)::BIGINT AS failed, bool_or(ok) AS can_continue, sum(ok::INT) = 1 AS single FROM r GROUP BY doc",
    "run_report": f"""WITH r AS ({views.sql(runs)})
SELECT doc, doc::BIGINT AS pages, 'small' AS tier, coalesce(string_agg(CASE WHEN ok THEN parser END, ',' ORDER BY parser), '') AS parsers, coalesce(string_agg(CASE WHEN NOT ok THEN parser END, ',' ORDER BY parser), '') AS failed_parsers FROM r GROUP BY doc""",
    "best_label": f"WITH {_ITEMS}, s AS (SELECT label, sum(dist) / sum(ref_len) AS e FROM sc WHERE ref_len > 0 GROUP BY label) SELECT arg_min(label, (e, label)) AS label FROM s",
    "token_keys": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\s\x0B\x1c-\x1f]+') AS w FROM t)
SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(list_transform(w, lambda x: regexp_replace(lower(regexp_replace(x, '<[^>]*>', '', 'g')), '^\W+|\W+$', '', 'g')), ' ')) AS keys_sha256,
       sha256(regexp_replace(lower(regexp_replace(array_to_string(w, ''), '<[^>]*>', '', 'g')), '[^0-9a-z]', '', 'g')) AS letters_sha256 FROM w""",
    "page_targets": f"""WITH {_ALIGNED}, p AS (SELECT doc_id, 'p.' || (turn + 1) AS page, (replaced + deleted + inserted)::BIGINT AS divergences, 2::BIGINT AS low FROM r)
SELECT doc_id, page, sum(divergences)::BIGINT AS divergences, sum(low)::BIGINT AS low FROM p GROUP BY doc_id, page UNION ALL SELECT doc_id, 'total', sum(divergences)::BIGINT, sum(low)::BIGINT FROM p GROUP BY doc_id""",
    "cascade_pages": f"""WITH {_ALIGNED}, l AS (SELECT doc_id, turn, unnest(string_split(b || ' , end', chr(10))) AS s FROM c),
n AS (SELECT doc_id, turn, sum((regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '[가-힣]'))::INT)::BIGINT AS n_draft FROM l GROUP BY doc_id, turn)
SELECT doc_id, 'p.' || (turn + 1) AS page, n_draft, (replaced + deleted + inserted)::BIGINT AS divergences, 2::BIGINT AS low, true AS look FROM r JOIN n USING (doc_id, turn)""",
    "footer_repeats": f"""WITH l AS ({views.sql(footer_lines)}), m AS (SELECT *, regexp_extract(line, '^\\s*(출력자|전자서명자|원본대조필)', 1) AS label FROM l)
SELECT doc, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY pos) AS i FROM m WHERE label <> '') WHERE i > 1""",
    "word_recall": f"""WITH p AS ({views.sql(views.md_page)}),
a AS (SELECT page_id, w, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(source, '[^\\s\x0B\x1c-\x1f]+')) AS w FROM p) GROUP BY page_id, w),
b AS (SELECT page_id, w, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(markdown, '[^\\s\x0B\x1c-\x1f]+')) AS w FROM p) GROUP BY page_id, w),
s AS (SELECT page_id, sum(least(a.n, coalesce(b.n, 0)))::BIGINT AS matched, sum(a.n)::BIGINT AS total FROM a LEFT JOIN b USING (page_id, w) GROUP BY page_id)
SELECT page_id, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total FROM p LEFT JOIN s USING (page_id)""",
    "choice_markers": f"""WITH q AS ({views.sql(questions)}),
t AS (SELECT k, m, length(source) - length(replace(source, m, '')) AS a, length(markdown) - length(replace(markdown, m, '')) AS b FROM q CROSS JOIN (SELECT unnest(['①', '②', '③', '④', '⑤']) AS m))
SELECT k, coalesce(string_agg(CASE WHEN a > b THEN m END, '' ORDER BY m), '') AS lost FROM t GROUP BY k""",
    "token_divergence": f"""WITH {_ALIGNED}, t AS (SELECT doc_id, unnest(['replace', 'delete', 'insert']) AS tag, unnest([replaced, deleted, inserted]) AS n FROM r)
SELECT doc_id, tag, sum(n)::BIGINT AS n FROM t GROUP BY doc_id, tag HAVING sum(n) > 0""",
}

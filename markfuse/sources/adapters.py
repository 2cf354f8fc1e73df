"""The contract for parsers that are services or native programs.

An adapter is a function (path, content, options) -> dict with `markdown` and, optionally, page_count,
warnings, raw. It runs on executors, Arrow batch by batch. An error stays in its row; a job never fails
because one document does. Attempts are bounded, and so is the time of each. Concurrency against a
rate-limited service is the number of partitions, which `limit` lowers without a shuffle. Wrappers
around adapters add fallbacks, polling and retries of empty answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markfuse.functions.text import col
from markfuse.operators.ocr import join_elements
from markfuse.session import ship

SCHEMA = "path string, parser string, markdown string, page_count int, warnings array<string>, raw string, error string, attempts int"
EMPTY = "(내용 없음)"  # fixed value: stands for a document without content
# Seconds that a parser may take for a document, by tier.
SECONDS, SECONDS_XLARGE = 300.0, 600.0
CUT = "MAX_TOKENS"  # fixed value: the finish reason of an answer cut at the output cap

Adapter = Callable[[str, bytes, dict[str, Any]], dict[str, Any]]


def seconds_for(tier: str) -> float:
    return SECONDS_XLARGE if tier == "xlarge" else SECONDS


def within(call: Adapter, seconds: float) -> Adapter:
    """call, given up after so many seconds: its thread is left behind, its task goes on."""

    def run(path: str, content: bytes, options: dict[str, Any]) -> dict[str, Any]:
        import queue
        import threading

        done: queue.Queue = queue.Queue()

        def work() -> None:
            try:
                done.put((call(path, content, options), None))
            except Exception as e:
                done.put((None, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            found, error = done.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer within {seconds:g} s") from None
        if error is not None:
            raise error
        return found

    return run


def first_of(*calls: Adapter) -> Adapter:
    """The answer of the first call that does not fail, such as a synchronous one before a job."""

    def run(path: str, content: bytes, options: dict[str, Any]) -> dict[str, Any]:
        for call in calls[:-1]:
            try:
                return call(path, content, options)
            except Exception:  # the next one may do; the last one's error is the row's
                continue
        return calls[-1](path, content, options)

    return run


def polled(submit: Callable[[str, bytes, dict[str, Any]], Any], ask: Callable[[Any], dict[str, Any] | None], every: float = 5.0, seconds: float = SECONDS) -> Adapter:
    """A job: submit gives a ticket, ask gives None until its answer is there. Asking ends after `seconds`."""

    def run(path: str, content: bytes, options: dict[str, Any]) -> dict[str, Any]:
        import time

        ticket, end = submit(path, content, options), time.monotonic() + seconds
        while True:
            found = ask(ticket)
            if found is not None:
                return found
            if time.monotonic() + every > end:
                raise TimeoutError(f"job not done within {seconds:g} s")
            time.sleep(every)

    return run


def with_text(call: Adapter, tries: int = 2) -> Adapter:
    """call, asked again where it answers without a text; none at last is an error, and an answer cut at the
    output cap (finish_reason) carries a warning."""

    def run(path: str, content: bytes, options: dict[str, Any]) -> dict[str, Any]:
        found: dict[str, Any] = {}
        for _ in range(tries):
            found = call(path, content, options)
            if found.get("markdown") is not None:
                break
        reason = str(found.get("finish_reason"))
        if found.get("markdown") is None:
            raise ValueError(f"no text (finish_reason={reason})")
        if CUT in reason:
            found = found | {"warnings": [*(found.get("warnings") or []), "output cap reached: the text may be cut"]}
        return found

    return run


def run_parser(files: DataFrame, parser: str, call: Callable[[str, bytes, dict[str, Any]], dict[str, Any]], options: dict[str, Any] | None = None, attempts: int = 3, pause: float = 0.0, limit: int | None = None, seconds: float | None = SECONDS) -> DataFrame:
    """One row a file: SCHEMA. files: path, content. seconds: of one attempt; None: without limit."""
    ship(files.sparkSession)
    options = options or {}
    call = within(call, seconds) if seconds else call
    slim = files.select("path", "content")
    slim = slim.coalesce(limit) if limit else slim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, error, n = {}, None, 0
                while n < attempts:
                    n += 1
                    try:
                        found, error = call(path, content, options), None
                        break
                    except Exception as e:  # the row reports it
                        error = f"{type(e).__name__}: {e}"[:500]
                        if pause and n < attempts:
                            time.sleep(pause)
                rows.append({"path": path, "parser": parser, "markdown": found.get("markdown"), "page_count": found.get("page_count"), "warnings": found.get("warnings") or [], "raw": found.get("raw"), "error": error, "attempts": n})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return slim.mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [("path", pa.string()), ("parser", pa.string()), ("markdown", pa.string()), ("page_count", pa.int32()), ("warnings", pa.list_(pa.string())), ("raw", pa.string()), ("error", pa.string()), ("attempts", pa.int32())]
)


def fallback(*ranked: DataFrame) -> DataFrame:
    """Outputs of several parsers by preference: path, parser, markdown of the first without an error."""
    rows = None
    for rank, df in enumerate(ranked):
        one = df.where("error IS NULL AND markdown IS NOT NULL").select("path", F.lit(rank).alias("rank"), "parser", "markdown")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("path").agg(F.min_by(F.struct("parser", "markdown"), "rank").alias("x")).select("path", "x.parser", "x.markdown")


# ---------------------------------------------------------------- shapes of service answers

_ELEMENTS = "elements array<struct<category:string,content:struct<markdown:string>>>, content struct<markdown:string>, usage struct<pages:int>"


def layout_answer(raw: Column | str) -> Column:
    """Markdown from a layout service's JSON answer, without headers, footers and page numbers."""
    j = F.from_json(col(raw), _ELEMENTS)
    return join_elements(j["elements"], j["content"]["markdown"])


def batch_answers(parts: Column | str) -> Column:
    """Markdown of an asynchronous job's batches (array of JSON answers), in order."""
    return F.array_join(F.transform(col(parts), layout_answer), "\n")


def paged_answer(raw: Column | str) -> Column:
    """Markdown from an OCR service's JSON answer: pages under numbered comments between rules."""
    pages = F.from_json(col(raw), "pages array<struct<markdown:string>>")["pages"]
    one = F.transform(pages, lambda p, i: F.concat(F.lit("<!-- Page "), (i + 1).cast("string"), F.lit("/"), F.size(pages).cast("string"), F.lit(" -->\n\n"), F.coalesce(p["markdown"], F.lit(""))))
    return F.array_join(one, "\n\n---\n\n")


def answer_error(status: Column | str, body: Column | str) -> Column:
    """What a service's error says: code, message and request of its envelope, else status and body; null
    for status 200."""
    e = F.from_json(col(body), "error struct<code:string,message:string,request_id:string>")["error"]
    number = col(status).cast("string")
    told = F.concat(F.coalesce(e["code"], number), F.lit(" - "), F.coalesce(e["message"], col(body)), F.lit(" (request_id: "), F.coalesce(e["request_id"], F.lit("N/A")), F.lit(")"))
    return F.when(col(status) != 200, F.when(F.get_json_object(col(body), "$").isNotNull(), told).otherwise(F.concat(number, F.lit(" - "), col(body))))


def answer_notes(meta: Column | str) -> Column:
    """Warnings of an answer's metadata (JSON), and a note of pages that needed recognition."""
    m = F.from_json(col(meta), "warnings array<string>, needed_ocr boolean, ocr_pages_used int")
    pages = F.concat(F.lit("recognised pages: "), F.coalesce(m["ocr_pages_used"], F.lit(0)).cast("string"))
    return F.concat(F.coalesce(m["warnings"], F.array().cast("array<string>")), F.when(m["needed_ocr"], F.array(pages)).otherwise(F.array().cast("array<string>")))


def full_answer(markdown: Column | str, text: Column | str) -> Column:
    """The Markdown, else the text, else a mark for no content."""
    return F.coalesce(F.nullif(col(markdown), F.lit("")), F.nullif(col(text), F.lit("")), F.lit(EMPTY))


def instructed(tier: Column, instructions: str | None) -> Column:
    """Custom instructions where the tier takes them, else null."""
    return F.when(tier.isin("agentic", "agentic_plus"), F.lit(instructions))

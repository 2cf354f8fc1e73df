"""Column functions for Markdown text: line models, stripping, tokens and edit distances.

Regular expressions here follow Unicode throughout. A line ends at a line feed only; `universal` turns
the other conventions into it on ingest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s lacks the four information separators that count as white space in text files here.
SPACE = r"\s\x1c-\x1f"
HANGUL = "가-힣"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once a row, however often `use` takes it: what stands in a lambda
    would otherwise be worked out again for each element, and array functions share nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def universal(c: Column | str) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(rf"(?U)[^{SPACE}]")


def lines_split(c: Column | str) -> Column:
    """Lines between line feeds: a text that ends in one has an empty last line, an empty text one line."""
    return F.split(col(c), "\n", -1)


def lines_read(c: Column | str) -> Column:
    """Lines as a file reader gives them, without their ends: no empty line after the last line feed."""
    whole = col(c).endswith("\n") | (col(c) == "")
    return bound(lines_split(c), lambda parts: F.when(whole, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def lines_broken(c: Column | str) -> Column:
    """Lines broken at every Unicode line boundary, without an empty last one."""
    parts = F.split(col(c), r"\R|[\x1c-\x1e]", -1)
    return bound(parts, lambda x: F.when((F.size(x) > 0) & (F.element_at(x, -1) == ""), F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def tokens(c: Column | str) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(col(c), F.lit(rf"(?U)[^{SPACE}]+"), F.lit(0))


def strip_markup(c: Column | str) -> Column:
    """Without inline confidence notes in angle brackets and without tags."""
    return F.regexp_replace(F.regexp_replace(col(c), "⟨[^⟩]*⟩", ""), "<[^>]*>", "")


def token_key(c: Column | str) -> Column:
    """A token as alignment compares it: no markup, lower case, no punctuation at either end."""
    return F.regexp_replace(F.lower(strip_markup(c)), r"(?U)\A\W+|\W+\z", "")


def anchor_key(c: Column | str) -> Column:
    """token_key, but a token of punctuation only stays as it is: different marks are not the same word."""
    return F.regexp_replace(F.lower(strip_markup(c)), r"(?U)\A\W+(?=\w)|(?<=\w)\W+\z", "")


def letters_key(segment: Column | str) -> Column:
    """The bare letter sequence of an array of tokens; only ASCII letters, digits and Hangul count."""
    return F.regexp_replace(F.lower(strip_markup(F.array_join(col(segment), ""))), f"[^0-9a-z{HANGUL}]", "")


def replaced(c: Column | str, sign: str, pattern: str, by: str) -> Column:
    """pattern replaced where the text holds sign, without which it cannot match; looking for it is much cheaper."""
    return bound(col(c), lambda x: F.when(x.contains(sign), F.regexp_replace(x, pattern, by)).otherwise(x))


def normalise_transcript(c: Column | str) -> Column:
    """Without editorial marks: bracketed notes, parentheses that hold Hangul, runs of white space."""
    bare = replaced(replaced(c, "[", r"\[[^\]]*\]", " "), "(", rf"\([^)]*[{HANGUL}][^)]*\)", " ")
    # a single space stays as it is, and after this there is no other white space
    return F.trim(F.regexp_replace(bare, rf"(?U)[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " "))


def clean_body(c: Column | str) -> Column:
    """Rules and quoted lines become a space."""
    return replaced(replaced(c, "---", rf"(?dUm)^[{SPACE}]*---+[{SPACE}]*$", " "), ">", rf"(?dUm)^[{SPACE}]*>.*$", " ")


def words(c: Column | str) -> Column:
    """White-space separated words; none for an empty text."""
    return tokens(c)


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Least number of code point edits, or between arrays of element edits. It and `edit_scores` run in Python
    workers: see `session.ship`."""

    @F.arrow_udf("bigint")
    def apart(a, b):
        import pyarrow as pa

        from markfuse.functions import edits

        return pa.array([None if x is None or y is None else edits.apart(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    return apart(col(a), col(b))


def word_distance(a: Column, b: Column) -> Column:
    """Least number of word edits between two word arrays."""
    return edit_distance(a, b)


def edit_scores(a: Column | str, b: Column | str, with_words: bool = True) -> Column:
    """struct<dist, folded> of code point edits as they are and in lower case; with words also a_words, b_words,
    word_dist, of words as `words` gives them."""
    names = ["dist", "folded", *(["a_words", "b_words", "word_dist"] if with_words else [])]

    @F.arrow_udf("struct<" + ",".join(f"{x}:bigint" for x in names) + ">")
    def scores(*texts):
        import pyarrow as pa

        from markfuse.functions import edits

        rows = [edits.scores(*x, with_words) for x in zip(*(t.to_pylist() for t in texts))]
        return pa.StructArray.from_arrays([pa.array((r[i] for r in rows), pa.int64()) for i in range(len(names))], names)

    return scores(col(a), col(b), F.lower(col(a)), F.lower(col(b)))


def error_rate(distance: Column, length: Column, other_length: Column) -> Column:
    """distance / length; with an empty reference 0 if the other is empty too, else 1."""
    return F.when(length == 0, F.when(other_length == 0, 0.0).otherwise(1.0)).otherwise(distance / length)


def stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")


def extension(path: Column | str) -> Column:
    """Lower-cased last extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(F.regexp_extract(col(path), r"([^/]*)\z", 1), r"(?<=.)(\.[^.]*)\z", 1))


def data_url(content: Column | str, mime: Column | str) -> Column:
    """Binary content as a data URL; mime may be a column."""
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.base64(col(content)))

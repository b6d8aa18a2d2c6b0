"""Scalar text functions as column expressions; NFKC and NFKD alone need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

#: White space as Python's str.split() knows it.
SPACE = r"(?U)[\s\x1c-\x1f]"


def squeeze(text: Column) -> Column:
    """White space of any kind to one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return text.map(lambda t: None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _mapped(text: Column, table: dict[str, str]) -> Column:
    single = {a: b for a, b in table.items() if len(b) == 1}
    if single:
        text = F.translate(text, "".join(single), "".join(single.values()))
    for a, b in table.items():
        if len(b) != 1:
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fix_unit_separator_words(text: Column) -> Column:
    """Words that hold U+001F looked up without their punctuation, in the case that they had; others stay."""
    table = F.create_map(*[x for k, v in K.UNIT_SEPARATOR_WORDS.items() for x in (F.lit(k), F.lit(v))])
    marks = r"[\p{Punct}]"

    def one(part: Column) -> Column:
        core = F.regexp_replace(part, rf"^{marks}+|{marks}+$", "")
        found = F.try_element_at(table, F.lower(core))
        letters = F.replace(core, F.lit("\x1f"), F.lit(""))
        cased = F.when((letters == F.upper(letters)) & (F.length(letters) > 1), F.upper(found)).when(
            F.substring(letters, 1, 1) != F.lower(F.substring(letters, 1, 1)), F.concat(F.upper(F.substring(found, 1, 1)), F.substr(found, F.lit(2)))
        ).otherwise(found)
        return F.when(found.isNull(), part).otherwise(F.concat(F.regexp_extract(part, rf"^({marks}*)", 1), cased, F.regexp_extract(part, rf"({marks}*)$", 1)))

    parts = F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("\x1f")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def clean_line(text: Column, compose: bool = True) -> Column:
    """One line cleaned: bullet remains dropped, broken words, ligatures, quotes and dashes mapped, C1 controls out, NFKC, blanks squeezed."""
    out = fix_unit_separator_words(text)
    for table in (K.LIGATURES, K.QUOTES, K.DASHES):
        out = _mapped(out, table)
    out = F.regexp_replace(out, r"[\x{80}-\x{9f}]", "")
    out = nfkc(out) if compose else out
    return F.when(text.rlike(r"^[\x{80}-\x{9f}]y$"), F.lit("")).otherwise(F.trim(F.regexp_replace(out, r"[ \t]+", " ")))


def is_boilerplate_heading(text: Column) -> Column:
    plain = F.lower(squeeze(text))
    return plain.isin(K.BOILERPLATE_HEADINGS) | plain.rlike(K.BOILERPLATE_PATTERN)


def is_worksheet_rule(text: Column) -> Column:
    """A line of five characters or more that is over four fifths dots, or dashes."""
    line, n = F.trim(text), F.length(F.trim(text))
    share = lambda marks: F.length(F.regexp_replace(line, f"[^{marks}]", "")) / F.greatest(n, F.lit(1))
    return (n >= 5) & ((share(".") > 0.8) | (share(r"\-_") > 0.8))


def is_page_number(text: Column) -> Column:
    return squeeze(text).rlike(K.PAGE_NUMBER)


def count_tokens(text: Column) -> Column:
    """Tokens by rule: 1.3 a word, rounded half to even, at least one; none for an empty text."""
    words = F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(words * F.lit(1.3), 0).cast("int")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), F.trim), lambda s: s != "")


def terms(text: Column) -> Column:
    """Index terms: lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def chunk_type(text: Column, is_table: Column) -> Column:
    return F.when(is_table, "table").when(text.rlike(K.RECOMMENDATION), "recommendation").otherwise("guidance")


def evidence_grade(text: Column) -> Column:
    first = F.nullif(F.regexp_extract(text, K.GRADE, 1), F.lit(""))
    return F.upper(F.coalesce(first, F.nullif(F.regexp_extract(text, K.GRADE, 2), F.lit(""))))


def normalized_question(text: Column) -> Column:
    return F.lower(squeeze(F.translate(fold(text), "’‘", "''")))


def severity(text: Column) -> Column:
    out = F.when(text.isNull() | (text == ""), F.lit("unknown"))
    for word, level in K.SEVERITIES.items():
        out = out.when(F.contains(F.lower(text), F.lit(word)), level)
    return out.otherwise("unknown")


def script_language(text: Column) -> Column:
    """The language whose script holds at least half of the letters; null if none does."""
    counts = [F.struct(F.regexp_count(text, F.lit(f"[{chars}]")).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, chars) in enumerate(K.SCRIPTS.items())]
    top, letters = F.greatest(*counts), F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when((top["n"] > 0) & (letters > 0) & (top["n"] >= letters * 0.5), top["name"])


def latin_share(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(r"\p{L}")))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.70, "strong").when(value >= 0.45, "moderate").otherwise("weak")


def guarded(text: Column, limit: int = 64) -> Column:
    """Free text that is too long for a log is replaced by its length."""
    return F.when(F.length(text) > limit, F.concat(F.lit("<omitted: "), F.length(text).cast("string"), F.lit(" chars>"))).otherwise(text)


def client_key(forwarded: Column, peer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer, F.lit("unknown"))


def fenced_json(text: Column) -> Column:
    """Text without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def table_markdown(cells: Column) -> Column:
    """Rows of cells as a Markdown table, padded or cut to the header's width."""
    width = F.size(F.get(cells, 0))
    one = lambda c: F.replace(squeeze(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(r, one), F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(cells, row)
    return F.when(F.size(cells) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))), "\n"))


def filled_share(cells: Column) -> Column:
    flat = F.flatten(cells)
    full = F.size(F.filter(flat, lambda c: F.length(squeeze(F.coalesce(c, F.lit("")))) > 0))
    return F.coalesce(F.try_divide(full.cast("double"), F.size(flat)), F.lit(0.0))


def looks_bold(font: Column) -> Column:
    return F.lower(font).rlike("bold|black")

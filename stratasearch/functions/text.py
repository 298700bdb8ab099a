"""Text predicates and tokenization as column expressions.

The patterns run on the JVM inside generated code. ``(?d)`` makes ``^`` and ``$`` see line feeds only.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and thresholds of the query semantics.
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"
CAMEL_PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
PLAIN_WORD = r"^(?:[A-Z]?[a-z]+|[A-Z]+)$"
SYMBOL_QUERY = (
    r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+"
    r"|_[A-Za-z0-9_]*"
    r"|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*"
    r"|[A-Z][A-Za-z0-9]*)$"
)
EMBEDDED_SYMBOL = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"
STOPWORDS = (
    "a an and are as at be by do does for from has have how if in is it not of on or the to was "
    "what when where which who why with"
).split()
EVALUATION_STOPWORDS = (
    "but its can not no nor so yet both either neither than then will would could should may might been being had did will "
    "they all any each few more most other some such only own same too very just about after also before between during into "
    "through under up down over"
).split()
DEFINITION_KEYWORDS = (
    "class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function",
    "object", "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef",
)
SQL_DEFINITION_KEYWORDS = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")
BINARY_SNIFF_CHARS, BINARY_RATIO = 8192, 0.1
MINIFIED_SAMPLE_CHARS, MINIFIED_LINE_LENGTH = 65536, 2000
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
DOT_BREAKS, LINE_CONTROLS = r"\n\r\x85\x{2028}\x{2029}", "\x0b\x0c\x1c\x1d\x1e"
GIT_URL = r"^(?:https://|http://|ssh://|git://|git\+ssh://|file://)|^[\w.-]+@[\w.-]+:(?!/)"

SEPARATORS = ("::", "\\", "->", ".")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_identifier(token: Column | str) -> Column:
    """The lower-cased identifier, followed by its parts where it has two or more (snake parts before camel parts).

    Most identifiers are plain words; those skip the splitting. The parts are bound to a name once, as nothing inside a function over
    arrays is shared otherwise.
    """
    token = col(token)
    lower = F.lower(token)
    snake = F.filter(F.split(lower, "_"), lambda p: p != "")
    camel = F.transform(F.regexp_extract_all(token, F.lit(CAMEL_PART), F.lit(0)), F.lower)
    parts = F.when(F.contains(token, F.lit("_")), snake).otherwise(camel)
    whole = F.array(lower)
    split = F.element_at(F.transform(F.array(parts), lambda p: F.when(F.size(p) >= 2, F.concat(whole, p)).otherwise(whole)), 1)
    return F.when(F.rlike(token, F.lit(PLAIN_WORD)), whole).otherwise(split)


def tokenize(text: Column | str) -> Column:
    """Identifiers of a text in order, each expanded; a null text has none."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.flatten(F.transform(found, split_identifier))


def lines_of(text: Column | str) -> Column:
    """Lines with their ends; every character that ends a line in Unicode text counts.

    The pattern's dot stops at all of them but the controls, and is over ten times as fast as a class of characters; texts with such a control take the class.
    """
    text = F.coalesce(col(text), F.lit(""))

    def found(inside: str, ends: str) -> Column:
        return F.regexp_extract_all(text, F.lit(rf"{inside}++(?:\r\n|[{ends}])?+|\r\n|[{ends}]"), F.lit(0))

    controls = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in LINE_CONTROLS])
    return F.when(controls, found(f"[^{LINE_BREAKS}]", LINE_BREAKS)).otherwise(found(".", DOT_BREAKS))


def is_blank(text: Column | str) -> Column:
    """Whether a text is null or only white space."""
    return ~F.rlike(F.coalesce(col(text), F.lit("")), F.lit(r"(?U)\S"))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a character."""
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def looks_binary(text: Column | str) -> Column:
    """A NUL, or more than a tenth replacement characters, among the first characters."""
    sample = F.substring(F.coalesce(col(text), F.lit("")), 1, BINARY_SNIFF_CHARS)
    bad = count_of(sample, "�") / F.nullif(F.length(sample), F.lit(0))
    return F.contains(sample, F.lit("\x00")) | (F.coalesce(bad, F.lit(0.0)) > BINARY_RATIO)


def looks_minified(path: Column | str, text: Column | str) -> Column:
    """A name with ``.min.``, or very long lines on average."""
    sample = F.substring(F.coalesce(col(text), F.lit("")), 1, MINIFIED_SAMPLE_CHARS)
    return F.contains(F.lower(col(path)), F.lit(".min.")) | (
        F.length(sample) / (count_of(sample, "\n") + 1) > MINIFIED_LINE_LENGTH
    )


def is_symbol_query(query: Column | str) -> Column:
    """Whether a query is a bare or qualified identifier rather than words."""
    return F.rlike(F.trim(col(query)), F.lit(SYMBOL_QUERY))


def symbol_leaf(query: Column | str) -> Column:
    """What follows the last separator, of the first kind of separator that occurs."""
    query = col(query)
    leaf = F.trim(query)
    for separator in reversed(SEPARATORS):
        leaf = F.when(F.contains(query, F.lit(separator)), F.substring_index(query, separator, -1)).otherwise(leaf)
    return leaf


def query_keywords(query: Column | str) -> Column:
    """Distinct lower-cased words of a query that are longer than two letters and no stopwords."""
    words = F.regexp_extract_all(col(query), F.lit(IDENTIFIER), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    lowered = F.transform(words, F.lower)
    return F.array_distinct(F.filter(lowered, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def embedded_symbols(query: Column | str) -> Column:
    """Distinct camel-case identifiers among a query's words."""
    return F.array_distinct(F.regexp_extract_all(col(query), F.lit(EMBEDDED_SYMBOL), F.lit(0)))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def defines(content: Column | str, name: Column) -> Column:
    """Whether a text defines the name: a keyword, an optional qualification, the name and an end of it.

    The patterns start at every word and are compiled anew where the name changes, so they only see texts that hold the name, or words of SQL.
    """
    content = col(content)
    behind = F.concat(F.lit(r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*"), _quoted(name), F.lit(r"(?:\s|[<({:\[;]|$)"))
    general = F.concat(F.lit(r"(?md)(?:^|(?<=\s))(?:" + "|".join(DEFINITION_KEYWORDS)), behind)
    ddl = F.concat(F.lit(r"(?mdi)(?:^|(?<=\s))(?:" + "|".join(SQL_DEFINITION_KEYWORDS)), behind)
    has_ddl = F.contains(F.lower(content), F.lit(commonprefix(SQL_DEFINITION_KEYWORDS).lower()))
    return (F.contains(content, name) & F.rlike(content, general)) | (has_ddl & F.rlike(content, ddl))


def stem_matches(stem: Column, name: Column) -> Column:
    """Whether a file stem is the name, without underscores and plural endings."""
    plain = F.replace(stem, F.lit("_"), F.lit(""))
    ends = [F.regexp_replace(s, "s+$", "") for s in (stem, plain)]
    return (stem == name) | (plain == name) | (ends[0] == name) | (ends[1] == name)


def is_git_url(source: Column | str) -> Column:
    """Whether a source is a remote address rather than a path."""
    return F.rlike(col(source), F.lit(GIT_URL))


def display_name(source: Column | str) -> Column:
    """The last part of a path or address, without ``.git``; the whole source where that is empty."""
    source = col(source)
    last = F.element_at(F.split(F.regexp_replace(source, "/+$", ""), "/"), -1)
    named = F.when(is_git_url(source), F.regexp_replace(last, r"\.git$", "")).otherwise(last)
    return F.when(named == "", source).otherwise(named)


def infer_category(query: Column | str) -> Column:
    """symbol without a space inside, architecture for "how ...", else semantic."""
    query = col(query)
    return (
        F.when(~F.contains(F.trim(query), F.lit(" ")), "symbol")
        .when(F.startswith(F.lower(query), F.lit("how ")), "architecture")
        .otherwise("semantic")
    )


def approx_tokens(text: Column | str) -> Column:
    """A token estimate without a tokenizer: a third of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 3)).cast("long")


def truncate_to_budget(text: Column | str, budget: int) -> Column:
    """The longest prefix whose estimate stays within the budget."""
    return F.substring(col(text), 1, 3 * budget + 2)


def evaluation_keywords(query: Column | str) -> Column:
    """Words of a query to grep for: three letters or more, no stopwords, each once (ignoring case) in its first spelling."""
    words = F.regexp_extract_all(col(query), F.lit("[a-zA-Z][a-zA-Z0-9]*"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys([*STOPWORDS, *EVALUATION_STOPWORDS])])
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, F.lower(w)))

    def add(done: Column, word: Column) -> Column:
        known = F.exists(done, lambda d: F.lower(d) == F.lower(word))
        return F.when(known, done).otherwise(F.concat(done, F.array(word)))

    return F.aggregate(kept, F.array().cast("array<string>"), add)


def token_counter(tokenizer: str | None = None):
    """A column function that counts tokens: exactly, with a tokenizer file that every executor can read, else by estimate."""
    if tokenizer is None:
        return approx_tokens
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.types import LongType

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(tokenizer)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in loaded.encode_batch(texts.fillna("").tolist())], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    count = F.pandas_udf(run, LongType())
    return lambda text: count(col(text))

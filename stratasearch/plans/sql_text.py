"""SQL (DuckDB) forms of the expressions, from which the registered queries' comparison SQL is put together."""

from __future__ import annotations

from ..functions.languages import extension_table
from ..functions.paths import COMPAT_DIRECTORY, EXAMPLES_DIRECTORY, REEXPORT_NAMES, TEST_DIRECTORY, TEST_FILE, TYPE_STUB
from ..functions.text import (
    DEFINITION_KEYWORDS,
    EMBEDDED_SYMBOL,
    IDENTIFIER,
    LINE_BREAKS,
    SEPARATORS,
    SQL_DEFINITION_KEYWORDS,
    STOPWORDS,
    SYMBOL_QUERY,
)


def quote(x) -> str:
    """A literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}e0"
    if isinstance(x, int):
        return str(x)
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x00", "' || chr(0) || '") + "'"


def values(name: str, columns: str, rows) -> str:
    """A common table of literal rows."""
    body = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def stop_list() -> str:
    return "[" + ", ".join(map(quote, STOPWORDS)) + "]"


def split_identifier(t: str) -> str:
    camel = (
        f"list_transform(regexp_extract_all(regexp_replace({t}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), "
        f"'[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
    )
    snake = f"list_filter(string_split(lower({t}), '_'), lambda p: p <> '')"
    parts = f"CASE WHEN contains({t}, '_') THEN {snake} ELSE {camel} END"
    return f"CASE WHEN len({parts}) >= 2 THEN list_concat([lower({t})], {parts}) ELSE [lower({t})] END"


def tokenize(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '{IDENTIFIER}'), lambda t: {split_identifier('t')}))"


def name_of(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def suffix_of(path: str) -> str:
    return f"regexp_extract({name_of(path)}, '^\\.*[^.].*?(\\.[^.]+)$', 1)"


def stem_of(path: str) -> str:
    return f"left({name_of(path)}, length({name_of(path)}) - length({suffix_of(path)}))"


def parent_of(path: str) -> str:
    return f"regexp_extract({path}, '([^/]+)/[^/]*$', 1)"


def directories(path: str) -> str:
    parts = f"list_filter(string_split({path}, '/'), lambda s: s <> '' AND s <> '.')"
    return f"array_to_string(list_slice({parts}, greatest(len({parts}) - 3, 1), len({parts}) - 1), ' ')"


def index_tokens(content: str, path: str) -> str:
    stem = tokenize(stem_of(path))
    return f"list_concat(list_concat({tokenize(content)}, {stem}), list_concat({stem}, {tokenize(directories(path))}))"


def is_symbol(q: str) -> str:
    return f"regexp_matches(trim({q}), {quote(SYMBOL_QUERY)})"


def leaf(q: str) -> str:
    cases = " ".join(f"WHEN contains({q}, {quote(s)}) THEN string_split({q}, {quote(s)})[-1]" for s in SEPARATORS)
    return f"CASE {cases} ELSE trim({q}) END"


def keywords(q: str) -> str:
    words = f"list_transform(regexp_extract_all({q}, '{IDENTIFIER}'), lambda w: lower(w))"
    return f"list_distinct(list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains({stop_list()}, w)))"


def embedded(q: str) -> str:
    return f"list_distinct(regexp_extract_all({q}, {quote(EMBEDDED_SYMBOL)}))"


def defines(content: str, name: str) -> str:
    behind = (
        f"')\\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*' || regexp_escape({name}) || '(?:\\s|[<({{:\\[;]|$)'"
    )
    general = f"regexp_matches({content}, '(?m)(?:^|\\s)(?:{'|'.join(DEFINITION_KEYWORDS)}' || {behind})"
    ddl = f"regexp_matches({content}, '(?mi)(?:^|\\s)(?:{'|'.join(SQL_DEFINITION_KEYWORDS)}' || {behind})"
    return f"({general} OR {ddl})"


def stem_matches(stem: str, name: str) -> str:
    plain = f"replace({stem}, '_', '')"
    return f"({stem} = {name} OR {plain} = {name} OR rtrim({stem}, 's') = {name} OR rtrim({plain}, 's') = {name})"


def keyword_matches(kw: str, parts: str) -> str:
    near = "k = p OR (least(length(k), length(p)) >= 3 AND (starts_with(k, p) OR starts_with(p, k)))"
    return f"len(list_filter({kw}, lambda k: len(list_filter({parts}, lambda p: {near})) > 0))"


def path_parts(path: str) -> str:
    parent = parent_of(path)
    return (
        f"list_concat({split_identifier(stem_of(path))}, "
        f"CASE WHEN {parent} IN ('', '.', '..') THEN CAST([] AS VARCHAR[]) ELSE {split_identifier(parent)} END)"
    )


def penalty(path: str) -> str:
    plain = f"replace({path}, '\\', '/')"

    def factor(condition: str, x: str) -> str:
        return f"(CASE WHEN {condition} THEN {x} ELSE 1e0 END)"

    names = ", ".join(map(quote, REEXPORT_NAMES))
    return " * ".join(
        [
            factor(f"regexp_matches({plain}, {quote(TEST_FILE)}) OR regexp_matches({plain}, {quote(TEST_DIRECTORY)})", "0.3e0"),
            factor(f"{name_of(path)} IN ({names})", "0.5e0"),
            factor(f"regexp_matches({plain}, {quote(COMPAT_DIRECTORY)})", "0.3e0"),
            factor(f"regexp_matches({plain}, {quote(EXAMPLES_DIRECTORY)})", "0.3e0"),
            factor(f"regexp_matches({plain}, {quote(TYPE_STUB)})", "0.7e0"),
        ]
    )


def same_file(a: str, b: str) -> str:
    return f"({a} = {b} OR ends_with({a}, '/' || {b}) OR ends_with({b}, '/' || {a}))"


#: The documents as files of repositories.
PATHS = (
    "src/{lang}/doc_{id}.py", "tests/test_doc_{id}.py", "src/compat/doc_{id}.py", "examples/doc_{id}.py",
    "src/pkg_{id}/__init__.py", "types/doc_{id}.d.ts", "src/doc_{id}_test.go", "docs_src/doc_{id}.md",
)


def _path_case() -> str:
    cases = []
    for k, path in enumerate(PATHS):
        parts = path.replace("{lang}", "' || lang || '").replace("{id}", "' || doc_id || '")
        cases.append(f"WHEN {k} THEN '{parts}'")
    return f"CASE doc_id % {len(PATHS)} {' '.join(cases)} END"


FILES = f"files AS (SELECT doc_id, source AS repo_id, {_path_case()} AS file_path, lang AS language, coalesce(text, '') AS content FROM documents)"
UNITS = f"{FILES}, units AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS chunk_id, * FROM files)"
TOKENS = f"{UNITS}, tok AS (SELECT chunk_id, repo_id, {index_tokens('content', 'file_path')} AS tokens FROM units)"
LINE_PATTERN = rf"[^{LINE_BREAKS}]*(?:\r\n|[{LINE_BREAKS}])|[^{LINE_BREAKS}]+"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def chunked(desired: int = 1500, most: int = 12_000) -> str:
    """Common tables up to ``pieces``: doc_id, repo_id, file_path, language, start, end, content, start_line, end_line. Needs RECURSIVE."""
    return f"""{FILES},
    split AS (SELECT doc_id, regexp_extract_all(content, '{LINE_PATTERN}') AS ls FROM files WHERE regexp_matches(content, '\\S')),
    line AS (SELECT doc_id, i, length(ls[i]) AS n FROM split, unnest(range(1, len(ls) + 1)) AS u(i)),
    walk(doc_id, i, pos, n) AS (
      SELECT doc_id, i, CAST(0 AS BIGINT), n FROM line WHERE i = 1
      UNION ALL
      SELECT l.doc_id, l.i, CASE WHEN w.n + l.n > {desired} THEN w.pos + w.n ELSE w.pos END, CASE WHEN w.n + l.n > {desired} THEN l.n ELSE w.n + l.n END
      FROM walk w JOIN line l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
    packed AS (SELECT doc_id, pos, max(n) AS n FROM walk GROUP BY doc_id, pos),
    cut AS (SELECT doc_id, pos + k AS s, least(pos + k + {most}, pos + n) AS e FROM packed, unnest(range(0, n, {most})) AS u(k)),
    pieces AS (
      SELECT f.doc_id, f.repo_id, f.file_path, f.language, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end",
        substring(f.content, s + 1, e - s) AS content,
        CAST(1 + {newlines("left(f.content, s)")} AS INTEGER) AS start_line,
        CAST(1 + {newlines("left(f.content, greatest(e - 1, s))")} AS INTEGER) AS end_line
      FROM cut c JOIN files f USING (doc_id))"""


CHUNK_ID = "left(sha256(repo_id || ':' || file_path || ':' || start_line || ':' || end_line || ':' || left(sha256(content), 32)), 32)"


def bm25(tokens: str = "tok", queries: str = "q", name: str = "bm") -> str:
    """Common tables up to ``name``: query_id, chunk_id, repo_id, score. ``queries``: query_id, query."""
    return f"""
    {name}_st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tokens)) AS avgdl FROM {tokens}),
    {name}_p AS (SELECT token, chunk_id, repo_id, dl, count(*) AS tf FROM (SELECT unnest(tokens) AS token, chunk_id, repo_id, len(tokens) AS dl FROM {tokens}) GROUP BY ALL),
    {name}_df AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
    {name}_q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({tokenize('query')}) AS token FROM {queries}) GROUP BY ALL),
    {name} AS (SELECT query_id, chunk_id, repo_id, round(sum(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.5e0
        / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) AS score
      FROM {name}_p JOIN {name}_q USING (token) JOIN {name}_df USING (token), {name}_st GROUP BY ALL)"""


def top(source: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source} WHERE score > 0)
      WHERE rank <= {k})"""


def hash_encode(source: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """Common tables up to ``name``: key, vector (unit length, doubles)."""
    h = "CAST('0x' || left(md5(token), 8) AS BIGINT)"
    return f"""
    {name}_t AS (SELECT {key}, token, count(*) AS c FROM (SELECT {key}, unnest({tokenize(text)}) AS token FROM {source}) GROUP BY ALL),
    {name}_b AS (SELECT {key}, {h} % {dim} AS b, CAST(sum(c * (1 - 2 * (({h} // {dim}) % 2))) AS DOUBLE) AS x FROM {name}_t GROUP BY ALL),
    {name}_d AS (SELECT {key}, b, x FROM {name}_b UNION ALL SELECT {key}, k, 0e0 FROM {source}, unnest(range(0, {dim})) AS u(k)),
    {name}_v AS (SELECT {key}, list(x ORDER BY b) AS v FROM (SELECT {key}, b, sum(x) AS x FROM {name}_d GROUP BY ALL) GROUP BY {key}),
    {name} AS (SELECT {key}, list_transform(v, lambda y: y / CASE WHEN sqrt(list_inner_product(v, v)) <= 1e-9 THEN 1e0 ELSE sqrt(list_inner_product(v, v)) END) AS vector FROM {name}_v)"""


def fused(dense: str, sparse: str, queries: str, name: str) -> str:
    """``name``: query_id, chunk_id, score from two ranked tables (with rank)."""
    return f"""{name} AS (SELECT query_id, chunk_id,
        (CASE WHEN {is_symbol('query')} THEN 0.3e0 ELSE 0.5e0 END) * coalesce(1e0 / (60 + d.rank), 0)
        + (1e0 - (CASE WHEN {is_symbol('query')} THEN 0.3e0 ELSE 0.5e0 END)) * coalesce(1e0 / (60 + s.rank), 0) AS score
      FROM (SELECT query_id, chunk_id, rank FROM {dense}) d FULL JOIN (SELECT query_id, chunk_id, rank FROM {sparse}) s USING (query_id, chunk_id)
      JOIN {queries} USING (query_id))"""


_REPO, _FILE = "PARTITION BY query_id, repo_id", "PARTITION BY query_id, repo_id, file_path"


def coherent(source: str, name: str) -> str:
    return f"""
    {name}_a AS (SELECT *, max(score) OVER ({_REPO}) AS best, sum(score) OVER ({_FILE}) AS fsum,
        row_number() OVER ({_FILE} ORDER BY score DESC, chunk_id) AS place FROM {source}),
    {name}_b AS (SELECT *, max(fsum) OVER ({_REPO}) AS tsum FROM {name}_a),
    {name} AS (SELECT * EXCLUDE (best, fsum, place, tsum, score),
        CASE WHEN place = 1 AND best <> 0 THEN score + 0.2e0 * best * fsum / nullif(tsum, 0) ELSE score END AS score FROM {name}_b)"""


def definition_gain(names: str, unit: str) -> str:
    stem = f"lower({stem_of('file_path')})"
    return (
        f"(CASE WHEN len(list_filter({names}, lambda n: {defines('content', 'n')})) > 0 THEN {unit} * "
        f"(CASE WHEN len(list_filter({names}, lambda n: {stem_matches(stem, 'lower(n)')})) > 0 THEN 1.5e0 ELSE 1e0 END) ELSE 0e0 END)"
    )


def stem_gain(unit: str) -> str:
    kw = keywords("query")
    ratio = f"({keyword_matches(kw, path_parts('file_path'))} / CAST(nullif(len({kw}), 0) AS DOUBLE))"
    return f"(CASE WHEN coalesce({ratio}, 0) >= 0.10e0 THEN {unit} * {ratio} ELSE 0e0 END)"


def boosted(source: str, name: str) -> str:
    symbol = definition_gain(f"[{leaf('query')}, trim(query)]", "best * 3e0")
    words = f"{stem_gain('best')} + {definition_gain(embedded('query'), 'best * 1.5e0')}"
    return f"""
    {name}_a AS (SELECT *, max(score) OVER ({_REPO}) AS best FROM {source}),
    {name} AS (SELECT * EXCLUDE (best, score), score + CASE WHEN {is_symbol('query')} THEN {symbol} ELSE {words} END AS score FROM {name}_a)"""


def penalized(source: str, name: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE (score), score * {penalty('file_path')} AS score FROM {source})"


def saturated(source: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (score), score * pow(0.5e0, row_number() OVER ({_FILE} ORDER BY round(score, 9) DESC, chunk_id) - 1) AS score
      FROM {source})"""


def merged(source: str, k: int, name: str) -> str:
    return f"""
    {name}_a AS (SELECT * EXCLUDE (score), round(score, 9) AS score FROM {source}),
    {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {name}_a) WHERE rank <= {k})"""


def ranked(source: str, k: int, name: str, boosts: bool = True) -> str:
    """The whole ranking, up to ``name``."""
    steps = [coherent(source, "r1"), boosted("r1", "r2")] if boosts else []
    last = "r2" if boosts else source
    return ",".join([*steps, penalized(last, "r3"), saturated("r3", "r4"), merged("r4", k, name)])


def extension_values() -> str:
    return values("ext", "extension, language", sorted(extension_table().items()))

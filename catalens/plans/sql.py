"""Pieces of DuckDB SQL that the registered queries are compared with."""

from __future__ import annotations

import unicodedata

from catalens.model import SearchOptions
from catalens.plans.query import parse, scoring_cap

ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BASENAME = "string_split(rtrim(path, '/'), '/')[-1]"
EXTENSION = f"CASE WHEN regexp_full_match({BASENAME}, '(?s).+\\.[^.]*') AND {BASENAME} <> '..' THEN regexp_extract({BASENAME}, '(?s)^.+\\.([^.]*)$', 1) END"
_HIDDEN = f"regexp_extract({BASENAME}, '^\\.([^.]+)', 1)"
HIDDEN = f"CASE WHEN {_HIDDEN} <> '' AND {_HIDDEN} IS DISTINCT FROM {EXTENSION} THEN {_HIDDEN} END"
TIME = "CASE WHEN floor(last_modified / 1000000) BETWEEN -62135596800 AND 253402300799 THEN strftime(make_timestamp(last_modified // 1000000 * 1000000), '%y-%m-%d %H:%M:%S') ELSE 'N/A' END"
NEWEST = "WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM fs_oplog) WHERE rn = 1)\n"
PRERANK = "(kind = 1) DESC, least(length(path) - length(replace(path, '/', '')), 255), greatest(last_modified // 1000000, coalesce(last_accessed, 0) // 1000000) DESC, path"


def alive(where: str = "") -> str:
    """CTEs up to ``alive``: the ops that no prefix delete kills."""
    return f"""
WITH t AS (SELECT volume, {ASCII.format('prefix')} AS prefix, max(seq) AS seq FROM fs_tombstones {where} GROUP BY ALL),
lens AS (SELECT DISTINCT length(prefix) AS n FROM t),
pairs AS (SELECT DISTINCT path, volume FROM fs_oplog),
cuts AS (SELECT path, volume, substr({ASCII.format('path')}, 1, n) AS pre FROM pairs, lens WHERE length(path) = n OR substr(path, n + 1, 1) = '/'),
kills AS (SELECT c.path, c.volume, max(t.seq) AS k FROM cuts c JOIN t ON t.prefix = c.pre AND (t.volume IS NULL OR t.volume = c.volume) GROUP BY ALL),
alive AS (SELECT o.* FROM fs_oplog o LEFT JOIN kills USING (path, volume) WHERE k IS NULL OR o.seq >= k)
"""


LIVE = alive().rstrip() + """,
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM alive) WHERE rn = 1 AND NOT is_delete)
"""

_CJK = "\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}"
_BETWEEN = (("(\\p{Ll})(\\p{Lu})", "\\1 \\2"), ("(\\p{L})(\\p{N})", "\\1 \\2"), ("(\\p{N})(\\p{L})", "\\1 \\2"), (f"([{_CJK}])", " \\1 "))


def _mapped(column: str, table: str) -> str:
    return f"list_reduce(list_transform(string_split({column}, ''), lambda c: coalesce({table}[c], c)), lambda a, b: a || b)"


#: Compatibility characters and their plain form, by the rule of Unicode, for the blocks in which they are.
_NFKC = {c: unicodedata.normalize("NFKC", c) for a, z in ((0xA0, 0x250), (0x2000, 0x2400), (0x2460, 0x2500), (0x3000, 0x3001), (0x3130, 0x3400), (0xFB00, 0xFB07), (0xFE30, 0xFFEF)) for c in map(chr, range(a, z)) if unicodedata.normalize("NFKC", c) != c}
_NFKC_MAP = "MAP {" + ", ".join(f"'{c}': " + "'" + v.replace("'", "''") + "'" for c, v in _NFKC.items()) + "}"


def folded(column: str) -> str:
    """Decomposed, without accents, in lower case; Hangul by the arithmetic of its block."""
    s = "(ord(c) - 44032)"
    jamo = f"chr(CAST(4352 + {s} // 588 AS INTEGER)) || chr(CAST(4449 + {s} % 588 // 28 AS INTEGER)) || CASE WHEN {s} % 28 > 0 THEN chr(CAST(4519 + {s} % 28 AS INTEGER)) ELSE '' END"
    return f"list_reduce(list_transform(string_split(lower(strip_accents({column})), ''), lambda c: CASE WHEN ord(c) BETWEEN 44032 AND 55203 THEN {jamo} ELSE c END), lambda a, b: a || b)"


def tokens(column: str, nfkc: str = "m") -> str:
    """The tokens of a text, a list sorted by bytes; ``nfkc`` is the column that holds the map of :data:`NFKC`."""
    t = f"nfc_normalize({_mapped(column, nfkc)})"
    letters = f"[{_CJK}]+"
    pieces = "t"
    for pattern, to in _BETWEEN:
        pieces = f"regexp_replace({pieces}, '{pattern}', '{to}', 'g')"
    split = lambda x: f"string_split_regex({x}, '[^\\p{{L}}\\p{{N}}]+')"
    whole = f"regexp_replace(t, '({letters})', ' \\1 ', 'g')"
    runs = f"list_filter({split(whole)}, lambda r: regexp_full_match(r, '{letters}'))"
    endings = f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r) + 1), lambda i: substr(r, CAST(i AS INTEGER)))))"
    every = f"list_concat(list_concat({split(whole)}, {split(pieces)}), {endings})"
    return f"(SELECT coalesce(list_sort(list_distinct(list_transform(list_filter({every}, lambda x: x <> ''), lambda x: {folded('x')}))), []) FROM (SELECT {t} AS t))"


NFKC = f"m AS (SELECT {_NFKC_MAP} AS m)"


def all_terms(source: str) -> str:
    """A query for ``term, path``: all that entries of a table with distinct paths are indexed under."""
    name = f"{BASENAME}"
    return f"""SELECT DISTINCT unnest(list_filter(list_concat({tokens('path')}, [
  CASE WHEN volume <> '' THEN chr(1) || lower(volume) END, chr(2) || lower({EXTENSION}), chr(2) || lower({HIDDEN}),
  CASE WHEN contains({name}, '.') AND regexp_matches({name}, '^[\\p{{L}}\\p{{N}}]') THEN {folded(name)} END]), lambda x: x IS NOT NULL)) AS term, path FROM {source}, m"""


def terms(source: str, first: str = "WITH") -> str:
    """CTEs up to ``terms(path, term)``."""
    return f"{first} {NFKC},\nterms AS (SELECT path, unnest({tokens('path')}) AS term FROM {source}, m)\n"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _wide(column: str) -> str:
    """Bytes of a text whose Hangul is decomposed."""
    return f"(strlen({column}) + coalesce(list_sum(list_transform(string_split({column}, ''), lambda c: CASE WHEN ord(c) BETWEEN 44032 AND 55203 THEN CASE WHEN (ord(c) - 44032) % 28 = 0 THEN 3 ELSE 6 END ELSE 0 END)), 0))"


def _score(text: str, now: int) -> str:
    """The score as an expression over ``s`` (folded path), ``p`` (without trailing separators), ``fs`` (begin of the
    name) and the columns of an entry, with the default weights."""
    q = parse(text)
    alnum = "'[\\p{L}\\p{N}]'"
    best, named, hits, finds = [], [], [], []
    for t in q.tokens:
        lit, n = _text(t), len(t)
        at = f"list_filter(range(0, length(p) - {n} + 1), lambda i: substr(p, CAST(i AS INTEGER) + 1, {n}) = {lit})"
        starts = f"(i = 0 OR NOT regexp_full_match(substr(p, CAST(i AS INTEGER), 1), {alnum}))"
        rest = f"substr(p, CAST(i AS INTEGER) + 1 + {n})"
        value = f"CASE WHEN NOT {starts} THEN CASE WHEN i >= fs THEN 0.5 ELSE 0.4 END * 0.8 WHEN i = fs THEN CASE WHEN {rest} = '' THEN 1.0 WHEN starts_with({rest}, '.') THEN 0.9 ELSE 0.7 END WHEN i > fs THEN 0.5 ELSE 0.4 END"
        top = f"coalesce(list_max(list_transform({at}, lambda i: CAST({value} AS DOUBLE))), 0.0)"
        hits.append(at)
        named.append(f"(length(p) - {n} = fs AND ends_with(p, {lit}))")
        if any(len(r) > n and r.endswith("." + t) for r in q.raw):
            best.append(f"CASE WHEN ends_with(p, {_text('.' + t)}) THEN greatest({top}, 0.9) ELSE {top} END")
            named.append(f"ends_with(p, {_text('.' + t)})")
        elif len(q.tokens) == 1:
            best.append(f"{top} * CASE WHEN ends_with(p, {_text('.' + t)}) THEN 0.5 ELSE 1.0 END")
        else:
            best.append(top)
        finds.append(f"CASE WHEN contains(s, {lit}) THEN {{'a': {_wide(f'substr(s, 1, instr(s, {lit}) - 1)')}, 'n': {len(t.encode())}}} END")
    whole = "".join(q.tokens)
    bare = "regexp_replace(substr(p, CAST(fs AS INTEGER) + 1), '[^\\p{L}\\p{N}]', '', 'g')"
    exact = f"({bare} = {_text(whole)} OR {bare} = {_text(whole[:-1])})"
    base = f"CASE WHEN {exact} THEN 1.0 ELSE ({' + '.join(best)}) / {len(q.tokens)}.0 END * 100.0"
    words = "len(list_filter(string_split_regex(p, '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"
    distinct = hits[0] if len(hits) == 1 else f"list_concat({', '.join(hits)})"
    cover = f"CASE WHEN {exact} OR {' OR '.join(named)} OR {words} = 0 THEN 1.0 ELSE 0.5 + 0.5 * least(len(list_distinct({distinct})) / least({words}, 8.0), 1.0) END"
    age = f"1 + (CAST(1.2 AS DOUBLE) - 1) * exp(-0.1 * greatest(({now} - greatest(last_modified, coalesce(last_accessed, 0))) / 86400000000.0, 0))"
    kind = "CASE kind WHEN 1 THEN 1.1 WHEN 0 THEN 1.0 ELSE 0.9 END"
    near = "1.0"
    if len(q.tokens) > 1:
        got = f"list_filter([{', '.join(finds)}], lambda x: x IS NOT NULL)"
        span = f"(list_max(list_transform({got}, lambda x: x.a + x.n)) - list_min(list_transform({got}, lambda x: x.a)))"
        near = f"CASE WHEN len({got}) > 1 THEN 1 + (CAST(1.15 AS DOUBLE) - 1) * least(list_sum(list_transform({got}, lambda x: x.n)) / {span}, 1.0) ELSE 1.0 END"
    order = "1.0"
    if len(q.raw) > 1:
        parts = [w for r in q.raw for w in r.strip(".").split(".")]
        order = f"CASE WHEN regexp_matches(s, '(?s){'.*'.join(parts)}') THEN 1.05 ELSE 1.0 END"
    marked = " + ".join(["1.0", *(f"CASE WHEN contains(s, {_text(r)}) THEN 1.0 ELSE 0.0 END" for r in q.raw if not r.isalnum())])
    return f"({base}) * ({cover}) * ({age}) * ({kind}) * ({near}) * ({order}) * ({marked})"


def search(text: str, limit: int, offset: int, now: int, where: str = "TRUE", score: str | None = None) -> str:
    """A search."""
    q = parse(text)
    tests = []
    for t in q.tokens:
        if t.startswith("\x02"):
            ext = _text(t[1:])
            tests.append(f"SELECT path FROM live WHERE lower({EXTENSION}) = {ext} OR lower({HIDDEN}) = {ext}")
        else:
            tests.append(f"SELECT path FROM terms WHERE starts_with(term, {_text(t)})")
    cap = scoring_cap(limit, offset, SearchOptions())
    return (
        LIVE.rstrip() + terms("live", ",").rstrip() + f""",
hit AS ({' INTERSECT '.join(tests)}),
cand AS (SELECT * FROM live WHERE path IN (SELECT path FROM hit) AND {where} ORDER BY {PRERANK} LIMIT {cap}),
folded AS (SELECT *, {folded('path')} AS s, rtrim({folded('path')}, '/') AS p FROM cand),
ready AS (SELECT *, length(p) - length(string_split(p, '/')[-1]) AS fs FROM folded),
scored AS (SELECT *, {score or _score(text, now)} AS exact FROM ready)
SELECT path, volume, volume_type, kind, last_modified, last_accessed, category, round(exact, 6) AS score
FROM scored ORDER BY exact DESC, last_modified DESC, kind, path LIMIT {limit} OFFSET {offset}"""
    )

"""Queries of the problems on text, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalens.llm import leaks, line_ledger, lookalike, mixing, pii, term_counts, term_weight
from catalens.plans.pipeline import in_order
from catalens.session import run_dir, written
from catalens.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_weight.distinctive(table(spark, d, "fs_postings")).select("entry_id", "term")


def p2_weights(spark: SparkSession, d: str) -> DataFrame:
    return term_weight.term_weights(table(spark, d, "fs_postings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(table(spark, d, "fs_postings")).where("mark is not null").select("term", "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(table(spark, d, "fs_postings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(table(spark, d, "fs_entries"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(table(spark, d, "fs_entries")).select("entry_id", "c_volume", "c_path")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.members(table(spark, d, "fs_entries"))


def _ledger(spark: SparkSession, d: str, batches: int = 3) -> tuple[line_ledger.LineLedger, DataFrame]:
    """The ledger after the lines came in some batches, each joined to what the ledger holds, and the lines' keys."""
    keys = written(line_ledger.keyed(table(spark, d, "entry_lines")), "keys")
    ledger = line_ledger.LineLedger(spark, run_dir(spark, "p5"))
    for part in in_order(keys, "line_id", batches):
        ledger.add_keyed(part)
    return ledger, keys


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ledger, keys = _ledger(spark, d)
    return ledger.copies_keyed(keys)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)[0].rows().select("key", "lines", "keep_id")


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same of five batches."""
    return _ledger(spark, d, 5)[0].rows().select("key", "lines", "keep_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where(f"exact_words >= {leaks.SPAN}").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_chars(spark: SparkSession, d: str) -> DataFrame:
    """Shares in characters, a size that the table has."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars")


def p8_fitted(spark: SparkSession, d: str) -> DataFrame:
    """The same for the largest total at which all sources with documents reach their shares."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars", fit=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"))


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"))


_TF = """
WITH occ AS (SELECT DISTINCT term, entry_id, coalesce(pos, -1) AS pos FROM fs_postings WHERE term <> '' AND entry_id IS NOT NULL),
tf AS (SELECT term, entry_id, count(*) AS tf FROM occ GROUP BY ALL),
t AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS gf, greatest(ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf), 0) AS h FROM tf GROUP BY ALL),
n AS (SELECT count(DISTINCT entry_id) AS n FROM tf)
"""
_COUNTS = _TF + """, c AS (SELECT term, gf AS occurrences, df AS entries,
CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.1 * n THEN 'common' END AS mark FROM t, n)
"""
_FIELD = r"regexp_extract(line, '(?is)(?:^|[^\p{{L}}\p{{N}}]){0}[\"'']?\s*[:=](.*?)(?:(?:^|[^\p{{L}}\p{{N}}])(?:{1})[\"'']?\s*[:=]|\z)', 1)"
_WORDS = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
_KEYS = "WITH k AS (SELECT line_id, concat(" + ", chr(1), ".join(_WORDS.format(_FIELD.format(n, "|".join(m for m in line_ledger.FIELDS if m != n))) for n in line_ledger.FIELDS) + ") AS key FROM entry_lines WHERE line IS NOT NULL),\n"
_KEYS += "g AS (SELECT key, count(*) AS lines, min(line_id) AS keep_id FROM k GROUP BY ALL)\n"

_RUNS = "SELECT {0}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL)"

_MIX = f"""
WITH t AS (SELECT source, sum(greatest(coalesce(target_share, 0), 0)) AS share, greatest(max(coalesce(max_copies, 1)), 0) AS copies FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT source, share / sum(share) OVER () AS share, copies FROM t),
r AS (SELECT source, coalesce(lag(z) OVER (ORDER BY z, source), 0.0) AS a, z FROM (SELECT source, CASE WHEN sum(share) OVER (ORDER BY source) >= sum(share) OVER () THEN 1.0 ELSE sum(share) OVER (ORDER BY source) END AS z FROM g WHERE share > 0)),
c AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS available FROM documents SEMI JOIN g USING (source) WHERE doc_id IS NOT NULL AND n_chars > 0 GROUP BY source),
n AS (SELECT {{0}} AS total, {mixing.BLOCK_TOKENS} AS b),
p AS (SELECT (i + 0.5::DOUBLE) * {mixing.GOLDEN}::DOUBLE % 1 AS x FROM n, unnest(range(0, CAST((total + b - 1) // b AS BIGINT))) AS s(i)),
s AS (SELECT source, count(*) AS slots FROM p JOIN r ON r.a <= p.x AND p.x < r.z GROUP BY source),
u AS (SELECT source, least(slots, (available + b - 1) // b * copies) AS used, (available + b - 1) // b AS blocks, available, b FROM s JOIN c USING (source) JOIN g USING (source), n),
f AS (SELECT source, CAST(used // blocks * available + used % blocks * b AS BIGINT) AS got, CAST(used AS BIGINT) AS used, CAST((used + blocks - 1) // blocks AS BIGINT) AS most FROM u WHERE used > 0)
SELECT source, share AS target_share, copies AS max_copies, CAST(round(share * total) AS BIGINT) AS target_tokens, coalesce(got, 0) AS selected_tokens, coalesce(used, 0) AS selected_blocks, coalesce(most, 0) AS most_copies,
coalesce(got, 0) / total AS share_of_total, coalesce(got, 0) / sum(got) OVER () AS reached_share FROM g LEFT JOIN f USING (source), n"""
_W = "(SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL)"
_KEY = lambda mask: "concat_ws(' ', " + ", ".join(f"w[i + {k + 1}]" for k, on in enumerate(mask) if on == "1") + ")"
_WINDOWS = lambda key, source: " UNION ALL ".join(f"SELECT {key}, {m} AS m, unnest(list_transform(range(0, len(w) - {leaks.SPAN - 1}), lambda i: {{'p': i, 'k': {_KEY(mask)}}}), recursive := true) FROM {source}" for m, mask in enumerate(leaks.MASKS))
_LEAKS = f"""
WITH dw AS {_W.format('doc_id', 'documents')}, iw AS {_W.format('item_id', 'eval_items')},
hits AS (SELECT DISTINCT doc_id, item_id, d.p - i.p AS g FROM ({_WINDOWS('doc_id', 'dw')}) d JOIN ({_WINDOWS('item_id', 'iw')}) i ON d.m = i.m AND d.k = i.k),
cells AS (SELECT doc_id, item_id, g, greatest(0, -g) AS a, unnest(list_transform(range(greatest(0, -g), least(len(iw.w), len(dw.w) - g)), lambda j: {{'k': j - greatest(0, -g) + 1, 'eq': iw.w[j + 1] = dw.w[j + g + 1]}}), recursive := true) FROM hits JOIN dw USING (doc_id) JOIN iw USING (item_id)),
sums AS (SELECT *, sum(CASE WHEN eq THEN 1 ELSE -{leaks.MISMATCH} END) OVER v AS t, k - sum(CASE WHEN eq THEN 1 ELSE 0 END) OVER v AS island FROM cells WINDOW v AS (PARTITION BY doc_id, item_id, g ORDER BY k)),
runs AS (SELECT doc_id, item_id, g, max(n) AS exact_words FROM (SELECT doc_id, item_id, g, island, count(*) FILTER (eq) AS n FROM sums GROUP BY ALL) GROUP BY ALL),
lows AS (SELECT *, least(0, coalesce(min(t) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM sums WINDOW v AS (PARTITION BY doc_id, item_id, g ORDER BY k)),
starts AS (SELECT *, least(before, t) AS low, coalesce(max(CASE WHEN t < before THEN k END) OVER (PARTITION BY doc_id, item_id, g ORDER BY k), 0) AS start FROM lows),
best AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY t - low DESC, k) = 1)
SELECT doc_id, item_id, k - start AS words, exact_words, a + start + g AS doc_start, a + start AS item_start FROM best JOIN runs USING (doc_id, item_id, g) WHERE k - start >= {leaks.SPAN}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY exact_words DESC, words DESC, doc_start, item_start) = 1"""

_SHOWN = "MAP {" + ", ".join(f"'{c}': " + "'" + v.replace("'", "''") + "'" for c, v in lookalike.shown_as().items()) + "}"
_LOOK = "nfc_normalize(list_reduce(list_transform(string_split(concat(volume, '/', path), ''), lambda c: coalesce(m[c], c)), lambda a, b: a || b))"
_LOOKS = f"WITH shown AS (SELECT {_SHOWN} AS m), l AS (SELECT entry_id, concat(volume, '/', path) AS text, {_LOOK} AS look FROM fs_entries, shown)\n"

QUERIES = {"p2_found": p2_found, "p2_weights": p2_weights, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_canonical": p4_canonical, "p4_classes": p4_classes, "p5_found": p5_found, "p5_records": p5_records, "p5_batches": p5_batches, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_chars": p8_chars, "p8_fitted": p8_fitted, "p9_found": p9_found, "p9_masked": p9_masked}
SQL = {
    "p4_found": _LOOKS + "SELECT a.entry_id AS entry_id_a, b.entry_id AS entry_id_b FROM l a JOIN l b ON a.look = b.look AND a.text <> b.text AND a.entry_id < b.entry_id",
    "p4_classes": _LOOKS + ", c AS (SELECT look, min(entry_id) AS class_id, count(DISTINCT text) AS spellings FROM l GROUP BY look HAVING count(DISTINCT text) > 1) SELECT entry_id, class_id, spellings FROM l JOIN c USING (look)",
    "p2_found": _TF + "SELECT entry_id, term FROM tf JOIN t USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 20",
    "p2_weights": _TF + "SELECT entry_id, term, tf, df, gf, log2(1 + tf) * (1 - h / ln(n)) AS weight FROM tf JOIN t USING (term), n",
    "p3_found": _COUNTS + "SELECT term, mark FROM c WHERE mark IS NOT NULL",
    "p3_counts": _COUNTS + "SELECT * FROM c",
    "p7_found": f"WITH d AS ({_RUNS.format('doc_id', 'documents')}), i AS (SELECT DISTINCT * FROM ({_RUNS.format('item_id', 'eval_items')})) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
    "p7_leaks": _LEAKS,
    "p8_chars": _MIX.format("CAST((SELECT sum(available) FROM c) AS BIGINT)"),
    "p8_fitted": _MIX.format("CAST(least((SELECT sum(available) FROM c), (SELECT min(floor(available * copies / share)) FROM c JOIN g USING (source) WHERE share > 0 AND copies > 0)) AS BIGINT)"),
    "p5_found": _KEYS + "SELECT keep_id, line_id FROM k JOIN g USING (key) WHERE line_id <> keep_id",
    "p5_records": _KEYS + "SELECT key, lines, keep_id FROM g",
    "p5_batches": _KEYS + "SELECT key, lines, keep_id FROM g",
}

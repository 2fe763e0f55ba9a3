"""Quality rules, line first, in DataFrame operations only.

Every line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses over MAX_LOST of its
characters in lines is rejected. Base figures and the base rule
(too few words, too many words in repeated 3-word windows) stand beside it.

All is computed inside the row: words, lines and windows are arrays that
higher-order functions walk, so there is no shuffle whatever the skew. Windows
are compared by sorting them, not all pairs; texts without a repeated window
hash skip the sort.

Defined results: null text counts as empty: no words, base_failed, not kept;
extra columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 40
#: Lines of so many tokens need a punctuation mark; two separators in a line of so many, or one in four tokens, are navigation.
LONG_LINE, NAVIGATION_LINE, MENU_LINE = 10, 12, 5
PUNCTUATION = r"[.,;:!?\x{2026}\x{3002}]"
LINE_SYMBOLS = r"[#*$%&|<>!]"
SEPARATORS = r"[|\x{00BB}\x{203A}\x{2022}\x{00B7}]"
MENU = r"^(home|menu|log ?in|sign (in|up)|register|search|skip to|next|previous|back to|share|tweet|read more|click here|contact us)( |$)"
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our",
    "powered by",
    "copyright ©",
)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def repeat_words(w: Column) -> Column:
    """Words of the array w in 3-word windows that it holds twice or more."""
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    any_twice = _let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
    twice = _let(F.sort_array(windows), lambda s: F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"]))
    covered = _let(twice, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(F.when(any_twice, covered).otherwise(F.lit(0)))


def line_fails(line: Column) -> Column:
    """Does a line that is not blank fail a rule?"""

    def judge(t: Column) -> Column:
        tokens = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
        size = F.length(t)
        punctuation = (tokens >= LONG_LINE) & ~t.rlike(PUNCTUATION)
        symbols = 10 * (size - F.length(F.regexp_replace(t, LINE_SYMBOLS, ""))) > size
        separators = size - F.length(F.regexp_replace(t, SEPARATORS, ""))
        listed = (separators >= 2) & ((tokens <= NAVIGATION_LINE) | (4 * separators >= tokens))
        navigation = listed | ((tokens <= MENU_LINE) & t.rlike(MENU))
        boilerplate = F.lit(False)
        for phrase in BOILERPLATE:
            boilerplate = boilerplate | F.contains(t, F.lit(phrase))
        return punctuation | symbols | navigation | boilerplate

    return _let(F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))), judge)


def measure(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines, lost_percent, kept, clean_text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    filled = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, filled)
        good = F.filter(lines, lambda x: ~filled(x) | ~line_fails(x))
        return _let(F.struct(full.alias("full"), good.alias("good")), lambda s: F.struct(
            (F.size(s["full"]) - F.size(F.array_distinct(s["full"]))).cast("long").alias("n_dup_lines"),
            F.size(s["full"]).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(s["good"])).cast("long").alias("n_bad_lines"),
            chars(s["full"]).alias("chars"),
            chars(F.filter(s["good"], filled)).alias("good_chars"),
            F.array_join(s["good"], "\n").alias("clean_text"),
        ))

    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_percent", "kept", "clean_text")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    n_symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")
    out = docs.select(*own, of_words.alias("__w"), _let(F.split(text, "\n", -1), of_lines).alias("__l"), n_symbols.alias("n_symbols"))
    failed = (F.col("__w.n_words") < MIN_WORDS) | (100 * F.col("__w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__w.n_words"))
    lost = 100 * (F.col("__l.chars") - F.col("__l.good_chars"))
    return out.select(
        *own, "__w.n_words", "__w.word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", failed.alias("base_failed"), "__l.n_lines", "__l.n_bad_lines",
        (lost / F.greatest(F.col("__l.chars"), F.lit(1))).alias("lost_percent"), (~failed & (lost <= MAX_LOST_PERCENT * F.col("__l.chars"))).alias("kept"), "__l.clean_text",
    )


_SQL_BOILERPLATE = " OR ".join(f"contains(t, '{p}')" for p in BOILERPLATE)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, l, lower(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS t
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
k AS (SELECT *, length(t) - length(replace(t, ' ', '')) + 1 AS tokens, length(t) - length(regexp_replace(t, '{SEPARATORS}', '', 'g')) AS seps FROM l),
j AS (SELECT doc_id, l, (tokens >= {LONG_LINE} AND NOT regexp_matches(t, '{PUNCTUATION}'))
      OR 10 * (length(t) - length(regexp_replace(t, '{LINE_SYMBOLS}', '', 'g'))) > length(t)
      OR (seps >= 2 AND (tokens <= {NAVIGATION_LINE} OR 4 * seps >= tokens)) OR (tokens <= {MENU_LINE} AND regexp_matches(t, '{MENU}'))
      OR {_SQL_BOILERPLATE} AS bad FROM k),
s AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, sum(length(l)) AS chars, coalesce(sum(length(l)) FILTER (bad), 0) AS lost FROM j GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {MAX_LOST_PERCENT} * chars AS kept FROM b
"""

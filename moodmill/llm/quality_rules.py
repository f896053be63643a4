"""Operator 2: line-first cleaning and document rules, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
# Marks that running text seldom has; a line of which they are a large share is markup or a separator. The marks
# that end sentences, and few of any, say nothing.
MARKS = "[#*$%&|<>=~^_{}\\[\\]@\\\\]"
# A short line that breaks off is the teaser of another page.
BREAKS_OFF = "(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z"
SEPARATORS = "[|>]"
# Phrases of short lines around a text rather than in it.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "general public license", "privacy policy",
    "terms of use", "terms of service", "cookie", "javascript", "subscribe to our", "sign in", "log in",
    "click here", "read more", "share this", "skip to content", "back to top", "lorem ipsum",
)
# They count between word boundaries, with or without a plural.
PHRASE = "(?<![\\p{L}\\p{N}_])(?:%s)s?(?![\\p{L}\\p{N}_])"
# Single words that texts use as well: alone in their line, or beside a word of notices about them.
COMMON = ("cookie", "javascript")
NOTICE = (
    "accept|allow|browser|consent|disabled?|enabled?|policy|preferences|privacy|require[ds]?|settings|site|supported|"
    "turned? (?:on|off)|(?:uses?|using|our|these|third-party) cookies?|website"
)


@dataclass(frozen=True)
class LineRules:
    marks: int = 3
    mark_pct: int = 25
    teaser_words: int = 8
    separators: int = 3
    words_per_separator: int = 4
    boilerplate_words: int = 20
    kept_share: float = 0.6
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def _line_fails(line: Column, words: Column, rules: LineRules) -> Column:
    """Punctuation, navigation and boilerplate rules; a line without words passes."""
    n = F.size(words)
    separators, marks = _count(line, SEPARATORS), _count(line, MARKS)
    chars = F.length(line) - _count(line, f"[{SPACES}]")
    low = F.lower(line)
    near, common = F.lit(False), F.lit(False)
    for text in BOILERPLATE:
        near = near | F.contains(low, F.lit(text))
    for text in COMMON:
        common = common | F.contains(low, F.lit(text))
    # The cheap test first: few lines hold a phrase at whatever place.
    phrase = near & (
        low.rlike(PHRASE % "|".join(x for x in BOILERPLATE if x not in COMMON))
        | (common & low.rlike(PHRASE % "|".join(COMMON)) & ((n == 1) | low.rlike(PHRASE % NOTICE)))
    )
    return (n > 0) & (
        ((marks >= rules.marks) & (marks * 100 >= chars * rules.mark_pct))
        | ((n <= rules.teaser_words) & line.rlike(BREAKS_OFF))
        | ((separators >= rules.separators) & (separators * rules.words_per_separator >= n))
        | ((n <= rules.boilerplate_words) & phrase)
    )


def _repeated_words(words: Column, hashes: Column, window: int) -> Column:
    """Words inside windows that occur twice or more, given the windows' hashes in order.

    Windows are told apart by 64-bit hashes within one text.
    """
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(twice, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))


def quality_rules(
    docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with the counts, the verdict, and the text that passed line by line.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, kept_words, kept and clean_text (columns of these names in
    the input are replaced). Lines failing a rule are removed first; a document
    is kept if it passes the base rules and at least ``kept_share`` of its words
    are in the lines left. A null or empty text has no words, fails the base
    rules and is not kept. Repeated rows are judged each for itself; empty
    tables give no rows. Everything happens within a row: no shuffle at all.
    """
    made = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lines n_failed_lines kept_words kept clean_text"
    ).split()
    docs = docs.drop(*(c for c in made if c not in (id_col, text_col)))
    scratch = "_q"  # one struct keeps work columns apart from the input's own
    text = F.coalesce(F.col(text_col), F.lit(""))
    k = rules.window

    split = docs.withColumn(
        f"{scratch}_lines",
        F.transform(
            F.split(text, "\n"),
            lambda x: F.struct(x.alias("line"), F.filter(F.split(x, f"[{SPACES}]+"), lambda w: w != "").alias("words")),
        ),
    )
    lines = F.col(f"{scratch}_lines")
    words = split.withColumn(f"{scratch}_words", F.flatten(F.transform(lines, lambda x: x["words"]))).withColumn(
        f"{scratch}_failed", F.transform(lines, lambda x: _line_fails(x["line"], x["words"], rules))
    )
    w, failed = F.col(f"{scratch}_words"), F.col(f"{scratch}_failed")
    hashed = words.withColumn(
        f"{scratch}_hashes",
        F.when(
            F.size(w) >= k,
            F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    ordered = hashed.withColumn(f"{scratch}_sorted", _repeated_words(w, F.col(f"{scratch}_hashes"), k))
    s = F.col(f"{scratch}_sorted")
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    placed = ordered.withColumn(
        f"{scratch}_at",
        F.array_sort(
            F.transform(
                F.filter(s, lambda e, i: same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1))), lambda e: e["at"]
            )
        ),
    )
    at = F.col(f"{scratch}_at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - p, F.lit(k)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    with_words = F.filter(lines, lambda x: F.size(x["words"]) > 0)
    n_words = F.size(w).cast("long")
    n_repeat = F.coalesce(covered, F.lit(0)).cast("long")
    kept_words = F.aggregate(
        F.zip_with(lines, failed, lambda x, f: F.when(f, 0).otherwise(F.size(x["words"]))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    left = F.filter(F.zip_with(lines, failed, lambda x, f: F.when(~f, x["line"])), lambda x: x.isNotNull())
    counted = placed.select(
        *docs.columns,
        n_words.alias("n_words"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SPACES}]+", ""))).alias("_q_spaces"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(with_words) - F.size(F.array_distinct(F.transform(with_words, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(failed, lambda f: f)).cast("long").alias("n_failed_lines"),
        kept_words.alias("kept_words"),
        F.array_join(left, "\n").alias("clean_text"),
    )
    judged = counted.withColumn("word_chars", (F.length(text) - F.col("_q_spaces")).cast("long")).withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")),
    )
    return judged.withColumn(
        "kept", ~F.col("base_failed") & (F.col("kept_words") >= F.col("n_words") * F.lit(rules.kept_share))
    ).drop("_q_spaces")


def _sql_phrase(texts: str) -> str:
    """The test of PHRASE without looking around, which DuckDB's expressions cannot."""
    edge = "[^\\p{L}\\p{N}_]"
    return f"regexp_matches(lower(line), '(^|{edge})(?:{texts})s?($|{edge})')"


def quality_sql(rules: LineRules = LineRules()) -> str:
    """The verdict columns in DuckDB, from rows of lines and rows of windows."""
    space, k = "[^\\x20\\x09-\\x0D]+", rules.window
    plain, common = "|".join(x for x in BOILERPLATE if x not in COMMON), "|".join(COMMON)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{space}') AS words, string_split(t, chr(10)) AS lines FROM d),
    line AS (
      SELECT rid, line, len(regexp_extract_all(line, '{space}')) AS n,
        len(regexp_extract_all(line, '{MARKS}')) AS marks, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, len(regexp_extract_all(line, '{SEPARATORS}')) AS seps
      FROM (SELECT rid, unnest(lines) AS line FROM w)),
    verdict AS (
      SELECT *, n > 0 AND ((marks >= {rules.marks} AND marks * 100 >= chars * {rules.mark_pct})
        OR (n <= {rules.teaser_words} AND regexp_matches(line, '{BREAKS_OFF}'))
        OR (seps >= {rules.separators} AND seps * {rules.words_per_separator} >= n)
        OR (n <= {rules.boilerplate_words} AND ({_sql_phrase(plain)}
          OR ({_sql_phrase(common)} AND (n = 1 OR {_sql_phrase(NOTICE)}))))) AS failed
      FROM line),
    by_doc AS (
      SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) AS n_lines,
        count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (NOT failed), 0)::BIGINT AS kept_words
      FROM verdict GROUP BY rid),
    win AS (
      SELECT rid, i, list_aggregate(words[i:i + {k - 1}], 'string_agg', ' ') AS g
      FROM (SELECT rid, words, unnest(generate_series(1, len(words) - {k - 1})) AS i FROM w)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, generate_series(0, {k - 1}) AS s(j) GROUP BY rid),
    base AS (
      SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
        len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        n_lines, n_failed_lines, kept_words
      FROM w JOIN by_doc USING (rid) LEFT JOIN covered USING (rid)),
    judged AS (
      SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND kept_words >= n_words * {rules.kept_share} AS kept, n_lines, n_failed_lines, kept_words
    FROM judged"""

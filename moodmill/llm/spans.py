"""Spans of pattern matches as columns, counted in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"
# Matches whose places are added up at a time: growing arrays are copied within such a block only.
BLOCK = 512


def regex_spans(text: Column, pattern: str) -> Column:
    """(start, end, match) of all leftmost, non-overlapping matches.

    Splitting a text by a pattern leaves what lies between its matches, so
    adding up the lengths of both in turn gives each match its place. That is
    done block by block, so texts with very many matches cost little more a match.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("skip"), h.alias("match")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"))
        # The part behind the last match has no match and moves nothing.
        return F.when(
            x["match"].isNotNull(), F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))
        ).otherwise(acc)

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(
            part, start, step,
            lambda a: F.struct(a["at"].alias("at"), F.concat(acc["done"], F.array(a["found"])).alias("done")),
        )

    def places(all_pairs: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.size(all_pairs) - 1, F.lit(0)), F.lit(BLOCK))
        parts = F.transform(cuts, lambda k: F.slice(all_pairs, k + 1, BLOCK))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("done"))
        return F.aggregate(parts, start, block, lambda acc: F.flatten(acc["done"]))

    # An array of one binds the pairs to a name, so that they are worked out once.
    return F.transform(F.array(pairs), places)[0]


def spans_if(present: Column, text: Column, pattern: str) -> Column:
    """``regex_spans`` where a cheap test says that there may be one, else no spans."""
    return F.when(present, regex_spans(text, pattern)).otherwise(F.array().cast(SPAN))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of a few words, at whatever place."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found

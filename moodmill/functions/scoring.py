"""Three-class scores from word counts, and everything derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodmill.functions.text import SPACE, as_col
from moodmill.schemas import CLASSES, PROBS

NEUTRAL_LOGIT = 0.5
PROB_FLOOR = 1e-9


@dataclass(frozen=True)
class Lexicon:
    """Words that vote for a class. ``trimmed`` selects the tokenizer:
    letter runs (False), or blank-separated words without edge punctuation."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    trimmed: bool = False


# The default lexicon.
DEFAULT_LEXICON = Lexicon(
    positive=tuple(
        "good great love loved loving amazing awesome excellent fantastic wonderful best "
        "perfect happy win winning bullish up gains buy rally soaring".split()
    ),
    negative=tuple(
        "bad worst hate hated terrible awful horrible disappointed disappointing broken "
        "issue issues bug buggy scam fraud loss losses bearish down sell crash crashing "
        "dump".split()
    ),
)

# The offline gateway's shorter lexicon.
GATEWAY_LEXICON = Lexicon(
    positive=tuple(
        "good great love loved amazing awesome excellent fantastic wonderful best perfect "
        "happy win winning bullish soaring".split()
    ),
    negative=tuple(
        "bad worst hate terrible awful horrible disappointed broken issue issues bug buggy "
        "scam fraud loss bearish crash dump".split()
    ),
    trimmed=True,
)

# Punctuation the blank-separated tokenizer trims.
_EDGE_PUNCTUATION = ".,!?;:'\"()"


def tokens(text: Column | str, trimmed: bool = False) -> Column:
    """Lower-cased word tokens of the whole text; none for NULL."""
    text = F.coalesce(as_col(text), F.lit(""))
    if not trimmed:
        # Split before lower-casing: some non-ASCII capitals lower to ASCII.
        words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z']+"), F.lit(0))
        return F.transform(words, F.lower)
    words = F.split(F.lower(text), rf"(?U){SPACE}+")
    return F.transform(words, lambda w: F.btrim(w, F.lit(_EDGE_PUNCTUATION)))


def count_in(words: Column | str, lexicon_words: tuple[str, ...]) -> Column:
    if not lexicon_words:
        return F.lit(0)
    return F.size(F.filter(as_col(words), lambda w: w.isin(*lexicon_words)))


def softmax(*logits: Column) -> list[Column]:
    """Max-shifted softmax over the given logits, in their order."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


def probabilities(negative: Column, positive: Column) -> list[Column]:
    return softmax(
        negative.cast("double"), F.lit(NEUTRAL_LOGIT), positive.cast("double")
    )


def _triple(probs) -> list[Column]:
    return [as_col(p) for p in (probs or PROBS)]


def label(probs=None) -> Column:
    """Winning class; any tie at the top is neutral."""
    neg, neu, pos = _triple(probs)
    return (
        F.when((neg > neu) & (neg > pos), F.lit("negative"))
        .when((pos > neu) & (pos > neg), F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def argmax_class(probs=None) -> Column:
    """Index of the winning class; ties go to the lowest index."""
    neg, neu, pos = _triple(probs)
    return (
        F.when((neg >= neu) & (neg >= pos), F.lit(0)).when(neu >= pos, F.lit(1)).otherwise(F.lit(2))
    )


def confidence(probs=None) -> Column:
    return F.greatest(*_triple(probs))


def polarity(probs=None) -> Column:
    neg, _, pos = _triple(probs)
    return pos - neg


def prob_map(probs=None) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in CLASSES]), F.array(*_triple(probs))
    )


def tempered(temperature: float, probs=None) -> list[Column]:
    """softmax(log p / T): stored probabilities stand in for the logits."""
    return softmax(
        *[F.ln(F.greatest(p.cast("double"), F.lit(PROB_FLOOR))) / F.lit(float(temperature)) for p in _triple(probs)]
    )

"""Scalar functions of replies: clean-up, entropy of token probabilities, hedging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, WHITE_SET

# Phrases that hedge.
HEDGES = (
    "perhaps", "might", "could consider", "it's worth noting", "it may be", "it could be", "possibly", "arguably", "one might say",
    "it seems like", "to some extent",
)

EDGE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def stripped(text: Column) -> Column:
    """Without white space at both ends.  Only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SET))


def white_words(text: Column) -> Column:
    """Runs of what isn't white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def normalized_entropy(logs: Column) -> Column:
    """Shannon entropy of the probabilities exp(log), brought to sum 1, as a share of the most it can be.

    -1 for null or empty arrays, 1 where all probabilities are 0, 0 for a single one.
    """
    shares = F.transform(logs, lambda x: F.exp(x))
    total = F.aggregate(shares, F.lit(0.0), lambda s, p: s + p)
    bits = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p / total * F.log2(p / total)).otherwise(0.0))
    most = F.when(F.size(logs) > 1, F.log2(F.size(logs))).otherwise(1.0)
    return F.when(F.coalesce(F.size(logs), F.lit(0)) <= 0, -1.0).when(total == 0, 1.0).otherwise(bits / most)


def hedging_density(text: Column) -> Column:
    """Distinct hedging phrases for each hundred words; 0 without words."""
    n = F.size(white_words(text))
    low = F.lower(text)
    hits = sum(F.contains(low, F.lit(h)).cast("int") for h in HEDGES)
    return F.when(n > 0, hits / n * 100).otherwise(0.0)


def without_thinking(text: Column) -> Column:
    """Without marked reasoning: whole blocks, then all up to a closing mark that is left, then all from an opening one."""
    space = r"[\s\x{FEFF}]*"
    opens, closes = f"<{space}think{space}>", f"<{space}/{space}think{space}>"
    out = F.regexp_replace(text, f"(?is){opens}.*?{closes}", "")
    out = F.regexp_replace(out, f"(?is)^.*?{closes}", "")
    return stripped(F.regexp_replace(out, f"(?is){opens}.*$", ""))


def without_closing_question(text: Column) -> Column:
    """Without a question in parentheses at the end."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*\([^)]*\?\)\s*$", ""), f"{WHITE}$", "")

"""Approximate string matching as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow import constants as C


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def lcs_length(text: Column, term: str) -> Column:
    """Longest common subsequence with a fixed term.

    The fold over the text's characters keeps one dynamic-programming row, whose cells are the LCS lengths
    against the term's prefixes.
    """
    empty = F.array_repeat(F.lit(0), len(term) + 1)

    def step(row: Column, char: Column) -> Column:
        # row_new[j] = max over i <= j of (row[i-1] + match_i, row[i]): a running maximum over the term.
        gains = F.transform(
            F.sequence(F.lit(1), F.lit(len(term))),
            lambda j: F.greatest(
                F.get(row, j),
                F.get(row, j - 1) + F.when(F.substring(F.lit(term), j, F.lit(1)) == char, 1).otherwise(0),
            ),
        )
        return F.aggregate(
            gains, F.array(F.lit(0)), lambda acc, g: F.array_append(acc, F.greatest(g, F.element_at(acc, -1)))
        )

    return F.element_at(F.aggregate(_chars(text), empty, step), -1)


def indel_ratio(text: Column, term: str) -> Column:
    """2 * LCS / (len + len): similarity under insertions and deletions only."""
    return 2.0 * lcs_length(text, term) / (F.length(text) + F.lit(len(term)))


def bare(query: Column) -> Column:
    """The form that is matched: lower case without blanks; null for a missing or empty query."""
    return F.lower(F.replace(F.nullif(query, F.lit("")), F.lit(" "), F.lit("")))


def fuzzy_score(q: Column, term: str) -> Column:
    """1.0 on containment either way, else the indel ratio; 0 for a missing query. ``q`` is bare."""
    return (
        F.when(q.isNull(), 0.0)
        .when(F.contains(F.lit(term), q) | F.contains(q, F.lit(term)), 1.0)
        .otherwise(indel_ratio(q, term))
    )


def fuzzy_match(q: Column, term: str, threshold: float = C.FUZZY_THRESHOLD) -> Column:
    """Whether the score reaches the threshold; texts that cannot reach it are not compared in full."""
    n, m = F.length(q), F.lit(len(term))
    # No common subsequence is longer than the number of the query's characters that occur in the term at all.
    usable = n - F.length(F.translate(q, term, ""))
    best_possible = 2.0 * F.least(usable, m) / (n + m)
    contained = F.contains(F.lit(term), q) | F.contains(q, F.lit(term))
    return F.when(contained | (best_possible >= threshold), fuzzy_score(q, term) >= threshold).otherwise(False)


def prefix_score(q: Column, term: str) -> Column:
    """1.0 on containment either way, else the share of the bare query's characters found in order in the term.

    Nothing counts after the first character that is missing.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("hits"))

    def fold(state: Column, char: Column) -> Column:
        found = F.position(char, F.lit(term), state["pos"] + 1)
        hit = (state["pos"] < len(term)) & (found > 0)
        return F.struct(
            F.when(hit, found).otherwise(F.lit(len(term))).alias("pos"),
            (state["hits"] + F.when(hit, 1).otherwise(0)).alias("hits"),
        )

    hits = F.aggregate(_chars(q), start, fold)["hits"]
    contained = F.contains(F.lit(term), q) | F.contains(q, F.lit(term))
    return F.when(F.coalesce(q, F.lit("")) == "", 0.0).when(contained, 1.0).otherwise(hits / F.length(q))

"""What built-in expressions can't say, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(StringType())
def strip_marks(word: pd.Series) -> pd.Series:
    """Letters without combining marks, for any alphabet."""
    import unicodedata

    return word.map(lambda w: None if w is None else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)))


def best_path(word: str, affixes: tuple[tuple[str, ...], tuple[str, ...]], roots: dict[str, float]) -> tuple[str, str, str, float]:
    """The best-scoring of all cuts of a word into prefix, root and suffix: a root's weight, and a bit for each affix."""
    ways = []
    for p in ("", *affixes[0]):
        for s in ("", *affixes[1]):
            if word.startswith(p) and word.endswith(s) and len(p) + len(s) < len(word):
                root = word[len(p) : len(word) - len(s)]
                ways.append((roots.get(root, 0.0) + bool(p) + bool(s), -len(p) - len(s), p, root, s))
    score, _, p, root, s = max(ways, default=(0.0, 0, "", word, ""))
    return p, root, s, score

"""Similarity join by edit distance.

The similarity of two texts is 1 - edits / length of the longer one. The join is that of
``operators.similar``, with this measure in place of the sequence ratio: an edit leaves at most one common
character less, so pieces are passed over by the characters they hold, and the distance to a prefix that
many words share is worked out once for all of them. Only the best words of a text come back, no candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.operators.similar import by_edits

SHORTEST = 5  # shorter texts have no match
LEAST = 80  # percent of similarity; 75 at least


def words_within_edits(tokens: DataFrame, words: DataFrame, count: int, least: int = LEAST) -> DataFrame:
    """(token, word, similarity): up to ``count`` best ``word`` per ``token`` of ``least`` percent similarity
    or more, both of five characters or more; on equal similarities the larger word comes first.

    Missing and shorter texts have no match, repeated ones count once; empty tables give no rows.
    """
    if not 75 <= least <= 100:
        raise ValueError("least is a percentage from 75 to 100")
    asked, offered = (df.where(F.length(c) >= SHORTEST) for df, c in ((tokens, "token"), (words, "word")))
    return by_edits(asked, offered, count, least)

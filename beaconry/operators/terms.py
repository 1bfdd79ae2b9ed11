"""Many terms found in texts at once.

Terms are cut into pieces (words, single marks, blanks of any length as one) and kept in a tree by piece. A text is read once: from each piece
the tree is walked as far as it goes, the longest term that ends there counts, and reading goes on behind it. A term neither begins nor
ends inside a word, whether its own ends are letters or marks; letter case doesn't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PIECE = re.compile(r"\w+|\s+|[^\w\s]")
END = ""  # a key that no piece has


def pieces(text: str) -> list[str]:
    return [" " if p.isspace() else p.lower() for p in PIECE.findall(text)]


def tree_of(terms: list[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for p in pieces(term.strip()):
            node = node.setdefault(p, {})
        if node is not root:
            node[END] = True
    return root


def found_in(text: str | None, root: dict) -> list[str]:
    """The terms in a text as it writes them, leftmost first, the longest where several begin, none overlapping."""
    spans = [(m.start(), m.end()) for m in PIECE.finditer(text or "")]
    read = pieces(text or "")
    is_word = [p[0].isalnum() or p[0] == "_" for p in read]
    out, i = [], 0
    while i < len(read):
        node, end = root.get(read[i]), 0
        j = i
        while node is not None:
            j += 1
            # Behind a mark a word would go on from it, as behind a letter: the term must end where no word stands.
            if END in node and (j == len(read) or not is_word[j]):
                end = j
            node = node.get(read[j]) if j < len(read) else None
        if end and (is_word[i] or i == 0 or not is_word[i - 1]):
            out.append(text[spans[i][0] : spans[end - 1][1]])
            i = end
        else:
            i += 1
    return out


def named_terms(spark: SparkSession, text: Column, terms: list[str]) -> Column:
    """The `terms` that a text names, as it writes them, in order and with repeats. Null names none.

    `terms` is a configured list on the driver; it is sent to each executor once, and each task makes its tree.
    """
    sent = spark.sparkContext.broadcast(terms)

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        root = tree_of(sent.value)
        for texts in batches:
            yield texts.map(lambda t: found_in(t, root))

    # The annotations say which kind of pandas UDF it is; the types are given as values, for this module's are text.
    look.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(look, ArrayType(StringType()))(text)

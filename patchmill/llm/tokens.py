"""Sizes of texts in tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A maximal run of letters, digits and underscores of any script, or a maximal run of other characters that are not blank.
BLANK = r"\p{IsWhite_Space}\x1c-\x1f"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANK}]+"


def word_tokens(text: Column | str) -> Column:
    """Tokens of the word rule in text; NULL and empty texts have none. Counted in the JVM."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN)), F.lit(0)).cast("long")


def bpe_tokens(text: Column | str, ranks_file: str, pattern: str) -> Column:
    """Tokens of a byte-level BPE vocabulary given as a file of ranks that all executors can read; NULL has none."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks_file) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in parts:
            yield s.map(lambda x: len(enc.encode_ordinary(x)) if x else 0).astype("int64")

    return count(F.col(text) if isinstance(text, str) else text)

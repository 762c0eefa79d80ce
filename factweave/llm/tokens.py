"""Token counts with the vocabulary files of public tokenizers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; the environment may name another folder.
TOKENIZER_FILE = os.path.join(os.environ.get("FACTWEAVE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]


def with_tokens(df: DataFrame, text: str, out: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """Adds ``out``, the number of tokens of the whole of column ``text`` (0 for null)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for batch in batches:
            yield pd.Series(counter([t or "" for t in batch]), dtype="int64")

    return df.withColumn(out, F.coalesce(count(F.coalesce(F.col(text), F.lit(""))), F.lit(0)))

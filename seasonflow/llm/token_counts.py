"""Token counts of whole texts by a tokenizer file of the tokenizers library.

Texts are split where a single space stands between two other characters. The pre-tokenizer of byte-level BPE ends a
match at every such place and hands the space to the next one, so the counts of the pieces add up to the count of
the text. Special strings hold no space and stay whole. Each Arrow batch is worked off in groups of about
GROUP_BYTES; only pieces that were not met before are encoded, all of a group in one call, and only lengths come back.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import slices

GROUP_BYTES = 2_000_000
KNOWN_PIECES = 300_000
LONGEST_KNOWN = 64
#: A space next to other white space: there the plain split at spaces would part a run of white space.
RUN = re.compile(r"\s\s|^ | $")
SAFE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Parts of a text that can be encoded alone; each but the first begins with its space."""
    parts = SAFE.split(text) if RUN.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


class Counter:
    """Counts tokens; remembers the counts of short pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i, j in slices(texts, GROUP_BYTES):
            split = [pieces(t) for t in texts[i:j]]
            if len(self.known) > KNOWN_PIECES:
                self.known.clear()
            known = self.known
            new = {p for parts in split for p in parts if p not in known}
            fresh = dict(zip(new, self.lengths(list(new)))) if new else {}
            known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_KNOWN)
            for parts in split:
                out.append(sum(known[p] if p in known else fresh[p] for p in parts))
        return out


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the token count of text_col; path is the tokenizer's .json file, there on every machine."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for b in batches:
            yield pd.Series(counter.count(b.fillna("").tolist()), dtype="int64")

    return docs.withColumn(out, counted(F.col(text_col)))

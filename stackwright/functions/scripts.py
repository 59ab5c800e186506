"""Conversion between scripts by a phrase table: at each place the longest phrase that fits is replaced.

A table is rows (source, target) of phrases and single characters, for one direction. Phrases beat characters, longer phrases
beat shorter ones, and what no entry fits stays as it is. The table goes to each task once, by broadcast, behind a check of
its size; texts without a character that begins an entry never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Entries and characters of a table that is broadcast.
MOST_ENTRIES, MOST_CHARS = 1_000_000, 16_000_000


class Phrases:
    """Entries by their first character: the lengths that occur, longest first, and what each entry becomes."""

    def __init__(self, entries: dict[str, str]):
        self.entries, lengths = entries, {}
        for source in entries:
            lengths.setdefault(source[0], set()).add(len(source))
        self.lengths = {first: sorted(sizes, reverse=True) for first, sizes in lengths.items()}
        self.starts = re.compile(f"[{''.join(map(re.escape, sorted(self.lengths)))}]") if self.lengths else None

    def convert(self, text: str) -> str:
        if self.starts is None:
            return text
        out, at = [], 0
        found = self.starts.search(text)
        while found:
            start = found.start()
            size = next((n for n in self.lengths[text[start]] if text[start : start + n] in self.entries), 0)
            out += [text[at:start], self.entries[text[start : start + size]] if size else text[start]]
            at = start + (size or 1)
            found = self.starts.search(text, at)
        return "".join(out) + text[at:]


def phrase_table(rows: DataFrame, source: str = "source", target: str = "target") -> dict[str, str]:
    """The entries of a table; of several for one source the least target. Blank sources are left out, too many an error."""
    kept = rows.filter(F.coalesce(F.length(source), F.lit(0)) > 0).groupBy(F.col(source).alias("s")).agg(F.min(target).alias("t")).filter("t IS NOT NULL")
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("s") + F.length("t")), F.lit(0)).alias("chars")).first()
    if size.n > MOST_ENTRIES or size.chars > MOST_CHARS:
        raise ValueError(f"a phrase table of {size.n} entries and {size.chars} characters is too large to be broadcast")
    return {r.s: r.t for r in kept.collect()}


def converter(rows: DataFrame, source: str = "source", target: str = "target"):
    """A function of Columns that converts texts by the table ``rows``."""
    entries = phrase_table(rows, source, target)
    shared = rows.sparkSession.sparkContext.broadcast(Phrases(entries))

    @pandas_udf(StringType())
    def convert(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(shared.value.convert, na_action="ignore")

    firsts = "".join(sorted({s[0] for s in entries}))

    def of(text: Column) -> Column:
        if not firsts:
            return text
        touched = F.translate(text, firsts, "") != text
        return F.coalesce(convert(F.when(touched, text)), text)

    return of

"""Page extractors by provider.

A registry maps a provider to a batch extractor of its own, written in Python over pandas batches; a page of
any other provider follows the default rules (``pages.extract_fields``).  Rules stay the usual way to add
a provider; an extractor is for pages that rules can't express.

Every provider is one pass over its own pages: its filter reaches the scan, pages are not shuffled, and no page
runs through the code of another provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import pages as PG

#: Takes a batch with the page's columns, returns the fields it found, one row for each row of the batch.
Extractor = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass
class Registry:
    """Extractors by provider id; ids are compared in lower case without blanks around them."""

    fields: list[str]
    rules: list[PG.ExtractRule] = field(default_factory=lambda: list(PG.COMMON_RULES))
    extractors: dict[str, Extractor] = field(default_factory=dict)

    def register(self, provider: str, extractor: Extractor) -> Registry:
        name = provider.strip().lower()
        if not name:
            raise ValueError("a provider needs a name")
        if name in self.extractors:
            raise ValueError(f"{name} has an extractor already")
        self.extractors[name] = extractor
        return self

    def extract(self, pages: DataFrame, provider: Column, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
        """(key, provider, fields…) of every page; fields are texts, null where nothing was found.

        A page without a provider, or of one that is not registered, follows the rules.  An extractor that
        fails on a page leaves its fields null, and an ``error`` names the exception: one bad page stops neither
        its batch nor the job.  Fields that it adds beyond ``fields`` are left out.
        """
        placed = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"),
                              F.lower(F.trim(F.coalesce(provider, F.lit("")))).alias("provider"))
        known = sorted(self.extractors)
        parts = [self._by_rules(placed.where(~F.col("provider").isin(known)) if known else placed)]
        parts += [self._by_code(placed.where(F.col("provider") == name), self.extractors[name]) for name in known]
        return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)

    def _by_rules(self, pages: DataFrame) -> DataFrame:
        found = PG.extract_fields(pages, self.rules, F.col("provider"))
        values = [F.col(f).cast("string").alias(f) if f in found.columns else F.lit(None).cast("string").alias(f) for f in self.fields]
        return found.select("key", "provider", *values, F.lit(None).cast("string").alias("error"))

    def _by_code(self, pages: DataFrame, extractor: Extractor) -> DataFrame:
        fields = list(self.fields)

        def one(batch: pd.DataFrame) -> pd.DataFrame:
            found = extractor(batch)
            if len(found) != len(batch):
                raise ValueError("an extractor returns one row for each page")
            return found.reset_index(drop=True).reindex(columns=fields)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b.reset_index(drop=True)
                seen = b.drop(columns="key")
                try:
                    values, errors = one(seen), [None] * len(b)
                except Exception:  # page by page, so that only the failing ones are lost
                    rows, errors = [], []
                    for k in range(len(b)):
                        try:
                            rows.append(one(seen.iloc[k:k + 1].reset_index(drop=True)))
                            errors.append(None)
                        except Exception as e:
                            rows.append(pd.DataFrame([[None] * len(fields)], columns=fields))
                            errors.append(type(e).__name__)
                    values = pd.concat(rows, ignore_index=True)
                text = values.astype(object).map(lambda v: None if pd.isna(v) else str(v))
                yield pd.concat([b[["key", "provider"]], text, pd.Series(errors, name="error", dtype=object)], axis=1)

        key_type = pages.schema["key"].dataType.simpleString()
        columns = ", ".join(f"`{f}` string" for f in fields)
        return pages.mapInPandas(run, f"key {key_type}, provider string, {columns}, error string")

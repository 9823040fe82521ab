"""Text encoders: tokens to unit vectors.

The default encoder is TF-IDF over every token of the corpus.  A neural encoder can be plugged
in with :func:`encode_with`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugsieve.functions.text import let
from bugsieve.operators.numbering import number_rows
from bugsieve.session import cut_lineage

#: Of the most frequent terms, so many are broadcast, some 10 MB.
HOT_TERMS = 1 << 17
SPARSE_TYPE = "struct<indices:array<bigint>,values:array<double>>"


@dataclass(frozen=True)
class TfIdfEncoder:
    """The corpus's terms as a table ``(token, term, idf)``.

    Terms are numbered from 0, most frequent first, ties by token, so the numbers do not depend
    on partitioning and the rarest terms of a row have its largest numbers.
    """

    terms: DataFrame
    name: str = "tfidf-l2"

    @property
    def dimension(self) -> int:
        return self.terms.count()

    @staticmethod
    def fit(docs: DataFrame, tokens: str = "tokens", size: int | None = None) -> TfIdfEncoder:
        """Fit on a token column: occurrences and documents of every token in one pass.

        ``size`` keeps only the most frequent tokens, for callers that ask for it.  The terms
        stay a table; nothing but the number of documents reaches the driver.
        """
        n = docs.count()
        counted = _totals(term_counts(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(tokens).alias("tokens"))))
        return TfIdfEncoder._numbered(counted, n, size)

    @staticmethod
    def from_state(state: DataFrame, size: int | None = None) -> TfIdfEncoder:
        """The encoder of all documents a ``term_state`` has counted."""
        n = state.filter("token IS NULL").agg(F.sum("df")).head()[0] or 0
        return TfIdfEncoder._numbered(state.filter("token IS NOT NULL").select("token", "n", "df"), n, size)

    @staticmethod
    def _numbered(counted: DataFrame, n: int, size: int | None) -> TfIdfEncoder:
        numbered = number_rows(counted.withColumn("_first", -F.col("n")), "_first", "token", name="term")
        idf = F.log((F.lit(n) + 1.0) / (F.col("df") + 1))
        terms = numbered.select("token", (F.col("term") - 1).alias("term"), idf.alias("idf"))
        return TfIdfEncoder(cut_lineage(terms if size is None else terms.filter(F.col("term") < size)))

    def known(self, counts: DataFrame, hot_terms: int | None = None) -> DataFrame:
        """``counts(token, ...)`` with the terms of non-zero weight that the tokens are.

        The ``hot_terms`` most frequent terms, which hold most of the counts, are sent to them; only the
        other tokens are shuffled.  ``counts`` are read twice.
        """
        hot_terms = HOT_TERMS if hot_terms is None else hot_terms
        terms = self.terms.select("token", "term", "idf")
        hot = F.broadcast(terms.filter(F.col("term") < hot_terms))  # at most so many rows
        rest = counts.join(hot.select("token"), "token", "left_anti")
        return counts.join(hot, "token").filter("idf <> 0").unionByName(
            rest.join(terms.filter((F.col("term") >= hot_terms) & (F.col("idf") != 0)), "token")
        )

    def encode(self, docs: DataFrame, output: str = "vector", tokens: str = "tokens", stored: bool = False) -> DataFrame:
        """Add the unit vector of each row, in the sparse layout; a row without terms gets an
        empty one.

        A row's distinct tokens meet the terms (see :meth:`known`) and come back together by
        row.  ``stored`` says that ``docs`` are columns of a stored table, with a number for each of its
        rows in ``_row``; they are not stored again.
        """
        rows = docs if stored else cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
        weighted = self.known(term_counts(rows.select("_row", F.col(tokens).alias("tokens"))))
        entries = weighted.groupBy(F.col("_row").alias("_of")).agg(
            F.sort_array(F.collect_list(F.struct("term", (F.col("n") * F.col("idf")).alias("w")))).alias("_e")
        )
        squares = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])
        unit = let(
            F.sqrt(squares),
            lambda length: F.struct(
                F.col("_e.term").alias("indices"), F.transform("_e", lambda x: x["w"] / length).alias("values")
            ),
        )
        empty = F.struct(
            F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<double>").alias("values")
        )
        found = entries.select("_of", unit.cast(SPARSE_TYPE).alias("_unit"))
        joined = rows.join(found, F.col("_row") == F.col("_of"), "left")
        return joined.withColumn(output, F.coalesce("_unit", empty.cast(SPARSE_TYPE))).drop("_row", "_of", "_unit")


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def term_state(docs: DataFrame, tokens: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    """What an encoder is fitted from: ``(token, n, df)``, occurrences and documents of every token; the
    row of the null token counts the documents.  ``counts`` are the documents' ``term_counts``, if known."""
    if counts is None:
        counts = term_counts(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(tokens).alias("tokens")))
    documents = docs.agg(F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint").alias("n"), F.count("*").alias("df"))
    return _totals(counts).unionByName(documents)


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of several corpora together: counts add."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def term_counts(rows: DataFrame) -> DataFrame:
    """``(_row, token, n)``: occurrences of each distinct token, counted within the row."""
    return rows.select("_row", F.inline(let(F.sort_array("tokens"), _runs)))


def _runs(ordered: Column) -> Column:
    """The distinct tokens of a sorted array and how often each occurs: equal ones are neighbours."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1))

    def counted(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, i: F.struct(
                F.get(ordered, at).alias("token"),
                (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - at).cast("bigint").alias("n"),
            ),
        )

    return let(F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))), counted)


def hashed_features(docs: DataFrame, tokens: str = "tokens", output: str = "features", bits: int = 18) -> DataFrame:
    """Unit TF-IDF vectors of a fixed dimension as Spark ML vectors, for estimators that hold
    dense centres: tokens are folded into ``2 ** bits`` columns."""
    counts = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=1 << bits).transform(docs)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts.select("_tf")).transform(counts)
    return Normalizer(p=2.0, inputCol="_tfidf", outputCol=output).transform(weighted).drop("_tf", "_tfidf")


def encode_with(
    docs: DataFrame,
    load: Callable[[], Callable[[list[str]], list[list[float]]]],
    text: str = "normalized_text",
    output: str = "vector",
    batch_size: int = 128,
) -> DataFrame:
    """Run a model over the texts, once loaded per task.

    ``load`` returns a function from a list of texts to a list of vectors; vectors are
    scaled to unit length here.  Rows stream through in Arrow batches.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                m = np.asarray(model(part[text].tolist()), dtype=np.float64)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
                yield part.assign(**{output: list(unit.astype(np.float32))})

    return docs.mapInPandas(run, schema)


def unit_vector(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
        return let(
            F.sqrt(squares),
            lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)),
        )

    return let(F.transform(vector, lambda x: x.cast("double")), scaled)

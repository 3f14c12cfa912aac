"""A positional inverted index over search documents, so that a search reads the asked words and not all documents.

An index is three Parquet tables. Words of analysed fields lie with document and positions on shelves by their first
character, sorted within; trigrams of keyword fields likewise; documents lie in hash buckets. A search prunes shelves by
partition filters and row groups by the sorted words, intersects what it finds, and reads the buckets of the candidates.
The index only proposes: every candidate is confirmed by the same predicate that a scan would use.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.plans import filters
from paywright.session import materialize

#: Folders that words or trigrams are spread over, by their first character.
SHELVES = 128
GRAM = 3
#: Ends a keyword text in the trigram table, so that its last characters begin trigrams too.
END = "\x00"


def _shelf_of(token: Column) -> Column:
    return F.pmod(F.crc32(F.substring(token, 1, 1).cast("binary")), F.lit(SHELVES)).cast("int")


def _shelf(text: str) -> int:
    return zlib.crc32(text[0].encode()) % SHELVES


def literal_runs(pattern: str) -> list[str]:
    """The texts that a value must hold to match a wildcard pattern: what stands between ``*`` and ``?``."""
    runs, quoted = [""], False
    for char in pattern:
        if not quoted and char in "*?":
            runs.append("")
        elif not quoted and char == "\\":
            quoted = True
        else:
            runs[-1] += char
            quoted = False
    return [run for run in runs if run]


@dataclass(frozen=True)
class SearchIndex:
    """Index of documents with one row per ``id_column`` under ``path``."""

    path: str
    schema: T.StructType
    buckets: int = 64
    id_column: str = "employee_id"

    @property
    def _fields(self) -> dict[str, filters.Field]:
        return filters.searchable_fields(self.schema)

    def _texts(self, analysed: bool) -> list[str]:
        return [f.path for f in self._fields.values() if f.kind == "text" and not f.nested and f.analysed == analysed]

    def _bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.id_column), F.lit(self.buckets)).cast("int")

    def build(self, documents: DataFrame) -> None:
        """Write the index anew. A word that a third of all documents hold fills as many files as its rows ask for."""
        docs = materialize(documents, "documents")
        docs.withColumn("bucket", self._bucket_of()).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/documents")
        each = lambda fields, cut: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), cut(F.col(f)).alias("cut")) for f in fields]))
        doc = F.col(self.id_column).alias("doc")
        texts = docs.select(doc, each(self._texts(True), filters.words).alias("part")).select("doc", "part.field", F.posexplode("part.cut").alias("at", "token"))
        postings = texts.groupBy("token", "field", "doc").agg(F.sort_array(F.collect_list("at")).alias("positions"))
        self._write(postings, "token", "words")
        grams = docs.select(doc, each(self._texts(False), _grams).alias("part")).select("doc", "part.field", F.explode("part.cut").alias("token"))
        self._write(grams, "token", "trigrams")

    def _write(self, rows: DataFrame, token: str, name: str) -> None:
        shelved = rows.withColumn("shelf", _shelf_of(F.col(token)))
        dealt = shelved.repartitionByRange("shelf", token, "doc").sortWithinPartitions("shelf", token, "doc")
        dealt.write.mode("overwrite").partitionBy("shelf").parquet(f"{self.path}/{name}")

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        kind = next(f.dataType for f in self.schema if f.name == self.id_column).simpleString()
        more = ", positions array<int>" if name == "words" else ""
        return spark.read.schema(f"token string, field string, doc {kind}{more}, shelf int").parquet(f"{self.path}/{name}")

    def documents(self, spark: SparkSession) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return spark.read.schema(whole).parquet(f"{self.path}/documents")

    def phrase(self, spark: SparkSession, query: str) -> DataFrame | None:
        """Documents (doc) in which the query's words stand in a row in an analysed field, the last one perhaps cut short.

        None if the query has no words. Every word gives rows (doc, field, place where the phrase would begin); a phrase
        stands where all of its words agree. They are counted in one aggregation, which combines on the map side.
        """
        asked = filters.query_words(query)
        if not asked:
            return None
        words = self._table(spark, "words")
        found = None
        for i, word in enumerate(asked):
            last = i == len(asked) - 1
            hit = F.col("token").startswith(word) if last else F.col("token") == word
            rows = words.filter((F.col("shelf") == _shelf(word)) & hit)
            rows = rows.select("doc", "field", F.explode("positions").alias("at")).select("doc", "field", (F.col("at") - i).alias("at"))
            found = rows if found is None else found.unionByName(rows)
        if len(asked) == 1:
            return found.select("doc").distinct()
        # A place holds one word, so each word of the phrase counts at most once for a beginning.
        whole = found.groupBy("doc", "field", "at").agg(F.count(F.lit(1)).alias("seen"))
        return whole.filter(F.col("seen") == len(asked)).select("doc").distinct()

    def substring(self, spark: SparkSession, pattern: str) -> DataFrame | None:
        """Documents (doc) of which some keyword field may match the pattern ``*pattern*``; None if any value may.

        A text of three characters or more must have all its trigrams in a value, a shorter one must begin a trigram.
        """
        tokens, starts = set(), set()
        for run in literal_runs(pattern):
            tokens.update(run[i : i + GRAM] for i in range(len(run) - GRAM + 1))
            if len(run) < GRAM:
                starts.add(run)
        if not tokens and not starts:
            return None
        grams = self._table(spark, "trigrams")
        found = None
        parts = [(t, F.col("token") == t) for t in sorted(tokens)] + [(t, F.col("token").startswith(t)) for t in sorted(starts)]
        for i, (text, hit) in enumerate(parts):
            rows = grams.filter((F.col("shelf") == _shelf(text)) & hit).select("doc", "field", F.lit(i).alias("part"))
            found = rows if found is None else found.unionByName(rows)
        counted = found.distinct().groupBy("doc", "field").agg(F.count(F.lit(1)).alias("n"))
        return counted.filter(F.col("n") == len(parts)).select("doc").distinct()

    def candidates(self, spark: SparkSession, text: str) -> DataFrame | None:
        """Documents (doc) that a free text can hit; None if that may be any of them."""
        by_words, by_grams = self.phrase(spark, text), self.substring(spark, text.lower())
        if by_grams is None and self._texts(False):
            return None
        parts = [p for p in (by_words, by_grams) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct() if parts else None

    def simple(self, spark: SparkSession, text: str | None, status: str = "all", pay_type: str = "all") -> DataFrame:
        """The documents that ``filters.compile_simple`` finds with the same arguments.

        The list of buckets that hold candidates, at most ``buckets`` numbers, prunes the scan of the documents.
        """
        predicate = filters.compile_simple(text, self._fields, status, pay_type)
        asked = (text or "").strip()
        hits = self.candidates(spark, asked) if asked else None
        documents = self.documents(spark)
        if hits is not None:
            hits = materialize(hits.select(F.col("doc").alias(self.id_column)), "candidates")
            touched = sorted(r[0] for r in hits.select(self._bucket_of().alias("bucket")).distinct().collect())
            documents = documents.filter(F.col("bucket").isin(touched)).join(hits, self.id_column, "left_semi")
        return documents.filter(predicate).drop("bucket")


def _grams(text: Column) -> Column:
    """All trigrams of a text with its end marked, each once."""
    ended = F.concat(text, F.lit(END * (GRAM - 1)))
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(ended, i, F.lit(GRAM)))
    return F.when(F.length(text) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

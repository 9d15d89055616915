"""FLT1 by an index: literal, case-insensitive substring search over the text of detections.

``build_index`` writes the rows once, with the searched text beside them, and a posting table
(gram, row) of the distinct 3-character grams of every text, partitioned by bucket of the
gram. A search reads the postings of the rarest grams of the needle only, intersects them by a grouped count,
and brings the candidates to ``filter_detections``, which looks for the needle itself: the
index only ever leaves out rows that cannot hold it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsight.operators.detections import filter_detections, haystack
from logsight.session import stage

GRAM, BUCKETS = 3, 64
USE = 4         # grams of a needle that are intersected
SHARE = 0.1     # a needle whose rarest gram is in more of the rows is looked for by a scan


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(text: str) -> Column:
    """Distinct grams of a text; none for a shorter one."""
    size = F.length(text)
    return F.when(size >= GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), size - (GRAM - 1)), lambda i: F.substring(F.col(text), i, F.lit(GRAM)))))


@dataclass(frozen=True)
class SearchIndex:
    rows: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    total: int
    id_col: str

    def candidates(self, query: str | None) -> DataFrame:
        """Rows that may hold ``query``: all that do, and few others. Without a query, with one of under
        three characters, or with one whose every gram is frequent, all rows (a scan)."""
        q = (query or "").strip().lower()
        grams = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not grams:
            return self.rows
        known = self._of(self.frequencies, grams).select("gram", "n").collect()  # a row for each gram of the needle
        if len(known) < len(grams):
            return self.rows.filter(F.lit(False))
        rare = sorted(known, key=lambda r: (r["n"], r["gram"]))[:USE]
        if rare[0]["n"] > SHARE * self.total:
            return self.rows
        # frequent grams say little and cost the most
        use = [r["gram"] for r in rare if r["n"] <= max(SHARE * self.total, rare[0]["n"])]
        ids = (self._of(self.postings, use).groupBy(self.id_col).agg(F.count_distinct("gram").alias("_n"))
                   .filter(F.col("_n") == len(use)).select(F.col(self.id_col).alias("_id")))
        return self.rows.join(ids, F.col(self.id_col).eqNullSafe(F.col("_id")), "left_semi")

    def search(self, query: str | None, category: str | None = None, severity: str | None = None,
               legacy_all: bool = False) -> DataFrame:
        """FLT1 with the same result as ``filter_detections`` over the indexed rows."""
        return filter_detections(self.candidates(query), category, severity, query, legacy_all)

    @staticmethod
    def _of(table: DataFrame, grams: list[str]) -> DataFrame:
        # the buckets are constants, so only their partitions are listed and read
        return table.filter(F.col("bucket").isin(*[_bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(*grams))


def build_index(df: DataFrame, id_col: str = "row_id") -> SearchIndex:
    """Index all rows of ``df``. Postings are dealt by (bucket, salt of the row), so a gram that
    every row has is spread over many tasks and files, sorted by gram within each.
    Null parts of the text count as empty; null or repeated ids only make more candidates."""
    rows = stage(df, "search-rows")
    text = rows.select(id_col, haystack().alias("_text"))
    pairs = text.select(id_col, F.explode(_grams("_text")).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    salts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    dealt = pairs.repartition(F.col("bucket"), F.pmod(F.xxhash64(id_col), F.lit(salts)))
    postings = stage(dealt.sortWithinPartitions("bucket", "gram", id_col), "search-postings", partition_by="bucket")
    counts = postings.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    frequencies = stage(counts.repartition("bucket").sortWithinPartitions("bucket", "gram"), "search-grams", partition_by="bucket")
    return SearchIndex(rows, postings, frequencies, rows.count(), id_col)

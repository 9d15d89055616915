"""Catalogue: file sources over tables written to the shared stage folder and read back."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.plans import sql_blocks as S
from logsight.plans.catalog import register
from logsight.session import ensure_checkpoint_dir, read_table
from logsight.sources.delimited import read_delimited


def write_lines(lines: DataFrame, name: str, header: str | None = None) -> str:
    """A folder of text files, one for each partition of ``lines`` (value), each with the header first."""
    path = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/logsight-stage/{name}-{uuid.uuid4().hex}"

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    (lines.mapInArrow(headed, "value string") if header else lines).write.text(path)
    return path


_NULLS = ", ".join(S.q(x) for x in ("", *C.NULL_MARKERS))


@register("csv_quoted_documents", f"""WITH d AS (
  SELECT doc_id, source, doc_id::VARCHAR || '" wide' AS note, text || CASE WHEN doc_id % 5 = 0 THEN '~"' ELSE '' END AS body
  FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN source NOT IN ({_NULLS}) THEN source END AS source, note,
  length(CASE WHEN body NOT IN ({_NULLS}) THEN body END) AS n_chars, sha256(CASE WHEN body NOT IN ({_NULLS}) THEN body END) AS text_sha256
FROM d""")
def q_csv_quoted_documents(spark, sf_dir):
    """SRC1: every document as a record whose quoted text keeps its line breaks, with stray
    quotes inside unquoted fields and behind closing ones, and some over-long records; files are cut split by split."""
    d = read_table(spark, sf_dir, "documents")
    body = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(
        ",", F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit('" wide')),
        F.concat(F.coalesce(body, F.lit("")), F.when(F.col("doc_id") % 5 == 0, '~"').otherwise("")),
        F.when(F.col("doc_id") % 11 == 0, F.lit("one too many")))
    path = write_lines(d.select(line.alias("value")), "quoted", "doc_id,source,note,text")
    raw, _ = read_delimited(spark, path, sep=",")
    return raw.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "note", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))

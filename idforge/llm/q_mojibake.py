"""Problem 8: garbled text from wrong character encoding."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.llm.mojibake import MULTIBYTE, garbled, repair


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents with the text that could be restored."""
    return garbled(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one wrongly decoded character."""
    return p8_restored(spark, d).select("doc_id")


def p8_methods(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents by what found them: the byte automaton, single-byte rereading, or lost characters alone."""
    return p8_restored(spark, d).groupBy("by").agg(F.count("*").alias("documents"), F.count_if("lost").alias("lost"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation passage with other than ASCII characters, read wrongly under each encoding, and what comes back."""
    readings = ("latin-1", *MULTIBYTE)

    def work(batches):
        for batch in batches:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for read in readings:
                    # As a lenient reader does: a byte that the encoding lacks stands for itself.
                    wrong = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode())
                    rows.append((item, read, repair(wrong)[0]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["item_id", "reading", "restored"])

    e = spark.read.parquet(f"{d}/eval_passages.parquet").where(F.octet_length("passage") > F.length("passage"))
    return e.select("item_id", "passage").mapInArrow(work, "item_id bigint, reading string, restored string")


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored, "p8_methods": p8_methods, "p8_round_trip": p8_round_trip}
_READINGS = ", ".join(f"('{r}')" for r in ("latin-1", *MULTIBYTE))
SQL: dict[str, str] = {"p8_round_trip": f"SELECT item_id, reading, passage AS restored FROM eval_passages, (VALUES {_READINGS}) v(reading) WHERE strlen(passage) > length(passage)"}

"""Streams over the event and judgement tables, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions.docids import unbracketed
from idforge.operators.lineage import scratch
from idforge.plans.q_relevance import table
from idforge.streaming.runs import drained, first_judgements, read_stream


def _drained(s, stream):
    at = scratch(s, "stream")
    return drained(stream, f"{at}/out", f"{at}/checkpoint")


def _stream(s, d, name):
    source = f"{d}/{name}.parquet"
    return read_stream(s, source if _is_folder(s, source) else f"{d}/{name}*.parquet", table(s, d, name).schema)


def _is_folder(s, path):
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def judgements(s, d):
    """Distinct judged pairs, as a stream sees them."""
    q = _stream(s, d, "nq_qrels").where("docid is not null and rel >= 1").select("qid", unbracketed(F.col("docid")).alias("docid"), "judged_at")
    return _drained(s, first_judgements(q, late="3650 days")).select("qid", "docid")


def event_stream(s, d):
    """Purchases and errors with their property, filtered and projected as they arrive."""
    e = _stream(s, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return _drained(s, e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")))


QUERIES = {"stream_judgements": judgements, "stream_events": event_stream}
SQL = {
    "stream_judgements": r"SELECT DISTINCT qid, lower(regexp_replace(trim(docid), '^[\[\] ]+|[\[\] ]+$', '', 'g')) AS docid FROM nq_qrels WHERE rel >= 1 AND docid IS NOT NULL",
    "stream_events": "SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events WHERE event_type IN ('purchase', 'error')",
}

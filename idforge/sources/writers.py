"""Writers of the same formats. Every partition writes its own file; nothing is merged on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idforge.functions.docids import bracketed


def jsonl(df: DataFrame, path: str, skip_null: tuple[str, ...] = ()) -> None:
    """JSON lines; rows with a null in ``skip_null`` are left out."""
    for c in skip_null:
        df = df.where(F.col(c).isNotNull())
    df.write.json(path)


def tsv_gz(df: DataFrame, path: str, fields: list[str]) -> None:
    """Gzipped TSV of chosen fields; tabs and line ends in values become blanks, nulls become empty."""
    df.select(F.concat_ws("\t", *(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n\r", "   ") for c in fields)).alias("value")).write.option("compression", "gzip").text(path)


def json_array(df: DataFrame, path: str) -> None:
    """One JSON array per file, an element a line. Rows stream past; none is held but the last one."""

    def work(batches):
        held, opened, out = None, False, []

        def put(end: str) -> None:
            nonlocal opened
            out.append(("" if opened else "[") + held + end)
            opened = True

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if held is not None:
                    put(",")
                held = x
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
            out.clear()
        if held is not None:
            put("]")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("j")).mapInArrow(work, "value string").write.text(path)


def keyed_lines(df: DataFrame, key: str, value: Column, path: str) -> None:
    """``[key]<tab>value`` lines."""
    df.select(F.concat_ws("\t", bracketed(F.col(key)), value).alias("value")).write.text(path)


def codes(df: DataFrame, path: str, key: str = "docid", column: str = "codes") -> None:
    keyed_lines(df, key, F.array_join(F.transform(column, lambda x: x.cast("string")), ","), path)


def vectors(df: DataFrame, path: str, key: str = "docid", column: str = "embedding") -> None:
    codes(df, path, key, column)


def run(lines_: DataFrame, path: str) -> None:
    lines_.select(F.col("line").alias("value")).write.text(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a results table; columns may differ from run to run."""
    df.write.mode("append").parquet(path)


def triples(df: DataFrame, path: str) -> None:
    """The one schema of triples: six tab-separated columns."""
    tsv_gz(df, path, ["qid", "query", "pos_url", "pos_docid", "neg_url", "neg_docid"])


def csv(df: DataFrame, path: str, null: str = "\\N") -> None:
    """CSV with a header; nulls are written as ``null``, so that empty texts stay apart from them."""
    df.write.options(nullValue=null, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)


def nq_outputs(train: DataFrame, dev: DataFrame, merged: DataFrame, folder: str) -> None:
    """Train and dev tables, the merged corpus, and (id, contents) for an indexer."""
    from idforge.sources.readers import NQ

    tsv_gz(train, f"{folder}/train", list(NQ))
    tsv_gz(dev, f"{folder}/dev", list(NQ))
    jsonl(merged, f"{folder}/merged")
    jsonl(merged.select("id", F.col("doc_tac").alias("contents")), f"{folder}/contents", ("id", "contents"))


def position_metrics(histogram: DataFrame, balance: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per code position from the three per-level tables."""
    n = histogram.groupBy("level").agg(F.max("n").alias("most"))
    return balance.join(n, "level").join(usage, "level")


def samples_json(samples: DataFrame, key: str = "vec_id") -> DataFrame:
    """One JSON object of first code to its sampled documents per row: ``value``."""
    g = samples.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("docs"))
    return g.select(F.to_json(F.struct("token", "docs")).alias("value"))


def metric_report(metrics: DataFrame, path: str) -> None:
    """A row of metrics as JSON (under ``json``) and as ``name: value`` lines (under ``text``)."""
    metrics.write.json(f"{path}/json")
    named = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in metrics.columns))
    metrics.select(F.explode(named).alias("x")).select(F.format_string("%s: %.6f", "x.name", "x.v").alias("value")).write.text(f"{path}/text")


def level_summaries(histogram: DataFrame) -> DataFrame:
    """One JSON object per code level: ``value``."""
    by = histogram.groupBy("level").agg(F.count("*").alias("tokens"), F.sum("n").alias("docs"), F.min("n").alias("least"), F.max("n").alias("most"))
    return by.select(F.to_json(F.struct("level", "tokens", "docs", "least", "most")).alias("value"))

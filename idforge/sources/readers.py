"""Readers of the text formats that retrieval data comes in.

All give explicit schemas: ids such as ``0012`` must stay strings. Files may be
gzipped (by suffix); a gzipped file is one split, so large ones should be
repartitioned after the read. Malformed rows are skipped or raise, as each
reader says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.functions.docids import bracketed

NQ = ("query", "id", "long_answer", "short_answer", "title", "abstract", "content", "document_url", "doc_tac", "language")
INSTANCES = "query_id string, doc_id string, input_ids array<int>"
_SPAN = "start_token:int,end_token:int"
RAW = f"question_text string, example_id bigint, document_title string, document_url string, document_text string, document_tokens array<struct<token:string>>, annotations array<struct<long_answer:struct<{_SPAN}>,short_answers:array<struct<{_SPAN}>>,yes_no_answer:string>>"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files; paths may have wildcards."""
    return spark.read.text(path)


def ordered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` and ``line``, by which lines sort as they stand in their files, the files by name.

    A split of a file is read from its start to its end, so a line's running
    number orders it within the split, whichever task gets the split.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines(spark, path).select("value", at.alias("line"))


def _fields(df: DataFrame, pattern: str, most: int = -1) -> DataFrame:
    return df.select(F.split("value", pattern, most).alias("f"))


def docs_tsv(spark: SparkSession, path) -> DataFrame:
    """``docid, url, title, body``; the body keeps its tabs, lines with fewer fields are skipped."""
    f = _fields(lines(spark, path), "\t", 4).where(F.size("f") == 4)
    return f.select(*(F.col("f")[k].alias(n) for k, n in enumerate(("docid", "url", "title", "body"))))


def jsonl(spark: SparkSession, path, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines under a schema; malformed lines are skipped, or raise if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def rejected_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """The malformed lines that ``jsonl`` skips."""
    raw = lines(spark, path)
    return raw.where(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())


def titles_texts(spark: SparkSession, path) -> DataFrame:
    """``docid, title, text`` of a corpus in either layout; line ends and tabs in the text become blanks."""
    d = jsonl(spark, path, "docid string, id string, title string, body string, doc_tac string")
    return d.select(F.coalesce("docid", "id").alias("docid"), F.coalesce("title", F.lit("")).alias("title"), F.trim(F.translate(F.coalesce("body", "doc_tac", F.lit("")), "\n\t", "  ")).alias("text"))


def queries_tsv(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """``qid, query``; lines without exactly two fields are skipped, or raise if ``strict``."""
    f = _fields(lines(spark, path), "\t")
    two = F.size("f") == 2
    f = f.withColumn("f", F.when(two, F.col("f")).otherwise(F.raise_error(F.lit("a query line without exactly two fields")))) if strict else f.where(two)
    return f.select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("query"))


def rejected_queries(spark: SparkSession, path) -> DataFrame:
    return lines(spark, path).where(F.size(F.split("value", "\t")) != 2)


def qrels(spark: SparkSession, path, least: int | None = 1, exact: int | None = None) -> DataFrame:
    """``qid, docid, rel`` from lines split at blanks or tabs; rows whose relevance is no number are skipped.

    ``least`` keeps relevances from it on, ``exact`` only one; None for both keeps all.
    """
    f = lines(spark, path).select(F.split(F.trim("value"), "\\s+").alias("f")).where(F.size("f") >= 4)
    q = f.select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.col("f")[3].try_cast("int").alias("rel")).where("rel is not null")
    return q.where(F.col("rel") == exact) if exact is not None else q.where(F.col("rel") >= least) if least is not None else q


def last_qrels(spark: SparkSession, path) -> DataFrame:
    """The last line of each query: ``qid, docid``; files follow each other by name."""
    f = ordered_lines(spark, path).select("line", F.split(F.trim("value"), "\\s+").alias("f")).where(F.size("f") >= 4)
    return f.groupBy(F.col("f")[0].alias("qid")).agg(F.max_by(F.col("f")[2], "line").alias("docid"))


def run(spark: SparkSession, path) -> DataFrame:
    """``qid, docid, rank, score`` of a run with three fields (the third a rank) or six (TREC)."""
    f = lines(spark, path).select(F.split(F.trim("value"), "\\s+").alias("f")).where(F.size("f").isin(3, 6))
    three = F.size("f") == 3
    pick = lambda a, b: F.when(three, F.get("f", F.lit(a))).otherwise(F.get("f", F.lit(b)))
    return f.select(F.col("f")[0].alias("qid"), pick(1, 2).alias("docid"), pick(2, 3).try_cast("int").alias("rank"), F.when(~three, F.get("f", F.lit(4)).try_cast("double")).alias("score"))


def vectors(spark: SparkSession, path) -> DataFrame:
    """``docid, embedding`` from ``[id]<tab>v,v,...``."""
    f = _fields(lines(spark, path), "\t").where(F.size("f") == 2)
    return f.select(bracketed(F.col("f")[0]).alias("docid"), F.transform(F.split(F.col("f")[1], ","), lambda v: v.cast("float")).alias("embedding"))


def encoded_docids(spark: SparkSession, path, drop: tuple[int, ...] = ()) -> DataFrame:
    """``docid, codes`` from ``[id]<tab>c,c,...``; the last line of an id holds; ``drop`` removes padding or end codes."""
    f = ordered_lines(spark, path).select("line", F.split("value", "\t").alias("f")).where(F.size("f") == 2)
    last = f.groupBy(bracketed(F.col("f")[0]).alias("docid")).agg(F.max_by(F.col("f")[1], "line").alias("c"))
    codes = F.transform(F.split("c", ","), lambda v: F.trim(v).cast("int"))
    return last.select("docid", (F.filter(codes, lambda v: ~v.isin(*drop)) if drop else codes).alias("codes"))


def raw_examples(spark: SparkSession, path) -> DataFrame:
    """Nested question examples, from JSON lines or parquet."""
    return spark.read.parquet(path) if str(path).endswith("parquet") else jsonl(spark, path, RAW)


def nq_tsv(spark: SparkSession, path) -> DataFrame:
    """The ten-column page table."""
    return spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in NQ), quote="", escape="")


def table(spark: SparkSession, path, renamed: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A parquet table with columns renamed; raises if a required one is missing."""
    d = spark.read.parquet(path).withColumnsRenamed(renamed or {})
    if missing := [c for c in required if c not in d.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return d


def csv(spark: SparkSession, path, schema: str, thousands: str = "", decimal: str = ".", **options) -> DataFrame:
    """CSV under a schema with Spark's reader options. Footers aren't supported.

    ``thousands`` is a mark to drop from numbers, ``decimal`` their decimal
    mark; what is no number then is null.
    """
    if not thousands and decimal == ".":
        return spark.read.options(**options).csv(path, schema=schema)
    kinds = dict(c.split(None, 1) for c in schema.split(", "))
    rows = spark.read.options(**options).csv(path, schema=", ".join(f"{c} string" for c in kinds))

    def number(c: str) -> Column:
        bare = F.replace(F.trim(c), F.lit(thousands), F.lit("")) if thousands else F.trim(c)
        return F.replace(bare, F.lit(decimal), F.lit(".")).try_cast(kinds[c])

    return rows.select(*(F.col(c) if kinds[c] == "string" else number(c).alias(c) for c in kinds))


def json_field(spark: SparkSession, path, field: str, schema: str) -> DataFrame:
    """The array under one field of whole JSON files, a row for each element."""
    return spark.read.option("multiLine", True).schema(f"{field} array<struct<{_as_struct(schema)}>>").json(path).select(F.explode(field).alias("x")).select("x.*")


def _as_struct(schema: str) -> str:
    return ",".join(":".join(c.split(None, 1)) for c in schema.split(", "))


def instances(spark: SparkSession, path) -> DataFrame:
    return jsonl(spark, path, INSTANCES)


def indexing(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Indexing rows (``text_id``, ``text``) and the distinct valid ids."""
    d = jsonl(spark, path, "text_id string, text string")
    return d, d.select("text_id").distinct()


def generation_prompts(docs: DataFrame, title: Column, passage: Column, languages: tuple[str, ...], key: str) -> DataFrame:
    """One prompt for each document and language: key, ``lang``, ``prompt``."""
    from idforge.functions.text import question_prompt

    d = docs.select(key, title.alias("t"), passage.alias("p")).withColumn("lang", F.explode(F.array(*map(F.lit, languages))))
    return d.select(key, "lang", question_prompt(F.col("lang"), F.col("t"), F.col("p")).alias("prompt"))


def dpr(spark: SparkSession, path) -> DataFrame:
    """Question sets with contexts; rows without a positive one are left out. Pickled sets aren't read, on purpose."""
    ctx = "array<struct<title:string,text:string>>"
    return jsonl(spark, path, f"question string, answers array<string>, positive_ctxs {ctx}, hard_negative_ctxs {ctx}").where(F.size("positive_ctxs") > 0)


def codebook(spark: SparkSession, path) -> DataFrame:
    """A trained codebook: ``level, subspace, code, centroid``."""
    return spark.read.schema("level int, subspace int, code int, centroid array<double>").parquet(path)


def triples(spark: SparkSession, path) -> DataFrame:
    """``qid, query, pos_url, pos_docid, neg_url, neg_docid`` from six columns, or from three with the others null."""
    f = _fields(lines(spark, path), "\t").where(F.size("f").isin(3, 6))
    six = F.size("f") == 6
    pick = lambda a, b: F.when(six, F.get("f", F.lit(a))).otherwise(F.get("f", F.lit(b)) if b is not None else F.lit(None))
    names = (("qid", 0, 0), ("query", 1, None), ("pos_url", 2, None), ("pos_docid", 3, 1), ("neg_url", 4, None), ("neg_docid", 5, 2))
    return f.select(*(pick(a, b).alias(n) for n, a, b in names))

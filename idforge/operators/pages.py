"""Cleaning of nested question examples and of page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idforge.functions.text import after_mark, before_last, before_mark, rough_wordpiece, span, strip_tags
from idforge.operators.lineage import cut


def flatten_examples(raw: DataFrame) -> DataFrame:
    """One flat row for each nested example; spans come from the tokens, answers from the first annotation that has one.

    A missing question, title or URL becomes empty. A page without a paragraph
    has no abstract, and its content starts with its first token. Examples for
    training hold the page as one text (``document_text``) instead of tokens and
    a title; its words stand between blanks, and the title is its first heading.
    """
    words = F.transform("document_tokens", lambda t: t["token"]) if "document_tokens" in raw.columns else F.lit(None).cast("array<string>")
    heading = F.lit(None).cast("string")
    if "document_text" in raw.columns:
        words = F.coalesce(words, F.split("document_text", " "))
        heading = F.when(F.locate("<H1>", "document_text") > 0, F.substring(before_mark(after_mark(F.col("document_text"), "<H1>"), "</H1>"), F.lit(5), F.length("document_text")))
    doc = F.array_join(words, " ")
    first = F.get("annotations", F.lit(0))
    has_long = first["long_answer"]["start_token"] >= 0
    long = F.get(F.filter(F.transform("annotations", lambda a: a["long_answer"]), lambda a: a["start_token"] >= 0), F.lit(0))
    has_short = (F.size(first["short_answers"]) > 0)
    shorts = F.array_join(F.transform(first["short_answers"], lambda s: span(words, s["start_token"], s["end_token"])), "|")
    tail = after_mark(doc, "<P>")
    abstract = F.when(F.locate("<P>", doc) > 0, F.substring(before_mark(tail, "</P>"), F.lit(4), F.length(tail)))
    rest = F.when(F.locate("</P>", doc) > 0, F.substring(after_mark(doc, "</P>"), F.lit(5), F.length(doc))).otherwise(doc)
    content = strip_tags(before_last(before_last(rest, "</Ul>"), "</Ul>"))
    title = F.coalesce(F.col("document_title") if "document_title" in raw.columns else heading, heading, F.lit(""))
    body = F.coalesce(abstract, F.lit(""))
    return raw.select(
        F.coalesce("question_text", F.lit("")).alias("query"), F.col("example_id").cast("string").alias("id"),
        F.when(has_long, F.trim(F.regexp_replace(F.regexp_replace(span(words, long["start_token"], long["end_token"]), "<[^<]+?>", ""), "\\n", ""))).otherwise("").alias("long_answer"),
        F.when(has_short, F.trim(F.regexp_replace(F.regexp_replace(shorts, "<[^<]+?>", ""), "\\n", ""))).otherwise("").alias("short_answer"),
        title.alias("title"), body.alias("abstract"), content.alias("content"), F.coalesce("document_url", F.lit("")).alias("document_url"),
        F.concat(title, body, content).alias("doc_tac"), F.lit("en").alias("language"),
    )


def title_survivors(rows: DataFrame) -> DataFrame:
    """The first row of each lower-cased title, train before the others, then by row number: ``title``, ``row_no``, ``id``."""
    t = rows.where("title is not null").select("row_no", "id", rough_wordpiece(F.col("title")).alias("title"), F.when(F.col("split") == "train", 0).otherwise(1).alias("order"))
    best = t.groupBy("title").agg(F.min(F.struct("order", "row_no", "id")).alias("m"))
    return best.select("title", "m.row_no", "m.id")


def mapped_ids(rows: DataFrame) -> DataFrame:
    """Each row with the id of its title's survivor: ``row_no``, ``split``, ``id``."""
    t = rows.where("title is not null").select("row_no", "split", rough_wordpiece(F.col("title")).alias("title"))
    return t.join(title_survivors(rows).select("title", "id"), "title").select("row_no", "split", "id")


def dev_without_train(rows: DataFrame) -> DataFrame:
    """First dev row of each mapped id that no train row has: ``id``, ``row_no``."""
    m = mapped_ids(rows).where("id is not null")
    dev = m.where("split = 'dev'").groupBy("id").agg(F.min("row_no").alias("row_no"))
    return dev.join(m.where("split = 'train'").select("id").distinct(), "id", "left_anti")


def latest_rows(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key by time: key, ``tie``."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(time, tie)).alias("m")).select(key, F.col(f"m.{tie}").alias(tie))


def position_splits(rows: DataFrame, order: list, shares: list[tuple[str, float]]) -> DataFrame:
    """Splits by position: the first int(share * n) rows, and so on; the last split takes the rest."""
    from idforge.operators.ordering import dense_index

    n = rows.count()
    at, choice = 0, F.lit(shares[-1][0])
    ends = []
    for name, share in shares[:-1]:
        at += int(share * n)
        ends.append((name, at))
    for name, end in reversed(ends):
        choice = F.when(F.col("i") < end, name).otherwise(choice)
    return dense_index(rows, order).withColumn("part", choice)


def hash_split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``held_out``: whether a row is among a share chosen by its key's hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return rows.withColumn("held_out", h < share)


def subset_with_overlap(train: DataFrame, held: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All train rows whose key is in the evaluation set, then others by hash, ``n`` in all."""
    inside = train.join(held.select(key).distinct(), key, "left_semi").withColumn("o", F.lit(0))
    outside = train.join(held.select(key).distinct(), key, "left_anti").withColumn("o", F.lit(1))
    both = inside.unionByName(outside)
    return both.orderBy("o", F.md5(F.concat_ws("|", F.lit(seed), "row_no")), "row_no").limit(n).drop("o")


def indexing_rows(rows: DataFrame) -> DataFrame:
    """Passage and question rows of train pages, and passages of dev pages that train lacks: ``text_id``, ``kind``, ``text``."""
    p = rows.where("docid is not null")
    w = Window.partitionBy("docid", "side").orderBy("row_no")
    first = p.withColumn("side", F.when(F.col("split") == "train", "train").otherwise("held")).withColumn("r", F.row_number().over(w)).where("r = 1")
    train, held = first.where("side = 'train'"), first.where("side = 'held'")
    fill = held.join(train.select("docid"), "docid", "left_anti")
    passages = train.unionByName(fill).select(F.col("docid").alias("text_id"), F.lit("passage").alias("kind"), F.concat(F.lit("Passage: "), F.coalesce("abstract", F.lit(""))).alias("text"))
    questions = p.where("split = 'train' and query is not null").select(F.col("docid").alias("text_id"), F.lit("question").alias("kind"), F.concat(F.lit("Question: "), "query").alias("text")).distinct()
    return passages.unionByName(questions)


def numbered_assembly(train: DataFrame, fill: DataFrame, dev: DataFrame, n_train: int, n_eval: int, seed: int = 42) -> DataFrame:
    """Rows for indexing and for evaluation under running numbers: ``part``, ``text_id``, ``text``.

    ``train`` and ``dev`` have ``qid``, ``title``, ``passage``, ``question`` and
    ``lang``; ``fill`` has ``qid``, ``title``, ``passage``. A qid counts once,
    train before dev. Pages come in hash order: up to ``n_train`` from train,
    then from ``fill`` until there are so many, then ``n_eval`` of dev. Parts:
    ``index`` (passages and train questions), ``eval`` (dev questions),
    ``corpus`` and ``generator`` (a prompt for every question, by question).
    """
    from idforge.functions.text import question_prompt
    from idforge.operators.ordering import dense_index

    kept = ["qid", "title", "passage", "question", "lang"]
    one = lambda d: d.select(*kept).where("qid is not null").groupBy("qid").agg(F.min(F.struct("passage", "title", "question", "lang")).alias("x")).select("qid", *(f"x.{c}" for c in kept[1:]))
    a, c = one(train), one(dev)
    c = c.join(a.select("qid"), "qid", "left_anti")
    none = F.lit(None).cast("string")
    b = fill.select("qid", "title", "passage", none.alias("question"), none.alias("lang"))
    every = a.withColumn("g", F.lit(0)).unionByName(b.withColumn("g", F.lit(1))).unionByName(c.withColumn("g", F.lit(2)))
    placed = cut(dense_index(every.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "qid"))), ["g", "h", "qid"], "i"), "assembly")
    first = placed.where("g < 2").count()
    own = min(first, n_train)
    text_id = F.when(F.col("g") < 2, F.col("i")).otherwise(F.col("i") - first + own)
    used = placed.withColumn("text_id", text_id).where(F.when(F.col("g") < 2, F.col("i") < n_train).otherwise(F.col("i") - first < n_eval))
    passage = F.concat(F.lit("Passage: "), F.coalesce("title", F.lit("")), F.lit("</s>"), F.coalesce("passage", F.lit("")))
    question = F.concat(F.lit("Question: "), "question")
    row = lambda part, text: F.struct(F.lit(part).alias("part"), F.col("text_id").cast("string").alias("text_id"), text.alias("text"))
    rows = used.select(F.explode(F.array(row("index", passage), row("corpus", F.concat_ws("\t", "passage", "title")), F.when(F.col("question").isNotNull(), F.when(F.col("g") == 2, row("eval", question)).otherwise(row("index", question))))).alias("x")).where("x is not null").select("x.*")
    prompts = placed.where("question is not null").select(F.lit("generator").alias("part"), F.col("question").alias("text_id"), question_prompt(F.coalesce("lang", F.lit("en")), F.coalesce("title", F.lit("")), F.coalesce("passage", F.lit(""))).alias("text"))
    return rows.unionByName(prompts)


def proportional_steps(rows: DataFrame, total_steps: int, batch: int, world: int, name: str = "dataset", key: str = "key", seed: int = 42) -> DataFrame:
    """Every row of several datasets with the rank and the step that read it: ``dataset``, ``key``, ``epoch``, ``rank``, ``step``.

    Each dataset has steps in proportion to its rows (rounded; the last by name
    has the rest). It is read in a new hash order as often as its steps need,
    and cut off where they end. ``step`` numbers a dataset's own steps.
    """
    from idforge.operators.ordering import dense_index

    sizes = sorted((r[name], r["n"]) for r in rows.groupBy(name).agg(F.count("*").alias("n")).limit(10_001).collect())
    if len(sizes) > 10_000:
        raise ValueError("more than 10,000 datasets")
    total, left, plan = sum(n for _, n in sizes), total_steps, []
    for k, (d, n) in enumerate(sizes):
        steps = left if k == len(sizes) - 1 else int(n / total * total_steps + 0.5)
        left -= steps
        plan.append((d, n, steps, -(-steps * batch * world // n)))
    plan = rows.sparkSession.createDataFrame(plan, f"`{name}` string, n bigint, steps int, epochs int")
    each = rows.select(name, key).join(F.broadcast(plan), name).where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    ordered = cut(dense_index(each.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "epoch", key))), [name, "epoch", "h", key], "i"), "steps")
    first = ordered.groupBy(name).agg(F.min("i").alias("f"))
    at = ordered.join(F.broadcast(first), name).withColumn("p", F.col("i") - F.col("f")).where(F.col("p") < F.col("steps") * batch * world)
    per_rank = F.col("steps") * batch
    return at.select(name, key, "epoch", F.expr(f"int(p div (steps * {batch}))").alias("rank"), F.floor(F.col("p") % per_rank / batch).cast("int").alias("step"))

"""Markdown to blocks: every line is told by itself, fences are paired by a fold, and windows make runs of lines blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import ND, SPARK, WS, column, with_steps
from spanloom.operators.folds import folded
from spanloom.operators.structure import lines

#: What a run of lines of one kind is.
KINDS = {"heading": "heading", "setext": "heading", "text": "paragraph", "quote": "block_quote", "item": "list_item", "rule": "separator", "code": "code"}


def fence_edges(told: DataFrame, key: str) -> DataFrame:
    """(key, n, opens): the fence lines that open or close code. One closes what is open if it has the same mark, at least as often."""
    marks = told.where("k = 'fence'").select(key, "n", F.expr(SPARK.pick("line", rf"^{WS}{{0,3}}(`{{3,}}|~{{3,}})", 1)).alias("mark"))

    def step(state: str | None, columns: list[list]) -> tuple[list[bool], list[list], str]:
        opened, edges, opens = state or "", [], []
        for mark in columns[0]:
            edges.append(not opened or mark.startswith(opened))
            opens.append(not opened)
            if edges[-1]:
                opened = "" if opened else mark
        return edges, [opens], opened

    return folded(marks, [key], ["n"], ["mark"], step, [("opens", "boolean")]).select(key, "n", "opens")


def resolved(told: DataFrame, key: str) -> DataFrame:
    """Lines with ``r``: what each is where it stands, and ``region``, the number of its code.

    What may underline a title does so where a paragraph is open before it; else it is a rule, an item, or text, by
    itself. Only one that is text by itself turns what the next one meets, so that a run of them alternates from
    whatever the line before the run left open.
    """
    w = W.Window.partitionBy(key).orderBy("n")
    upto = w.rowsBetween(W.Window.unboundedPreceding, 0)
    t = told.join(fence_edges(told, key), [key, "n"], "left")
    t = t.withColumn("region", F.count_if(F.coalesce("opens", F.lit(False))).over(upto))
    t = t.withColumn("closed", F.coalesce(F.count_if(~F.coalesce("opens", F.lit(True))).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("k", F.when(F.col("region") > F.col("closed"), "code").otherwise(F.col("k")))
    t = t.withColumn("alone", F.when(column(P.is_rule, "line"), "rule").when(F.expr(SPARK.has("line", rf"^{WS}*[-*+]{WS}")), "item").otherwise("text"))
    t = t.withColumn("turns", (F.col("k") == "underline") & (F.col("alone") == "text"))
    t = t.withColumn("fixed", F.sum((~F.col("turns")).cast("int")).over(upto))
    run = W.Window.partitionBy(key, "fixed").orderBy("n")
    opened = F.max((F.col("k") == "text").cast("int")).over(W.Window.partitionBy(key, "fixed"))
    turned = F.count_if("turns").over(run.rowsBetween(W.Window.unboundedPreceding, 0))
    t = t.withColumn("leaves", (opened + turned) % 2 == 1)
    t = t.withColumn("meets", F.coalesce(F.lag("leaves").over(w), F.lit(False)))
    return t.withColumn("r", F.when(F.col("k") != "underline", F.col("k")).when(F.col("meets"), "setext").otherwise(F.col("alone")))


def blocks_of_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, block_no, kind, level, start, end, text) from lines (key, n, start, end, line)."""
    w = W.Window.partitionBy(key).orderBy("n")
    told = rows.withColumn("k", column(P.markdown_kind, "line"))
    t = resolved(told, key)
    before = F.lag(F.struct("r", "region")).over(w)
    goes_on = ((before["r"] == "text") & F.col("r").isin("text", "setext")) | ((before["r"] == F.col("r")) & ((F.col("r") == "quote") | ((F.col("r") == "code") & (before["region"] == F.col("region")))))
    t = t.withColumn("_block", F.sum(((F.col("r") != "blank") & ~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w)).where("r <> 'blank'")
    heading = SPARK.pick("line", rf"^{WS}{{0,3}}#{{1,6}}{WS}+(.*?){WS}*#*{WS}*$", 1)
    part = f"""case r when 'heading' then {heading} when 'quote' then {SPARK.sub("line", f"^{WS}{{0,3}}>{WS}?")} when 'item' then {SPARK.sub("line", rf"^{WS}*(?:[-*+]|{ND}+[.)]){WS}+")} when 'text' then line else '' end"""
    t = t.withColumn("part", F.expr(T.strip(SPARK, part)))
    body = F.when((F.col("r") == "code") & F.col("opens").isNull(), F.struct("n", "line"))
    t = t.groupBy(key, "_block").agg(
        F.min("n").alias("first"), F.min("r").alias("r"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max(F.when(F.col("r") == "heading", F.expr(P.markdown_level(SPARK, "line"))).when(F.col("r") == "setext", F.expr(f"case when {SPARK.has('line', '=')} then 1 else 2 end")).when(F.col("r") == "item", F.expr(ITEM_LEVEL)).otherwise(0)).alias("level"),
        F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("n", "part")))).alias("parts"), F.array_sort(F.collect_list(body)).alias("body"),
        F.max(F.when(body.isNotNull() & ~column(P.is_blank, "line"), F.col("n"))).alias("last"),
    )
    t = t.withColumn("joined", F.array_join(F.transform("parts", lambda x: x["part"]), " "))
    code = F.array_join(F.transform(F.filter("body", lambda x: x["n"] <= F.col("last")), lambda x: x["line"]), "\n")
    t = with_steps(t.withColumn("code", F.coalesce(code, F.lit(""))), T.inline_steps(SPARK, "joined", "inline"))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("r"))
    t = t.select(key, "first", kind.alias("kind"), "level", "start", "end", F.when(F.col("r") == "code", F.col("code")).otherwise(F.col("inline")).alias("text"))
    t = t.where("kind <> 'paragraph' or text <> ''")
    return t.select(key, (F.row_number().over(W.Window.partitionBy(key).orderBy("first")) - 1).alias("block_no"), "kind", "level", "start", "end", "text")


ITEM_LEVEL = f"""1 + length({SPARK.pick("line", f"^({WS}*)", 1)}) div 2"""


def markdown_blocks(texts: DataFrame, key: str) -> DataFrame:
    """(key, block_no, kind, level, start, end, text) of markdown texts (key, text)."""
    rows = lines(texts.select(F.col(key).alias("book_id"), "text"))
    return blocks_of_lines(rows, "book_id").withColumnRenamed("book_id", key)

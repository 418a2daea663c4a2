"""Preference formatting of conversation pairs (DataFrame functions only).

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the prompt;
what follows in either is its completion, with the character spans of assistant turns as loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text in which no mark can be forged: `<|` gets a backslash between its characters; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def role_name(role: Column) -> Column:
    """A role that doesn't end its mark early: escaped, and `|>` gets a backslash too."""
    return F.replace(escaped(role), F.lit("|>"), F.lit("|\\>"))


def rendered(role: Column, text: Column) -> Column:
    """One turn as text: role and text between fixed marks."""
    return F.concat(F.lit("<|"), role_name(role), F.lit("|>\n"), escaped(text), F.lit("<|end|>\n"))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per distinct pair: pair_id, n_prefix, prompt, and for side chosen and rejected <side>, <side>_mask.

    turns: conv_id, turn, role, text; pairs: pair_id, chosen_id, rejected_id. The prompt is the longest run of equal
    first turns (role and text, nulls equal) of both, short of the last turn where one conversation is a prefix of
    the other or both are equal, so that a completion exists for whichever has an assistant turn left. <side>_mask
    lists start:end of the assistant turns' texts in the completion (code points, comma-joined). Turns are taken in
    order of turn, then role and text, and numbered anew, so gaps don't matter; turns repeated in all columns are
    one turn. Marks within texts and roles are escaped, so that no text forges a turn. A missing or null conversation
    has no turns: no common prefix, an empty completion; turns without a conversation are in no pair. Pairs of null
    ids keep their row. Texts of any length are whole, other columns are left out, empty tables give no rows.
    """
    each = conversations(turns)
    side = lambda name: each.select(F.col("conv_id").alias(f"{name}_id"), F.col("list").alias(name))
    rows = pairs.select("pair_id", "chosen_id", "rejected_id").distinct()
    rows = rows.join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    return formatted(rows.select("pair_id", "chosen", "rejected"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, list): the distinct turns of each conversation in order. One row holds a conversation: it is one training
    example, so it fits a row."""
    item = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(item)).alias("list"))


def formatted(rows: DataFrame) -> DataFrame:
    """preference_pairs() of rows(pair_id, chosen, rejected), arrays of turns (turn, role, text) in order, or null."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    rows = rows.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(
        F.slice("chosen", F.lit(1), shorter),
        F.slice("rejected", F.lit(1), shorter),
        lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]),
    )
    differs = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    common = F.when(differs > 0, differs - 1).otherwise(F.greatest(shorter - 1, F.lit(0)))
    rows = rows.withColumn("n_prefix", common.cast("int"))
    text_of = lambda list_: F.array_join(F.transform(list_, lambda t: rendered(t["role"], t["text"])), "")

    def completion(name: str) -> list[Column]:
        rest = F.slice(name, F.col("n_prefix") + 1, F.size(name))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            first = acc["at"] + F.length(role_name(t["role"])) + 5
            span = F.concat(first.cast("string"), F.lit(":"), (first + F.length(escaped(t["text"]))).cast("string"))
            spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct((acc["at"] + F.length(rendered(t["role"], t["text"]))).cast("int").alias("at"), spans.alias("spans"))

        mask = F.aggregate(rest, start, step, lambda acc: F.array_join(acc["spans"], ","))
        return [text_of(rest).alias(name), mask.alias(f"{name}_mask")]

    prompt = text_of(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt")
    return rows.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), prompt, *completion("chosen"), *completion("rejected"))


def answers_compared(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of every conversation: its turns, and the same turns before its last assistant turn with
    the last assistant text of the next conversation (by id plus one) in its place, or none if there is none."""
    each = conversations(turns)
    # The list's order puts null texts first, so its last assistant turn is the greatest.
    answer = F.element_at(F.filter("list", lambda t: t["role"] == "assistant"), -1)
    said = each.withColumn("answer", F.when(F.exists("list", lambda t: t["role"] == "assistant"), answer))
    other = said.where("answer is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.array(F.col("answer.text")).alias("other"))
    rows = said.join(other, "conv_id", "left")
    before = F.filter("list", lambda t: t["turn"] < F.col("answer.turn"))
    reply = F.transform("other", lambda x: F.struct(F.col("answer.turn").alias("turn"), F.lit("assistant").alias("role"), x.alias("text")))
    rejected = F.when(F.col("answer").isNotNull(), F.concat(before, F.coalesce(reply, F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("list").alias("chosen"), rejected.alias("rejected"))


def op9_preference_pairs(spark, sf_dir: str) -> DataFrame:
    """Every conversation (chosen) against the one that ends with the next conversation's last answer (rejected)."""
    return formatted(answers_compared(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP9_SQL = r"""
WITH u AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, turn AS last, text AS answer FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) AS place FROM u WHERE role = 'assistant') WHERE place = 1
), both_sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM u
  UNION ALL SELECT u.conv_id, 1, turn, role, text FROM u JOIN ends e ON u.conv_id = e.conv_id AND u.turn < e.last
  UNION ALL SELECT e.conv_id, 1, e.last, 'assistant', n.answer FROM ends e JOIN ends n ON n.conv_id = e.conv_id + 1
), t AS (
  SELECT pair_id, side, role, text, replace(replace(coalesce(role, ''), '<|', '<\|'), '|>', '|\>') AS name, replace(coalesce(text, ''), '<|', '<\|') AS body,
         row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT DISTINCT * FROM both_sides)
), sizes AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM t GROUP BY 1
), differ AS (
  SELECT a.pair_id, min(a.n) AS n
  FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.n = b.n AND a.side = 0 AND b.side = 1
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1
), prefix AS (
  SELECT s.pair_id, CASE WHEN d.n IS NOT NULL THEN d.n - 1 ELSE greatest(least(n0, n1) - 1, 0) END AS n_prefix
  FROM sizes s LEFT JOIN differ d ON s.pair_id = d.pair_id
), r AS (
  SELECT t.*, p.n_prefix, '<|' || name || '|>' || chr(10) || body || '<|end|>' || chr(10) AS line, length(name) + 5 AS lead_in
  FROM t JOIN prefix p ON t.pair_id = p.pair_id
), placed AS (
  SELECT *, coalesce(sum(length(line)) FILTER (n > n_prefix) OVER (
      PARTITION BY pair_id, side ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + lead_in AS first
  FROM r
)
SELECT pair_id, CAST(any_value(n_prefix) AS BIGINT) AS n_prefix,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND n <= n_prefix), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND n > n_prefix), '') AS chosen,
  coalesce(string_agg(CAST(first AS BIGINT) || ':' || CAST(first + length(body) AS BIGINT), ',' ORDER BY n)
    FILTER (side = 0 AND n > n_prefix AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 1 AND n > n_prefix), '') AS rejected,
  coalesce(string_agg(CAST(first AS BIGINT) || ':' || CAST(first + length(body) AS BIGINT), ',' ORDER BY n)
    FILTER (side = 1 AND n > n_prefix AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""

"""Chat formatting with multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What closes every message; the mask of a trained message covers its text and this.
END = "<|end|>\n"
SYSTEM, ASSISTANT, USER, USER_END = "<|system|>\n", "<|assistant|>\n", "<|user name=", "|>\n"


def escape(text: Column) -> Column:
    """``text`` in which nothing reads as a control mark: a backslash comes between ``<`` or the backslashes after it and
    ``|``, and likewise before the ``>`` of ``|>``. Taking one backslash out of each such run gives the text back."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|"), r"\|(\\*)>", r"|\\$1>")


def rotate(turns: DataFrame, part_messages: int = 512) -> DataFrame:
    """Every dialogue once for each participant, who speaks as the assistant while all others are named users.

    ``turns``: conv_id, turn, role, text. Returns conv_id, perspective, part, start, n_turns, text, mask, n_masked. A
    rendering is one text, delivered in parts of ``part_messages`` messages in order of ``part``: ``start`` is where the part
    begins in the rendering, and ``mask`` lists the character ranges ``start-end`` of the trained messages within the
    whole rendering. Messages, those of roles named system among them, stand once each at their place; dialogues of up to
    ``part_messages`` messages are one part. Parts go by the rank of a message, whatever its turn number.

    Control marks in texts and roles are escaped. A null role speaks as ``unknown``; null texts are empty; rows without
    conv_id are left out; ties and repeated rows are all kept, in order of turn (null last), role and text. A
    dialogue of system messages alone and an empty table give no rows; extra columns are ignored. A participant silent
    in a part has a row there without a mask, since the rendering goes on.

    Ranks come from a range partitioning by the whole order: each conversation is counted within and across partitions,
    so that no dialogue, however long, meets in one task.
    """
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]
    ranged = materialize(own.repartitionByRange("conv_id", *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("conv_id").alias("_c"), F.col("_p").alias("_q"), (F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_p")) - F.col("_n")).alias("_before"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id", "_p").orderBy(*order)))
    rank = F.col("_before") + F.col("_r") - 1
    said = ranked.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("_p") == F.col("_q"))).select("conv_id", rank.alias("rank"), (rank / part_messages).cast("long").alias("part"), "role", F.concat(escape(F.col("text")), F.lit(END)).alias("text"))
    said = said.withColumn("name", F.concat(F.lit(USER), escape(F.col("role")), F.lit(USER_END)))
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "name", "text"))).alias("m"))
    people = own.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    both = parts.join(people, "conv_id")

    # where later parts begin: the lengths of the parts before, with the perspective's own heads as the assistant's
    long_ones = said.where("part > 0").select("conv_id").distinct()
    plain = F.length("text") + F.when(F.col("role") == "system", len(SYSTEM)).otherwise(F.length("name"))
    many = said.join(long_ones, "conv_id", "left_semi")
    lengths = many.groupBy("conv_id", "part").agg(F.sum(plain).alias("_all"))
    shifts = many.where("role <> 'system'").groupBy("conv_id", "part", F.col("role").alias("perspective")).agg(F.sum(F.length("name") - len(ASSISTANT)).alias("_less"))
    grid = lengths.join(people, "conv_id").join(shifts, ["conv_id", "part", "perspective"], "left")
    upto = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = grid.select("conv_id", "part", "perspective", F.coalesce(F.sum(F.col("_all") - F.coalesce("_less", F.lit(0))).over(upto), F.lit(0)).alias("start"))
    both = both.join(starts, ["conv_id", "part", "perspective"], "left").withColumn("start", F.coalesce("start", F.lit(0)).cast("long"))

    mine = lambda x: x["role"] == F.col("perspective")
    head = lambda x: F.when(x["role"] == "system", F.lit(SYSTEM)).when(mine(x), F.lit(ASSISTANT)).otherwise(x["name"])
    shown = F.transform("m", lambda x: F.struct(head(x).alias("h"), x["text"].alias("t"), mine(x).alias("mine")))
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["h"])
        end = begin + F.length(x["t"])
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(x["mine"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"), (acc["n"] + F.when(x["mine"], F.length(x["t"])).otherwise(0)).cast("long").alias("n"))

    out = both.select("conv_id", "perspective", "part", "start", F.size("m").cast("long").alias("n_turns"), shown.alias("s"))
    out = out.withColumn("f", F.aggregate("s", first, step))
    return out.select("conv_id", "perspective", "part", "start", "n_turns", F.array_join(F.transform("s", lambda x: F.concat(x["h"], x["t"])), "").alias("text"), F.array_join("f.spans", ",").alias("mask"), F.col("f.n").alias("n_masked"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 512 AS part,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (
  SELECT t.conv_id, p.perspective, t.part, t.k,
         CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              WHEN t.role = p.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(regexp_replace(t.role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) END AS h,
         regexp_replace(regexp_replace(t.text, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '<|end|>' || chr(10) AS b, t.role = p.perspective AS mine
  FROM t JOIN p ON t.conv_id = p.conv_id),
o AS (SELECT *, sum(length(h) + length(b)) OVER (PARTITION BY conv_id, perspective ORDER BY k) AS e FROM m)
SELECT conv_id, perspective, part, CAST(min(e - length(h) - length(b)) AS BIGINT) AS start, count(*) AS n_turns, string_agg(h || b, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(e - length(b) AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY k) FILTER (WHERE mine), '') AS mask,
       CAST(coalesce(sum(length(b)) FILTER (WHERE mine), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, perspective, part"""

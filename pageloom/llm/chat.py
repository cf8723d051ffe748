"""Operator 9: chat formatting for preference training.

A pair of conversations, chosen and rejected, is split at the longest run of
turns that both begin with. That run is rendered once, as the prompt; what is
left of each is rendered as its completion, with the spans of assistant text
that a loss may count. The prompt is masked as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table, written

# The marks of the format. A mark inside a text is broken up by a backslash.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BROKEN = r"<\|im_"
TRAINED = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit(BROKEN))


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) ordered by turn, then role, then text; nulls come first.

    A conversation becomes one row, since it is rendered as one text. Turns with null conv_id belong to none and are
    left out before turns are gathered.
    """
    turn = F.struct("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with in common; nulls are equal."""
    longest = F.least(F.size(a), F.size(b))
    differs = lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(places, differs)), longest)


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(role), F.lit("\n"))


def rendered(turns: Column) -> Column:
    one = lambda t: F.concat(_head(t["role"]), _safe(t["text"]), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def trained_spans(turns: Column) -> Column:
    """start:end of each assistant text with its closing mark, in code points of the rendered turns, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(_head(t["role"]))
        end = start + F.char_length(_safe(t["text"])) + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        more = F.when(t["role"].eqNullSafe(F.lit(TRAINED)), F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), more.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(pairs: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each (chosen_id, rejected_id) of pairs, with the conversations of threads().

    n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans. Without a rejected conversation (null or
    unknown id) the prompt is all turns before the last assistant one, and rejected and its spans are null. A pair of
    equal conversations has empty completions. Many pairs may share a conversation: the joins can split such a key.
    """
    chosen = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_a"))
    rejected = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("_b"))
    df = pairs.select("chosen_id", "rejected_id").join(chosen, "chosen_id")
    df = df.join(rejected, "rejected_id", "left")
    replies = F.filter(F.sequence(F.lit(0), F.size("_a") - 1), lambda i: F.get("_a", i)["role"].eqNullSafe(F.lit(TRAINED)))
    alone = F.coalesce(F.array_max(replies), F.size("_a"))
    n = F.when(F.col("_b").isNull(), alone).otherwise(common_turns(F.col("_a"), F.col("_b")))
    df = df.withColumn("_n", n)
    rest = lambda turns: F.slice(turns, F.col("_n") + 1, F.greatest(F.size(turns) - F.col("_n"), F.lit(0)))
    df = df.withColumns({"_p": F.slice("_a", F.lit(1), F.col("_n")), "_a": rest(F.col("_a")), "_b": rest(F.col("_b"))})
    return df.select(
        "chosen_id",
        "rejected_id",
        F.col("_n").cast("long").alias("n_prompt_turns"),
        rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_a")).alias("chosen"),
        rendered(F.col("_b")).alias("rejected"),
        trained_spans(F.col("_a")).alias("chosen_spans"),
        trained_spans(F.col("_b")).alias("rejected_spans"),
    )


def pairs_by_opening(convs: DataFrame) -> DataFrame:
    """Each conversation, as chosen, against the first (by id) of those that open with the same turn, as rejected.

    The first one itself, or one that shares its opening with none, has no rejected conversation. Openings are digests,
    counted before they are shuffled, so a common opening is no hot group.
    """
    first = F.get("turns", F.lit(0))
    opening = F.sha2(F.to_json(F.struct(first["role"].alias("r"), first["text"].alias("t"))), 256)
    opened = convs.select(F.col("conv_id").alias("chosen_id"), opening.alias("_opening"))
    firsts = written(opened.groupBy("_opening").agg(F.min("chosen_id").alias("_first")), "openings")
    rejected = F.when(F.col("_first") != F.col("chosen_id"), F.col("_first")).alias("rejected_id")
    return opened.join(firsts, "_opening").select("chosen_id", rejected)


def preference_pairs(conversations: DataFrame) -> DataFrame:
    convs = written(threads(conversations), "threads")
    return format_pairs(pairs_by_opening(convs), convs)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(table(spark, sf_dir, "conversations"))


def _safe_sql(x: str) -> str:
    return f"replace(coalesce({x}, ''), '<|im_', '{BROKEN}')"


_TURN_SQL = f"'{OPEN}' || {_safe_sql('role')} || chr(10) || {_safe_sql('text')} || '{CLOSE}' || chr(10)"
_HEAD_SQL = f"length('{OPEN}' || {_safe_sql('role')} || chr(10))"
_SIDE_SQL = f"""
SELECT chosen_id, string_agg(r, '' ORDER BY i) AS body,
       string_agg((pos + head) || ':' || (pos + length(r) - 1), ',' ORDER BY i) FILTER (role = '{TRAINED}') AS spans
FROM (SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY chosen_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM (SELECT p.chosen_id, t.i, t.role, {_TURN_SQL} AS r, {_HEAD_SQL} AS head FROM n p JOIN t ON t.conv_id = p.{{side}} WHERE t.i > p.n)) GROUP BY chosen_id"""
OP9_SQL = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS size, max(i) FILTER (role = '{TRAINED}') AS reply FROM t GROUP BY conv_id),
o AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY role, text) AS first FROM t WHERE i = 1),
p AS (SELECT conv_id AS chosen_id, CASE WHEN first <> conv_id THEN first END AS rejected_id FROM o),
x AS (SELECT p.chosen_id, min(a.i) AS i FROM p JOIN t a ON a.conv_id = p.chosen_id LEFT JOIN t b ON b.conv_id = p.rejected_id AND b.i = a.i
      WHERE p.rejected_id IS NOT NULL AND (b.i IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) GROUP BY p.chosen_id),
n AS (SELECT p.*, CASE WHEN p.rejected_id IS NULL THEN coalesce(s.reply - 1, s.size) ELSE coalesce(x.i - 1, s.size) END AS n
      FROM p JOIN s ON s.conv_id = p.chosen_id LEFT JOIN x USING (chosen_id)),
q AS (SELECT n.chosen_id, string_agg({_TURN_SQL}, '' ORDER BY i) AS prompt FROM n JOIN t ON t.conv_id = n.chosen_id AND t.i <= n.n GROUP BY n.chosen_id),
a AS ({_SIDE_SQL.format(side="chosen_id")}),
b AS ({_SIDE_SQL.format(side="rejected_id")})
SELECT n.chosen_id, n.rejected_id, CAST(n.n AS BIGINT) AS n_prompt_turns, coalesce(q.prompt, '') AS prompt, coalesce(a.body, '') AS chosen,
       CASE WHEN n.rejected_id IS NOT NULL THEN coalesce(b.body, '') END AS rejected, coalesce(a.spans, '') AS chosen_spans,
       CASE WHEN n.rejected_id IS NOT NULL THEN coalesce(b.spans, '') END AS rejected_spans
FROM n LEFT JOIN q USING (chosen_id) LEFT JOIN a USING (chosen_id) LEFT JOIN b USING (chosen_id)
"""

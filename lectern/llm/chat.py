"""Operator 3: preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt. What
follows is rendered for each side as a completion with a mask in run lengths: ``1:n`` marks ``n``
characters that are trained on (an assistant's words and their end mark), ``0:n`` characters
that are not (headers, and turns of others). The lengths of a mask add up to its completion's.

A table without preferences is turned into pairs by ``with_answers_of_others``: each conversation up to its last
answer is chosen, and the same with the last answer of another conversation in its place is rejected, so that
all turns before it are the shared prefix, which is then found as in any other pair.

A pair's two conversations make one training example and so one row; rows are grouped by pair
only. Defined results: turns are ordered by turn, then role, then text (nulls first), repeated turns count;
a null role or text counts as empty; a turn of a null conversation, a conversation without an answer, and one without a
partner give no row; equal conversations give empty completions; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import settle, table
from lectern.llm.decontam import sized
from lectern.operators.order import numbered

END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(t["text"]) + len(END)
        count = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
        return F.when(t["role"] == TRAINED_ROLE, F.concat_ws(",", count("0:", head), count("1:", body))).otherwise(count("0:", head + body))

    return F.array_join(F.transform(turns, runs), ",")


def format_pairs(sides: DataFrame) -> DataFrame:
    """One row for each pair from turns with ``pair_id``, ``side`` ('chosen' or 'rejected'), ``turn``, ``role``, ``text``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, turn)))
    pairs = sides.where("pair_id is not null").groupBy("pair_id").agg(of("chosen").alias("a"), of("rejected").alias("b"))
    return format_turns(pairs.where((F.size("a") > 0) & (F.size("b") > 0)))


def format_turns(pairs: DataFrame) -> DataFrame:
    """One row for each pair from ``pair_id`` and the turns (arrays of turn, role, text) of ``a``, the chosen, and ``b``, the rejected conversation."""
    both = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, both), F.slice("b", 1, both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first_other = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("shared", F.when(first_other == 0, both).otherwise(first_other - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.size(c))
    return pairs.select(
        "pair_id",
        F.col("shared").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice("a", 1, F.col("shared"))).alias("prompt"),
        _rendered(rest("a")).alias("chosen"),
        _mask(rest("a")).alias("chosen_mask"),
        _rendered(rest("b")).alias("rejected"),
        _mask(rest("b")).alias("rejected_mask"),
    )


def pair_up(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns with ``pair_id`` and ``side``, for a table of pairs with ``pair_id``, ``chosen`` and ``rejected`` ids."""
    ends = pairs.select("pair_id", F.explode(F.map_from_arrays(F.array(F.lit("chosen"), F.lit("rejected")), F.array("chosen", "rejected"))).alias("side", "side_id"))
    return turns.join(ends.hint("merge"), F.col(id_col) == F.col("side_id")).select("pair_id", "side", "turn", "role", "text")


def _last_answer(turns: Column) -> Column:
    """The place of the last turn of the trained role, from 1; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1).otherwise(0))), F.lit(0))


def with_answers_of_others(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``pair_id`` (a conversation's id), ``a`` and ``b`` for ``format_turns``, of turns with ``id_col, turn, role, text``.

    Conversations with an answer are numbered by id, two neighbours each (at the end three) are one group, and each is
    answered by the next of its group. So every conversation with an answer has a row, unless it is the only one.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    ids = settle(rows.where(F.col("role") == TRAINED_ROLE).select("id").distinct())
    total = ids.count()
    group = F.floor((F.least(F.col("rank"), F.lit(max(total - total % 2, 1))) - 1) / 2)
    members = settle(numbered(ids, [], [F.col("id")], "rank").select(F.col("id").alias("member"), "rank", group.alias("of")))
    held = rows.join(sized(members, total), F.col("id") == F.col("member")).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "turn", "role", "text"))).alias("all"))
    ranks = F.array_distinct(F.transform("all", lambda t: F.struct(t["rank"].alias("rank"), t["id"].alias("id"))))
    each = held.withColumn("ranks", ranks).where(F.size("ranks") > 1).select("all", "ranks", F.posexplode("ranks").alias("k", "me"))
    own = lambda r: F.transform(F.filter("all", lambda t: t["rank"] == r), lambda t: F.struct(t["turn"], t["role"], t["text"]))
    other = F.get("ranks", (F.col("k") + 1) % F.size("ranks"))["rank"]
    each = each.select(F.col("me.id").alias("pair_id"), own(F.col("me.rank")).alias("mine"), own(other).alias("theirs"))
    each = each.withColumns({"last": _last_answer(F.col("mine")), "answer": F.get("theirs", _last_answer(F.col("theirs")) - 1)})
    before = F.slice("mine", F.lit(1), F.col("last") - 1)
    return each.select("pair_id", F.slice("mine", F.lit(1), F.col("last")).alias("a"), F.concat(before, F.array(F.struct(F.get("mine", F.col("last") - 1)["turn"].alias("turn"), F.col("answer.role"), F.col("answer.text")))).alias("b"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences: each conversation's own last answer is preferred to another's."""
    return format_turns(with_answers_of_others(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    run = "CASE WHEN t.role = 'assistant' THEN '0:' || (length(t.role) + 5) || ',1:' || (length(t.text) + 8) ELSE '0:' || (length(t.role) + length(t.text) + 13) END"
    shown = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"
    mask = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: {run}), ','), '')"
    return f"""
WITH t AS (SELECT conv_id AS id, {{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT id, list(x ORDER BY x.turn, x.role, x.text) AS l FROM t GROUP BY 1),
c AS (SELECT id, l, list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i].role = 'assistant' THEN i ELSE 0 END)) AS last FROM l),
r AS (SELECT *, row_number() OVER (ORDER BY id) AS rank, count(*) OVER () AS total FROM c WHERE last > 0),
q AS (SELECT *, CASE WHEN total % 2 = 1 AND rank = total THEN total - 2 WHEN total % 2 = 1 AND rank = total - 1 THEN total WHEN rank % 2 = 1 THEN rank + 1 ELSE rank - 1 END AS next FROM r WHERE total > 1),
p AS (SELECT q.id AS pair_id, q.l[1:q.last] AS a, list_concat(q.l[1:q.last - 1], [{{'turn': q.l[q.last].turn, 'role': o.l[o.last].role, 'text': o.l[o.last].text}}]) AS b, q.last AS m FROM q JOIN q o ON o.rank = q.next),
d AS (SELECT *, list_transform(range(1, m + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text) AS same FROM p),
n AS (SELECT *, CASE WHEN list_contains(same, false) THEN list_position(same, false) - 1 ELSE m END AS k FROM d)
SELECT pair_id, k AS n_prompt_turns, {shown("a[1:k]")} AS prompt, {shown("a[k+1:]")} AS chosen, {mask("a[k+1:]")} AS chosen_mask,
{shown("b[k+1:]")} AS rejected, {mask("b[k+1:]")} AS rejected_mask FROM n
"""


OP3_SQL = _sql()

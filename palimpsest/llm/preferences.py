"""Preference formatting of chosen and rejected conversations.

Native plan: the longest common turn prefix of the two is rendered once, as the
prompt; what is left of each is rendered as its completion, with the character
spans that a loss may count (what the assistant says, and its end mark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import park, unused

#: A turn is rendered as OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): the turns of each conversation, an array of (role, text) in order.

    Rows without an id or a turn number have no place and are left out; of several
    rows for one turn the smallest (role, text) counts; a null role or text is
    empty.  Other columns are not looked at.
    """
    said = F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.where(F.col(id).isNotNull() & F.col(turn).isNotNull()).select(F.col(id).alias("id"), F.col(turn).alias("turn"), said.alias("said"))
    one = rows.groupBy("id", "turn").agg(F.min("said").alias("said"))
    return one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("t")).select("id", F.transform("t", lambda x: x["said"]).alias("turns"))


def reply_pairs(talks: DataFrame) -> DataFrame:
    """A pair for each conversation with an assistant turn: up to its last one, against the same with the user's last words echoed in place of that answer."""
    answers = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == ASSISTANT, i + 1).otherwise(0)), lambda n: n > 0)
    rows = talks.withColumn("k", F.coalesce(F.array_max(answers), F.lit(0))).where("k > 0")
    before = F.slice("turns", 1, F.col("k") - 1)
    asked = F.coalesce(F.try_element_at(F.filter(before, lambda x: x["role"] == "user"), F.lit(-1))["text"], F.lit(""))
    echo = F.array(F.struct(F.lit(ASSISTANT).alias("role"), asked.alias("text")))
    return rows.select(F.lit("reply").alias("kind"), F.col("id").alias("chosen_id"), F.col("id").alias("rejected_id"), F.slice("turns", 1, F.col("k")).alias("chosen"), F.concat(before, echo).alias("rejected"))


def sibling_pairs(talks: DataFrame) -> DataFrame:
    """Pairs of conversations with the same first turn: the one with the most assistant text (then of the smallest id) against each other one.

    A group of n gives n - 1 pairs.
    """
    said = F.aggregate("turns", F.lit(0), lambda n, x: n + F.when(x["role"] == ASSISTANT, F.length(x["text"])).otherwise(0))
    first = F.element_at("turns", 1)
    rows = talks.select("id", "turns", first["role"].alias("role"), first["text"].alias("text"), said.alias("said"))
    best = rows.groupBy("role", "text").agg(F.min(F.struct((-F.col("said")).alias("said"), "id")).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = park(best.select("role", "text", F.col("best.id").alias("chosen_id")), "best")  # read from a table, so that the join can split a hot first turn
    others = rows.select(F.col("id").alias("rejected_id"), F.col("turns").alias("rejected"), "role", "text").join(best, ["role", "text"]).where("chosen_id <> rejected_id")
    chosen = talks.select(F.col("id").alias("chosen_id"), F.col("turns").alias("chosen"))
    return others.join(chosen, "chosen_id").select(F.lit("sibling").alias("kind"), "chosen_id", "rejected_id", "chosen", "rejected")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """The spans [start, end) of what the assistant says in the rendered turns."""
    kind = "struct<at: int, spans: array<struct<start: int, end: int>>>"
    begin = F.from_json(F.lit('{"at": 0, "spans": []}'), kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["role"]) + len(OPEN) + len(CLOSE)
        end = start + F.length(x["text"]) + len(END)
        more = F.when(x["role"] == ASSISTANT, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.filter(acc["spans"], lambda _: F.lit(False)))
        return F.struct(end.alias("at"), F.concat(acc["spans"], more).alias("spans"))

    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with its arrays chosen and rejected of (role, text) rendered.

    prompt_turns counts the turns of the longest common prefix, prompt renders
    them; chosen and rejected become the completions, chosen_spans and
    rejected_spans the characters of each that train.  A null conversation counts
    as empty; equal conversations leave both completions empty.  Columns of these
    names are replaced, all others stay; an empty table stays empty.
    """
    none = F.filter(F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text"))), lambda _: F.lit(False))
    c, r = unused(pairs, "chosen"), unused(pairs, "rejected")
    rows = pairs.withColumns({c: F.coalesce(F.col(f"`{chosen}`"), none), r: F.coalesce(F.col(f"`{rejected}`"), none)})
    same = F.array_position(F.zip_with(c, r, lambda a, b: a.eqNullSafe(b)), False)
    rows = rows.withColumn("prompt_turns", F.when(same > 0, same - 1).otherwise(F.least(F.size(c), F.size(r))).cast("int"))
    rest = {k: F.slice(k, F.col("prompt_turns") + 1, F.size(k)) for k in (c, r)}
    rows = rows.withColumns({"prompt": _render(F.slice(c, 1, F.col("prompt_turns"))), **rest})
    return rows.withColumns({chosen: _render(F.col(c)), rejected: _render(F.col(r)), f"{chosen}_spans": _spans(F.col(c)), f"{rejected}_spans": _spans(F.col(r))}).drop(c, r)


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = park(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "talks")  # read three times
    out = preferences(reply_pairs(talks).unionAll(sibling_pairs(talks)))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("kind", "chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_mask"), spans("rejected_spans").alias("rejected_mask"))


_SHOWN = "'<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)"


def _mask(c: str) -> str:
    width = f"list_sum(list_transform({c}[1:%s], lambda y: length(y.role) + length(y.text) + {len(OPEN) + len(CLOSE) + len(END)}))"
    start = f"coalesce({width % 'i - 1'}, 0) + length({c}[i].role) + {len(OPEN) + len(CLOSE)}"
    return f"array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: {c}[i].role = '{ASSISTANT}'), lambda i: CAST(CAST({start} AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({width % 'i'} AS BIGINT) AS VARCHAR)), ',')"


OP8_SQL = f"""
WITH one AS (
  SELECT conv_id, turn, min(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), talk AS (
  SELECT conv_id AS id, list(said ORDER BY turn) AS turns FROM one GROUP BY conv_id
), answered AS (
  SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = '{ASSISTANT}')) AS k FROM talk
), asked AS (
  SELECT *, coalesce(list_filter(turns[1:k - 1], lambda x: x.role = 'user')[-1].text, '') AS echo FROM answered WHERE k IS NOT NULL
), scored AS (
  SELECT *, coalesce(list_sum(list_transform(turns, lambda x: CASE WHEN x.role = '{ASSISTANT}' THEN length(x.text) ELSE 0 END)), 0) AS said FROM talk
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY turns[1] ORDER BY said DESC, id) AS r, first_value(id) OVER (PARTITION BY turns[1] ORDER BY said DESC, id) AS best FROM scored
), pairs AS (
  SELECT 'reply' AS kind, id AS chosen_id, id AS rejected_id, turns[1:k] AS c,
         list_concat(turns[1:k - 1], [struct_pack(role := '{ASSISTANT}', text := echo)]) AS r FROM asked
  UNION ALL
  SELECT 'sibling', b.id, a.id, b.turns, a.turns FROM ranked a JOIN talk b ON b.id = a.best WHERE a.r > 1
), cut AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS INTEGER) AS n FROM pairs
), parts AS (
  SELECT kind, chosen_id, rejected_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM cut
)
SELECT kind, chosen_id, rejected_id, n AS prompt_turns,
       array_to_string(list_transform(p, lambda x: {_SHOWN}), '') AS prompt,
       array_to_string(list_transform(c, lambda x: {_SHOWN}), '') AS chosen,
       array_to_string(list_transform(r, lambda x: {_SHOWN}), '') AS rejected,
       {_mask("c")} AS chosen_mask, {_mask("r")} AS rejected_mask
FROM parts
"""

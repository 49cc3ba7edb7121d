"""Chat formatting: reply trees to conversations in a training template.

Paths from root to leaf are enumerated by iterative self-joins that double the
distance in each round, so that a chain of n replies takes log2(n) joins. Paths
of a tree are ranked by the sum of their messages' scores; each chosen path is
written as one conversation with a loss mask over the assistant's texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geospan.llm.common import arrow_schema, checkpointed, lean, sha256_hex

# The template.
START, END, TAIL = "<|im_start|>", "<|im_end|>", "\n"
#: The role whose texts are trained on.
LEARNT = "assistant"
_TO_ESCAPE, _ESCAPED = re.compile(r"<(\**)\|"), re.compile(r"<\*(\**)\|")


def escape(text: str) -> str:
    """One star more in each ``<*...*|``: no control string is left, and ``unescape`` gives the text again."""
    return _TO_ESCAPE.sub(r"<\1*|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation in the template, and the spans under the loss mask (code points, end exclusive)."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == LEARNT:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, TAIL]
        at += len(head) + len(body) + len(END) + len(TAIL)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition("\n")
        turns.append((_role_in(role), unescape(rest[: rest.rindex(END)])))
    return turns


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees.

    ``nodes``: ``node string, parent string`` (null: a root), ids unique over all
    trees. Returns ``leaf, node, up``: each node on the way from the leaf, ``up``
    steps above it. A reply to a missing message starts a tree of its own;
    messages that reply in a circle have no root and are on no path.
    """
    nodes = checkpointed(nodes.select("node", "parent"))
    known = nodes.select(F.col("node").alias("parent"))
    jump = checkpointed(nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("to")))
    leaves = nodes.join(jump.select(F.col("to").alias("node")).distinct(), "node", "left_anti")
    found = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    most = max(1, nodes.count()).bit_length() + 1
    for _ in range(most):
        if jump.isEmpty():
            break
        higher = found.join(jump, "node").select("leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        found = checkpointed(found.unionByName(higher))
        jump = checkpointed(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", "b.to"))
        step *= 2
    return found


def conversations(messages: DataFrame, best: int | None = 1, score: Column | None = None, unique: bool = False) -> DataFrame:
    """The chosen paths of reply trees, written in the template.

    ``messages``: ``tree, node, parent, role, text`` as strings and, if ``score``
    is null, a double ``score`` (null: 0). The ``best`` paths of each tree by the
    sum of scores (ties: the smaller leaf id; None: all paths) are returned as
    ``tree, leaf, rank, n_turns, formatted, mask`` with ``mask`` the starts and
    ends of the spans to learn from. Null role or text counts as empty, and so do
    a null tree's and node's ids. A message replies within its tree only, so trees
    may use the same ids; of messages that share tree and node the first by
    parent, role, text and score counts (``unique``: there are none, don't look).
    A conversation is one row of the result, and must fit in one.
    """
    rows = messages.select(F.coalesce("tree", F.lit("")).alias("tree"), F.coalesce("node", F.lit("")).alias("own"), "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(score if score is not None else F.col("score"), F.lit(0.0)).alias("score"))
    if not unique and not rows.groupBy("tree", "own").count().where("count > 1").isEmpty():
        rows = rows.groupBy("tree", "own").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "own", "m.*")
    key = lambda c: F.concat("tree", F.lit("\0"), c)
    rows = rows.select(key("own").alias("node"), key("parent").alias("parent"), "tree", "role", "text", "score")
    ways = paths(rows)
    weight = rows.select("node", "tree", "score")
    ranked = ways.join(weight, "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.sum("score").alias("total"), F.count("*").alias("n"))
    if best is not None:
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("rank") <= best)
    else:
        ranked = ranked.withColumn("rank", F.lit(None).cast("int"))
    chosen = ways.join(ranked.select("leaf", "rank"), "leaf").join(rows.drop("score"), "node")
    whole = chosen.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    whole = whole.withColumn("leaf", F.expr("substring(leaf, length(tree) + 2)"))
    ddl = "tree string, leaf string, rank int, n_turns long, formatted string, mask array<long>"
    schema = arrow_schema(ddl)

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                done = [render((t["role"], t["text"]) for t in row["turns"]) for row in part]
                yield pa.RecordBatch.from_pylist([{"tree": r["tree"], "leaf": r["leaf"], "rank": r["rank"], "n_turns": len(r["turns"]), "formatted": text, "mask": [x for span in mask for x in span]} for r, (text, mask) in zip(part, done, strict=True)], schema=schema)

    return whole.select("tree", "leaf", "rank", "turns").mapInArrow(lean(write), ddl)


def as_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as reply trees: each turn replies to the one before it.

    Turns are taken in the order of turn number (null first), then role, then
    text; turns with the same number, and repeated rows, stay separate turns.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("tree"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order))
    key = lambda n: F.concat_ws("/", "tree", n.cast("string"))
    return rows.select("tree", key(F.col("n")).alias("node"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Read each formatted conversation back: turns, the text under the loss mask, and sizes.

    A conversation without an id has a null ``conv_id``; an empty table gives no rows.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(ddl)

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for tree, text, mask in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    turns = read_back(text)
                    learnt = "".join(unescape(text[s:e]) for s, e in zip(mask[::2], mask[1::2], strict=True))
                    rows.append({"conv_id": int(tree) if tree else None, "n_turns": len(turns), "turns_sha256": sha256_hex("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(learnt), "loss_sha256": sha256_hex(learnt), "formatted_chars": len(text)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return formatted.select("tree", "formatted", "mask").mapInArrow(lean(read), ddl)


#: DuckDB SQL for the query over ``conversations``.
DIGEST_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), parts AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\**)\|', '<\1*|', 'g') AS role_out,
         regexp_replace(text, '<(\**)\|', '<\1*|', 'g') AS text_out FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role_out) + 1 + length(text_out) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
"""

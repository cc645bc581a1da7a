"""Reply trees into training conversations: paths, branch scores, template and loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import prepare

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning in this or other templates. None occurs inside a formatted text.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"

_HEADS = "|".join(r"\Q" + c[0] + r"\E(?=\Q" + c[1:] + r"\E)" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_HEADS})", r"$1\\")


def unescape(text: Column) -> Column:
    """Of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"), ("\\", "%5C"))


def _escape_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables by doubling, and (tree, node, depth, path_score) of every node that has a root.

    Table k leads from a node to its ancestor 2^k steps up. Each round joins the last table with
    itself, so a path of n messages takes log2(n) rounds. Nodes on a cycle never reach a root.
    """
    up = nodes.select("tree", "node", F.col("parent").alias("above"), F.lit(1).alias("depth"), "score").checkpoint()
    total, steps, jumps = up.count(), 1, []
    while True:
        jumps.append(up.filter("above IS NOT NULL").select("tree", "node", "above"))
        open_ends = jumps[-1].isEmpty()
        if open_ends or steps > total:
            break
        on = up.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("next"),
            F.col("depth").alias("more"), F.col("score").alias("gain"),
        )
        up = (
            up.join(on, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n")), "left")
            .select(
                "tree", "node", F.col("next").alias("above"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
            )
            .checkpoint()
        )
        steps *= 2
    rooted = up.filter("above IS NULL").select("tree", "node", "depth", F.col("score").alias("path_score"))
    return jumps[:-1] if open_ends else jumps, rooted


def reply_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of (tree, node, parent, score, ..): (tree, leaf, path_score, rank, node, place).

    A leaf is a node that no other names as its parent; a node whose parent is null or missing is a
    root. Branches of a tree are ranked by the sum of their scores (null: 0), then by the leaf;
    `best` keeps the first so many of each tree, and by default all are kept. `place` counts from the
    root, from 0. Nodes are unique in a tree. Nodes on or below a cycle are on no path.
    """
    prepare(messages.sparkSession)
    known = messages.select("tree", F.col("node").alias("p"))
    nodes = (
        messages.join(known.toDF("kt", "p"), F.col("tree").eqNullSafe(F.col("kt")) & (F.col("parent") == F.col("p")), "left")
        .select("tree", "node", F.col("p").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    )
    jumps, rooted = _rounds(nodes)
    parents = jumps[0].select(F.col("tree").alias("pt"), F.col("above").alias("pn")).distinct() if jumps else None
    leaves = rooted if parents is None else rooted.join(
        parents, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("node") == F.col("pn")), "left_anti"
    )
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    path = ranked.select("tree", F.col("node").alias("leaf"), "path_score", "rank", "node", (F.col("depth") - 1).alias("place"))
    path = path.checkpoint()
    # Every distance to the leaf is a sum of powers of two: the largest jump is tried first.
    for k in reversed(range(len(jumps))):
        jump = jumps[k].toDF("jt", "jn", "above")
        higher = path.join(jump, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn"))).select(
            "tree", "leaf", "path_score", "rank", F.col("above").alias("node"), (F.col("place") - 2**k).alias("place")
        )
        path = path.unionByName(higher).checkpoint()
    return path


def format_conversations(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., n_turns, formatted, loss_spans) from (keys.., place, role, text).

    A turn is `<|im_start|>role\\ntext<|im_end|>\\n` with the text escaped. `loss_spans` lists start and
    length, in code points of `formatted`, of each assistant text: what a model is trained to say,
    without marks. Null roles and texts are empty. Turns of one place are taken in order of role and
    text. One conversation becomes one row, as it must; different ones are spread over tasks.
    """
    turn = F.struct(
        "place",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == LEARNED_ROLE).alias("learned"),
            F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    tail = CLOSE + "\n"
    made = gathered.select(*keys, parts.alias("parts"))
    # One span per part, laid end to end; the fold carries the place and the spans so far.
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def lay(s: Column, p: Column) -> Column:
        begin = s["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        spans = F.when(p["learned"], F.concat(s["spans"], span)).otherwise(s["spans"])
        return F.struct((begin + size + len(tail)).alias("at"), spans.alias("spans"))

    return made.select(
        *keys,
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("parts", state, lay, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.split(formatted, r"\Q" + CLOSE + r"\E\n", -1)
    inner = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: F.substring(t, len(OPEN) + 1, 2**31 - 1))

    def parse(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        text = F.substring(t, F.char_length(role) + 2, F.lit(2**31 - 1))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(inner, parse)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Flat (conv_id, turn, role, text) as chains: every message answers the one before it.

    Turns are numbered anew by turn (null first), role and text, so gaps and repeated turns do no
    harm; a repeated row is one more message.
    """
    order = Window.partitionBy("conv_id").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")
    )
    node = F.row_number().over(order)
    return rows.select(
        F.col("conv_id").alias("tree"),
        node.alias("node"),
        F.when(node > 1, node - 1).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, path_score, rank, n_turns, formatted, loss_spans), one row per chosen path.

    `messages` has tree, node, parent, score, role, text; see `reply_paths` for trees and ranks.
    """
    paths = reply_paths(messages, best)
    said = messages.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), "role", "text")
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("node") == F.col("mn")))
    return format_conversations(turns, ["tree", "leaf", "path_score", "rank"])

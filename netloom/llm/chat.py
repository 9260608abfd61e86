"""Reply trees as training conversations, with DataFrame functions only.

Messages are nodes with parents. A run is a chain of nodes that have no siblings, below its
first one; iterative self-joins by pointer jumping give each node its run, and the runs, as the
nodes of a smaller tree, the length and the score of the path from their root. Pointers double
their reach in each round, so rounds and jobs grow with the logarithm of the depth. A run that
nothing continues ends a branch from root to leaf. Branches are ranked by the mean score of
their nodes; the chosen ones alone are walked up, again in doubled steps, and their texts joined.

Template, for each turn:  <|im_start|>role NEWLINE text <|im_end|> NEWLINE
In texts and roles a backslash is doubled and "<|" is written "<\\|", so no control string
comes from them; a newline in a role is written "<|nl|>". Unescaping undoes this exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from netloom.llm.store import cut

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def climbed(rows: DataFrame, name: str, theirs: tuple[str, ...] = ()) -> list[DataFrame]:
    """Pointer jumping over `rows` (tree_id, node_id, up, n, score, ...), where `up` names a row
    above in the tree or is null. In table k of the result `up` is the row 2**k above, and n and
    score are sums over the row and those above it, as far as `up`; the columns `theirs` come from
    the uppermost of these. A table has the rows whose `up` was not null in the one before it; a
    row is done where `up` is null.

    Rows below one that is not there are dropped, and once only rows on or below a circle are
    open, no round brings an end to any: the loop stops. Each round is one join and is cut.
    """

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return cut(df.observe(seen, F.count("up").alias("open")), name), seen.get["open"]

    table, left = written(rows)
    tables, before = [table], None
    while left and left != before:
        above = finished(tables).unionByName(tables[-1].where("up is not null"))
        above = above.select(F.col("tree_id").alias("t"), F.col("node_id").alias("u"), F.struct("up", "n", "score", *theirs).alias("a"))
        more = tables[-1].where("up is not null").join(above, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("u")))
        values = {"up": F.col("a.up"), "n": F.col("n") + F.col("a.n"), "score": F.col("score") + F.col("a.score")} | {c: F.col(f"a.{c}") for c in theirs}
        before = left
        table, left = written(more.select(*(values.get(c, F.col(c)).alias(c) for c in rows.columns)))
        tables.append(table)
    return tables


def finished(tables: list[DataFrame]) -> DataFrame:
    """The rows that are done, from one scan of all tables of climbed()."""
    spark = tables[0].sparkSession
    return spark.read.schema(tables[0].schema).parquet(*(t.cut_path for t in tables)).where("up is null")


def branches(messages: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(leaves, members, tables): `leaves` (tree_id, node_id, n, score) has a row for each path
    from a root to a leaf, named by its leaf, with its number of nodes and their mean score;
    `members` (tree_id, node_id, first, n) each node's run, named by its first node, and the place
    there; `tables` are climbed() over the runs, which their last nodes name.

    `messages` has tree_id, node_id (unique in its tree), parent_id (null for a root) and
    score (null counts as 0). Nodes whose parent is not in their tree, or that lie on or below
    a circle, are on no path. Nothing here is as long as a path.
    """
    nodes = messages.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    parents = nodes.where("parent_id is not null").groupBy(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).agg(F.count("*").alias("children"))
    same = F.col("tree_id").eqNullSafe(F.col("t"))
    below = nodes.where("parent_id is not null").join(parents, same & (F.col("parent_id") == F.col("p")))
    alone = F.col("children") == 1
    below = below.select("tree_id", "node_id", F.when(alone, F.col("parent_id")).alias("up"), "score", F.when(~alone, F.col("parent_id")).alias("over"))
    roots = nodes.where("parent_id is null").select("tree_id", "node_id", F.col("parent_id").alias("up"), "score", F.col("parent_id").alias("over"))
    rows = below.unionByName(roots).withColumns({"n": F.lit(1).cast("long"), "first": F.col("node_id")})
    members = finished(climbed(rows, "runs", ("first", "over")))
    last = F.max(F.struct("n", "node_id", "score", "over")).alias("last")
    runs = members.groupBy("tree_id", "first").agg(last).select("tree_id", "last.node_id", F.col("last.over").alias("up"), "last.n", "last.score", "first", F.col("last.n").alias("own"))
    tables = climbed(runs, "paths")
    leaves = finished(tables).join(parents, same & (F.col("node_id") == F.col("p")), "left_anti")
    return leaves.select("tree_id", "node_id", "n", (F.col("score") / F.col("n")).alias("score")), members, tables


def choose(leaves: DataFrame, top: int = 1) -> DataFrame:
    """The `top` branches of each tree by score, with rank 1, 2, ...; of ties, the smaller leaf
    comes first. A tree's best come from partial maxima before they meet."""
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "node_id")
    return leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def expand(chosen: DataFrame, members: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree_id, rank, at, node_id): the nodes of chosen branches, in the order of `at`. With
    the tables' jumps from the longest to the shortest, each branch's set of runs doubles to
    all of its path: a distance is a sum of different powers of two in one way only."""
    steps = chosen.select("tree_id", "rank", "node_id")
    for table in reversed(tables):
        jumps = table.where("up is not null").select(F.col("tree_id").alias("t"), F.col("node_id").alias("s"), "up")
        if len(tables) > 1:  # else each run is a path
            over = steps.join(jumps, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("s")))
            steps = cut(steps.unionByName(over.select("tree_id", "rank", F.col("up").alias("node_id"))), "steps")
    same = F.col("tree_id").eqNullSafe(F.col("t"))
    runs = finished(tables).select(F.col("tree_id").alias("t"), F.col("node_id").alias("last"), "first", (F.col("n") - F.col("own")).alias("before"))
    steps = steps.join(runs, same & (F.col("node_id") == F.col("last"))).select("tree_id", "rank", F.col("first").alias("f"), "before")
    members = members.select(F.col("tree_id").alias("t"), "node_id", "first", "n")
    return members.join(steps, same & (F.col("first") == F.col("f"))).select("tree_id", "rank", (F.col("before") + F.col("n")).alias("at"), "node_id")


def formatted(steps: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree_id, rank, conversation) of the nodes of chosen branches; a null role or text is empty."""
    texts = messages.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = steps.join(texts, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    whole = turns.groupBy("tree_id", "rank").agg(F.array_sort(F.collect_list(F.struct("at", turn.alias("turn")))).alias("turns"))
    return whole.select("tree_id", "rank", F.array_join(F.col("turns.turn"), "").alias("conversation"))
def read_back(conversation: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(conversation, r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    return F.transform(
        F.transform(parts, body),
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text"),
        ),
    )


def chat_format(messages: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """(tree_id, rank, conversation): the `top` best branches of every reply tree, formatted.

    `messages`: tree_id, node_id, parent_id, role, text, score. Of rows with equal tree and node
    the one that sorts first counts (`unique` says that there are none, which saves a shuffle of
    all texts); a null node is left out, a null tree is a tree. Empty and null texts make empty
    turns, of any length each is whole; a tree of one message makes one turn; an empty table
    gives no rows. Other columns are not read.
    """
    messages = messages.where("node_id is not null").select("tree_id", "node_id", "parent_id", "role", "text", "score")
    if not unique:
        rest = F.struct("parent_id", "role", "text", "score")
        messages = messages.groupBy("tree_id", "node_id").agg(F.min(rest).alias("m")).select("tree_id", "node_id", "m.*")
    messages = cut(messages, "messages")
    leaves, members, tables = branches(messages)
    return formatted(expand(choose(leaves, top), members, tables), messages)


def as_trees(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees without forks: a row's parent
    is the row before it in its conversation, by turn, then role and text; null turns come
    first. Rows with equal turns follow one another, repeated rows too."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def chat_digests(turns: DataFrame, learnt: str = "assistant") -> DataFrame:
    """Per conversation, read back from its formatted text: n_turns, turns_sha256 (of role,
    newline, text, newline for each turn), loss_chars and loss_sha256 (of the texts of `learnt`
    turns) and formatted_chars."""
    out = chat_format(as_trees(turns), unique=True).select("tree_id", "conversation", read_back(F.col("conversation")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == learnt), lambda x: x["text"]), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )

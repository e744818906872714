"""Chat formatting by quotation linking (operator 9).

Lines that begin with ``>`` are quotes; the number of ``>`` is their level. Lines of one level that follow each other, up to a blank one, are a passage.
Quoted passages of every level, and their single lines, are normalised (white space, capitals, line ends) and hashed, and joined
to the unquoted passages and lines of earlier messages of the same conversation; a passage that was wrapped anew is still the same. A message replies to the message that
most of its quotes of the least level with a source come from. Replies form trees; sorting a conversation by the root and the place in its tree gives it in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, keep, lower_ascii

#: Turns of a conversation that are put in order together for one line.
RUN_TURNS = 4096
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: A line that says something, written behind its level and \x01, and the lines of the same level that follow it.
PASSAGE = r"(?<![^\n])([0-9]++)\x01[^\n]++(?:\n\1\x01[^\n]++)*+"


def quote_level(line: Column) -> Column:
    """Number of leading ``>``, 0 for a line that quotes nothing."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normalised(line: Column) -> Column:
    """Without quote marks, white space at the ends and capitals; inner white space is one blank."""
    return F.trim(F.regexp_replace(lower_ascii(F.regexp_replace(line, MARKS, "")), SPACE, " "))


def _above(step: DataFrame, of: list[str]) -> DataFrame:
    """``step`` (conv, turn, top, ..) with the columns ``of`` of the row at ``top``, and that row's top as ``next``."""
    up = step.select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), F.col("top").alias("next"), *[F.col(c).alias(f"top_{c}") for c in of])
    return step.join(up, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("top") == F.col("__t")), "left").drop("__c", "__t")


def _more(df: DataFrame) -> bool:
    return bool(df.where("top is not null").limit(1).count())


def _sizes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (conv, turn, parent) with the size of the tree below each, itself included.

    By doubling: a message knows those less than 2^k replies below it, and adds those that each message exactly 2^k replies below knows. Parents come before their replies, so there are no
    circles, and a row stays as long as it is however deep the replies are.
    """
    step = nodes.withColumn("top", F.col("parent")).withColumn("size", F.lit(1).cast("long"))
    while _more(step):
        below = step.where("top is not null").groupBy(F.col("conv").alias("__c"), F.col("top").alias("__t")).agg(F.sum("size").alias("__more"))
        grown = _above(step, []).join(below, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("turn") == F.col("__t")), "left")
        step = keep(grown.select("conv", "turn", "parent", F.col("next").alias("top"), (F.col("size") + F.coalesce("__more", F.lit(0))).alias("size")), "sizes")
    return step.select("conv", "turn", "parent", "size")


def _earlier_siblings(sized: DataFrame) -> DataFrame:
    """Column ``step``: 1 and the sizes of the earlier replies to the same message. Replies are added up in runs of RUN_TURNS turns, so that a message that all reply to is spread."""
    kids = sized.where("parent is not null").withColumn("run", F.floor(F.col("turn") / RUN_TURNS))
    runs = kids.groupBy("conv", "parent", "run").agg(F.sum("size").alias("all"))
    carry = F.sum("all").over(Window.partitionBy("conv", "parent").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("conv").alias("__c"), F.col("parent").alias("__p"), F.col("run").alias("__r"), carry.alias("carry"))
    within = F.sum("size").over(Window.partitionBy("conv", "parent", "run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    both = kids.withColumn("within", within).join(runs, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("parent") == F.col("__p")) & (F.col("run") == F.col("__r")))
    steps = both.select("conv", "turn", "parent", (1 + F.coalesce("within", F.lit(0)) + F.coalesce("carry", F.lit(0))).alias("step"))
    return steps.unionByName(sized.where("parent is null").select("conv", "turn", "parent", F.lit(0).cast("long").alias("step")))


def _reply_order(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth, place) of every message that replies or is replied to; place: how many messages of its tree come before it in reply order."""
    replies = links.select("conv", "turn", "parent")
    tops = replies.select("conv", F.col("parent").alias("turn")).distinct().join(replies.select(F.col("conv").alias("__c"), F.col("turn").alias("__t")), F.col("conv").eqNullSafe(F.col("__c")) & (F.col("turn") == F.col("__t")), "left_anti")
    nodes = keep(replies.unionByName(tops.withColumn("parent", F.lit(None).cast("long"))), "nodes")
    step = keep(_earlier_siblings(_sizes(nodes)), "steps").withColumnsRenamed({"step": "place"})
    step = step.withColumns({"top": F.col("parent"), "depth": F.col("parent").isNotNull().cast("int"), "root": F.coalesce("parent", "turn")})
    while _more(step):
        up = _above(step, ["place", "depth", "root"])
        add = lambda c: (F.col(c) + F.coalesce(f"top_{c}", F.lit(0))).alias(c)
        step = keep(up.select("conv", "turn", "parent", F.col("next").alias("top"), add("place"), add("depth"), F.coalesce("top_root", "root").alias("root")), "order")
    return step.select("conv", "turn", "parent", "root", "depth", "place")


def pieces(text: Column) -> Column:
    """(level, h) of every line and passage of a text with something in it: level 0 is what the message says itself. The same piece may come twice.

    Lines are written down behind their levels, and a passage, a line and those of its level behind it up to a blank one, is one match of a pattern, so the work grows with the text.
    """
    lines = F.transform(F.split(text, "\n"), lambda s: F.concat(quote_level(s).cast("string"), F.lit("\x01"), normalised(s)))
    passages = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(PASSAGE), 0)
    level = lambda p: F.substring_index(p, "\x01", 1).cast("int").alias("level")
    said = lambda p: F.xxhash64(F.regexp_replace(F.regexp_replace(p, r"^[0-9]+\x01", ""), r"\n[0-9]+\x01", " ")).alias("h")
    spoken = F.filter(lines, lambda p: F.length(p) > F.length(F.substring_index(p, "\x01", 1)) + 1)
    return F.transform(F.concat(spoken, passages), lambda p: F.struct(level(p), said(p)))


def _latest_before(both: DataFrame) -> DataFrame:
    """For each row that asks (conv, h, turn, level) the latest earlier turn that says h, if any.

    Turns are dealt into runs of RUN_TURNS: within a run a running maximum, and over the runs that of their greatest turns, so a line that
    a long conversation repeats is spread over tasks.
    """
    both = both.withColumn("run", F.floor(F.col("turn") / RUN_TURNS))
    runs = both.groupBy("conv", "h", "run").agg(F.max(F.when(F.col("level") == 0, F.col("turn"))).alias("top"))
    carry = F.max("top").over(Window.partitionBy("conv", "h").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("conv").alias("c"), F.col("h").alias("x"), F.col("run").alias("r"), carry.alias("carry"))
    earlier = Window.partitionBy("conv", "h", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)).where("level > 0")
    found = near.join(runs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("x")) & (F.col("run") == F.col("r")))
    return found.select("conv", "h", "turn", "level", F.coalesce("near", "carry").alias("src")).where("src is not null")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, text without quotes, n_quoted (lines), reply_to, root, depth, place.

    reply_to: null if no quote occurs in an earlier message. The quotes of the least level that has a source count, as a deeper one was quoted by the message
    replied to. Of several sources the one with most quoted lines and passages counts, then the latest; of a line that several messages hold, the latest earlier one. Quotes of any length count, blank ones don't.
    Rows with one conversation and turn are one message to the links
    but keep their rows. A null text stays null; null conversations are one conversation; messages without a turn are linked to nothing and have no root, depth and place. Further columns
    are not read. root: the first message of the tree; place: how many of the tree's messages come before in reply order, where each message is followed by its replies by turn.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    split = rows.withColumn("all", F.split("text", "\n"))
    with_turn = rows.where("turn is not null")
    has_quotes = F.col("text").rlike(r"(?:^|\n)[ \t]*>")
    parents = None
    if with_turn.where(has_quotes).limit(1).count():
        every = keep(with_turn.select("conv", "turn", F.inline(pieces(F.col("text")))).distinct(), "pieces")
        quoted = every.where("level > 0")
        asked = quoted.select(F.col("conv").alias("c"), F.col("h").alias("a")).distinct()
        said = every.where("level = 0").join(asked, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("a")), "left_semi")
        asking = keep(said.select("conv", "h", "turn", "level").union(quoted.select("conv", "h", "turn", "level")), "said-and-quoted")
        hits = _latest_before(asking)
        counts = hits.groupBy("conv", "turn", "level", "src").agg(F.count(F.lit(1)).alias("k"))
        best = counts.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "k", "src")).alias("best"))
        parents = keep(best.select("conv", "turn", F.col("best.src").alias("parent")), "replies")
    quotes_of = F.filter("all", lambda s: quote_level(s) > 0)
    plain = F.array_join(F.filter("all", lambda s: quote_level(s) == 0), "\n")
    out = split.select("conv", "turn", "role", plain.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(quotes_of)).cast("long").alias("n_quoted"))
    has_turn = F.col("turn").isNotNull()
    if parents is None:
        out = out.withColumns({"reply_to": F.lit(None).cast("long"), "root": F.col("turn"), "depth": F.when(has_turn, 0), "place": F.when(has_turn, F.lit(0).cast("long"))})
    else:
        order = _reply_order(parents).toDF("p_conv", "p_turn", "reply_to", "p_root", "p_depth", "p_place")
        out = out.join(order, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("turn") == F.col("p_turn")), "left")
        out = out.withColumns({"root": F.coalesce("p_root", "turn"), "depth": F.coalesce("p_depth", F.when(has_turn, 0)), "place": F.coalesce("p_place", F.when(has_turn, F.lit(0).cast("long")))})
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "n_quoted", "reply_to", "root", "depth", "place")


def with_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages as a mail client would write them: each one after a conversation's first quotes an earlier one, chosen by its turn, above its own text. For trying the operator on conversations without quotes."""
    chosen = (F.col(turn) * 5 + F.coalesce(F.col(conv), F.lit(0)) * 3) % F.col(turn)
    asked = messages.withColumn("__of", F.when(F.col(turn) > 0, chosen))
    old = messages.select(F.col(conv).alias("__c"), F.col(turn).alias("__t"), F.col(text).alias("__said"))
    both = asked.join(old, F.col(conv).eqNullSafe(F.col("__c")) & (F.col("__of") == F.col("__t")), "left")
    quoted = F.array_join(F.transform(F.split("__said", "\n"), lambda s: F.concat(F.lit("> "), s)), "\n")
    return both.withColumn(text, F.when(F.col("__said").isNull(), F.col(text)).otherwise(F.concat_ws("\n", quoted, F.coalesce(F.col(text), F.lit(""))))).drop("__of", "__c", "__t", "__said")


#: What ``link_quotes`` gives for ``with_quotes``: the quoted message is known, so the replies follow from the turns.
SQL = """WITH RECURSIVE asked AS (
  SELECT *, CASE WHEN turn > 0 THEN (turn * 5 + conv_id * 3) % turn END AS of_turn FROM conversations),
linked AS (
  SELECT a.*, o.turn AS reply_to, CASE WHEN o.turn IS NULL THEN 0 ELSE len(string_split(o.text, chr(10))) END AS n_quoted
  FROM asked a LEFT JOIN conversations o ON o.conv_id = a.conv_id AND o.turn = a.of_turn),
paths AS (
  SELECT conv_id, turn, [turn] AS path FROM linked WHERE reply_to IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, list_append(p.path, l.turn) FROM linked l JOIN paths p ON p.conv_id = l.conv_id AND p.turn = l.reply_to)
SELECT conv_id, turn, role, text, n_quoted, reply_to, path[1] AS root, (len(path) - 1)::INTEGER AS depth,
  row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS place
FROM linked JOIN paths USING (conv_id, turn)"""

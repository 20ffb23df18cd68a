"""Chat formatting by quotation linking.

A message's lines have a quote level: the number of ``>`` before them. Lines
of level 0 are its own; the others quote earlier messages, a level of k the
message that is k replies back. Each quoted line is normalised (white space
collapsed, A-Z in lower case) and hashed; it is linked to the latest earlier
message of the conversation that has the line as its own. The original with
most linked lines of level 1 (of any level if none is linked there; ties to
the later turn) is what a message replies to; without a link, that is the
message before it. Messages come back without quotes.

Conversations are built in the order of replies: the first reply to a message
goes on with its branch, every further one opens a branch of its own, named by
the turn of its first message. Ordered by branch and turn, each message follows
the one that it replies to, and threads that were interleaved are apart.

Links are looked up by running maxima over the lines that share a hash, in
two levels (slices of about equal numbers of rows in the order of turns, then
within a slice), so neither a line that every message quotes nor one long
conversation becomes a join of all pairs or one task, however far apart its
turns are. Branches are found by running maxima over messages that answer the
one just before, and by doubling steps over the runs that these make. Only
DataFrame operations are used.

Null texts are empty, blank quoted lines link nothing; a null conversation is
one conversation, null turns come first; repeated rows are separate messages
that reply alike; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import discard, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = r"^((?:[ \t]*>)+)"


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of a text."""
    def line(x):
        mark = F.regexp_extract(x, MARK, 1)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.substr(x, F.length(mark) + 1).alias("body"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), line)


def _digest(body: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(body, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.md5(plain))


def in_slices(rows: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """rows with ``slice``: ranges of (keys, turn) of about equal numbers of rows, equal turns in one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *keys, turn).withColumn("slice", F.spark_partition_id()), "quote-slices")


def running(slices: DataFrame, keys: list[str], turn: str, wanted: dict) -> DataFrame:
    """slices with running aggregates over the smaller turns of the same keys.

    wanted: new column -> (aggregate, column, whether the own turn counts). Equal
    turns don't see each other otherwise; null keys are a group, turns are not null.
    """
    tops = slices.groupBy(*keys, "slice").agg(*[f(c).alias(f"_{n}") for n, (f, c, _) in wanted.items()])
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = [f(f"_{n}").over(over).alias(f"_{n}") for n, (f, _, _) in wanted.items()]
    tops = tops.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slice").alias("_slice"), *carried)
    within = Window.partitionBy(*keys, "slice").orderBy(turn)
    near = [f(c).over(within.rangeBetween(Window.unboundedPreceding, 0 if own else -1)).alias(n) for n, (f, c, own) in wanted.items()]
    cond = F.col("slice") == F.col("_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = slices.select("*", *near).join(tops, cond)
    join = lambda n, f: F.coalesce(F.col(n) + F.col(f"_{n}"), n, f"_{n}") if f is F.sum else F.greatest(n, f"_{n}")
    return out.withColumns({n: join(n, f) for n, (f, _, _) in wanted.items()}).drop("slice", "_slice", *[f"_{x}" for x in (*keys, *wanted)])


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, original, level, lines): linked lines of each message."""
    m = messages.select("conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.explode(_lines(F.col("text"))).alias("l"))
    quoting = messages.where(F.coalesce(F.col("text"), F.lit("")).rlike(rf"(?m){MARK}")).select(F.col("conv_id").alias("_conv")).distinct()
    m = m.join(quoting, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    m = m.select("conv_id", "turn", F.col("l.level").alias("level"), _digest(F.col("l.body")).alias("hash")).where("hash is not null")
    m = m.groupBy("conv_id", "hash", "turn", "level").agg(F.count("*").alias("lines"))
    m = m.withColumn("own", F.when(F.col("level") == 0, F.col("turn")))
    m = in_slices(m, ["conv_id", "hash"], "turn")
    linked = running(m, ["conv_id", "hash"], "turn", {"before": (F.max, "own", False)}).where("level > 0 and before is not null")
    return linked.groupBy("conv_id", "turn", F.col("before").alias("original"), "level").agg(F.sum("lines").alias("lines"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, position, role, content, reply_to, linked, quoted_lines, max_level, branch) of every message."""
    lines = _lines(F.col("text"))
    m = messages.select("conv_id", "turn", "role", "text").withColumn("at", F.coalesce("turn", F.lit(-(1 << 62)))).withColumn("lines", lines)
    own = F.filter("lines", lambda x: x["level"] == 0)
    content = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
    m = m.select(
        "conv_id", "turn", "at", "role", content.alias("content"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("quoted_lines"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"),
    )
    votes = quote_links(messages)
    first = F.struct((F.col("level") == 1).alias("direct"), F.col("lines"), F.col("original"))
    by = votes.groupBy("conv_id", "turn", "original", (F.col("level") == 1).alias("direct")).agg(F.sum("lines").alias("lines"), F.min("level").alias("level"))
    best = by.groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")).agg(F.max(first)["original"].alias("original"))
    # the turn before and the number of messages before, from one row for each turn
    turns = in_slices(m.groupBy("conv_id", "at").agg(F.count("*").alias("n")), ["conv_id"], "at")
    turns = running(turns, ["conv_id"], "at", {"before": (F.max, "at", False), "position": (F.sum, "n", False)})
    turns = turns.join(best, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_turn")), "left")
    turns = stored(turns.select("conv_id", "at", F.coalesce("position", F.lit(0)).alias("position"), "original", "before", F.coalesce("original", "before").alias("parent")), "quote-turns")
    turns = turns.join(_branches(turns), F.col("conv_id").eqNullSafe(F.col("_b")) & (F.col("at") == F.col("_t")))
    turns = turns.select(F.col("conv_id").alias("_c"), F.col("at").alias("_a"), "position", "original", "parent", "branch")
    out = m.join(turns, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a")))
    shown = lambda c: F.when(F.col(c) > -(1 << 62), F.col(c))
    return out.select("conv_id", "turn", "position", "role", "content", shown("parent").alias("reply_to"), F.col("original").isNotNull().alias("linked"), "quoted_lines", "max_level", shown("branch").alias("branch"))


def _branches(turns: DataFrame) -> DataFrame:
    """(_b, _t, branch): the branch of each conversation and turn, named by its first turn."""
    # runs of turns that answer the one just before are parts of one branch
    start = F.when(F.col("parent").isNull() | (F.col("parent") != F.col("before")), F.col("at"))
    runs = in_slices(turns.select("conv_id", "at", "parent", start.alias("start")), ["conv_id"], "at")
    runs = stored(running(runs, ["conv_id"], "at", {"run": (F.max, "start", True)}).select("conv_id", "at", "parent", "run"), "quote-runs")
    # a run whose first message is the first answer to its parent goes on with the parent's run
    first = runs.where("parent is not null").groupBy("conv_id", "parent").agg(F.min("at").alias("at"))
    heads = runs.where("at = run").join(first.select(F.col("conv_id").alias("c"), F.col("parent").alias("p"), F.col("at").alias("a")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")) & (F.col("at") == F.col("a")), "left")
    above = runs.select(F.col("conv_id").alias("c2"), F.col("at").alias("a2"), F.col("run").alias("up"))
    ups = heads.join(above, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("p") == F.col("a2")), "left")
    ups = stored(ups.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce("up", "run").alias("up")), "quote-heads")
    while True:  # each step doubles the distance that a run looks up
        over = ups.where("up != r").select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("up").alias("top"))
        new = ups.join(over, F.col("c").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("r2")), "left")
        new = stored(new.select("c", "r", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "quote-heads")
        discard(ups)
        ups = new
        if ups.where("moved").isEmpty():
            break
    out = runs.join(ups, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return out.select(F.col("conv_id").alias("_b"), F.col("at").alias("_t"), F.col("up").alias("branch"))


def op8_link_quotes(spark, sf_dir) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


ORACLE = r"""
with recursive l as (
  select conv_id, turn, u.i, length(regexp_replace(regexp_extract(u.x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) as level,
         substr(u.x, length(regexp_extract(u.x, '^((?:[ \t]*>)+)', 1)) + 1) as body
  from (select conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', e'\n', 'g'), e'\n') as xs from conversations),
       unnest(list_zip(xs, range(len(xs)))) as z(p), lateral (select p[1] as x, p[2] as i) u
), h as (
  select *, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as plain from l
), k as (
  select q.conv_id, q.turn, q.i, q.level, max(o.turn) as original
  from h q join h o on q.conv_id = o.conv_id and q.plain = o.plain and o.level = 0 and o.turn < q.turn where q.level > 0 and q.plain <> '' group by all
), v as (
  select conv_id, turn, original, level = 1 as direct, count(*) as lines from k group by all
), b as (
  select conv_id, turn, original, row_number() over (partition by conv_id, turn order by direct desc, lines desc, original desc) as r from v
), m as (
  select conv_id, turn, regexp_replace(coalesce(string_agg(body, e'\n' order by i) filter (level = 0), ''), '^\s+|\s+$', '', 'g') as content,
         count(*) filter (level > 0) as quoted_lines, max(level)::int as max_level from h group by conv_id, turn
), t as (
  select c.conv_id, c.turn, (row_number() over (partition by c.conv_id order by c.turn) - 1)::bigint as position, c.role, m.content,
         coalesce(b.original, lag(c.turn) over (partition by c.conv_id order by c.turn)) as reply_to, b.original is not null as linked, m.quoted_lines, m.max_level
  from conversations c join m using (conv_id, turn) left join b on b.conv_id = c.conv_id and b.turn = c.turn and b.r = 1
), f as (
  select conv_id, turn, reply_to, reply_to is not null and turn = min(turn) over (partition by conv_id, reply_to) as first_ from t
), g(conv_id, turn, branch) as (
  select conv_id, turn, turn from f where not first_ union all select f.conv_id, f.turn, g.branch from g join f on f.conv_id = g.conv_id and f.reply_to = g.turn and f.first_
)
select t.*, g.branch from t join g using (conv_id, turn)
"""

"""Chat formatting: quotation linking and reply-ordered conversations without quotes.

A line's quote level is its number of leading ``>``. Lines of one level that follow each other are a passage. Passages
are normalised (case, spaces, line breaks), cut into sentences and hashed, and so are their single lines; a quote that
was wrapped anew keeps its sentences, one that breaks off in a sentence keeps its lines. Quoted units are joined, within
the conversation, on hash and text with the first message that has the unit as its own. A message replies to the message
that most of its level-1 quoted characters come from (ties: the latest); deeper levels quote older messages and are linked
the same way, but decide only where level 1 finds nothing.

A line such as ``On Monday Ann wrote:`` right above a deeper quote belongs to the quote: it is neither matched nor kept.

Originals are reduced to one row per unit before the join, so a unit that a third of all messages share costs no pairs,
and where many messages quote one unit or answer one message, they are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.plans import cut, drop, join_hot

MARKS = "^(?:[\\x20\\x09]*>)+"
SPACE = "[\\x01-\\x20]+"
ATTRIBUTION = "(?i)^.{1,200}[ ](wrote|writes|said|schrieb)([ ].{0,40})?:[\\x20\\x09\\x0D]*$"
SENTENCE = "([.!?]) +"
#: Marks of a passage's start, of the end of its level, and of a sentence's end; normalised lines have none of them.
START, LEVEL, END = "\x02", "\x01", "\x03"
MAX_ROUNDS = 64


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SPACE, " ")))


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value made once, not again for every element that a lambda looks at."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _parsed(text: Column) -> Column:
    """Lines as (raw, level, line, head): head tells the attribution of a quote below."""

    def lines(raw: Column) -> Column:
        deeper = lambda x, i: F.coalesce(_level(F.get(raw, i + 1)) > _level(x), F.lit(False))
        return F.transform(
            raw,
            lambda x, i: F.struct(
                x.alias("raw"),
                _level(x).alias("level"),
                _normal(x).alias("line"),
                (x.rlike(ATTRIBUTION) & deeper(x, i)).alias("head"),
            ),
        )

    return _bound(F.split(F.coalesce(text, F.lit("")), "\n", -1), lines)


def _units(parsed: Column) -> Column:
    """(level, kind, unit) of a message: sentences of its passages (kind 0) and its lines (kind 1)."""

    def marked(lines: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            fresh = (i == 0) | (before["level"] != x["level"]) | (before["line"] == "") | before["head"]
            start = F.when(fresh, F.concat(F.lit(START), x["level"].cast("string"), F.lit(LEVEL))).otherwise(F.lit(" "))
            return F.when((x["line"] == "") | x["head"], F.lit("")).otherwise(F.concat(start, x["line"]))

        return F.array_join(F.transform(lines, piece), "")

    def sentences(passage: Column) -> Column:
        level = F.substring_index(passage, LEVEL, 1).cast("int")
        text = F.substring_index(passage, LEVEL, -1)
        parts = F.split(F.regexp_replace(text, SENTENCE, "$1" + END), END)
        return F.transform(parts, lambda u: F.struct(level.alias("level"), F.lit(0).alias("kind"), u.alias("unit")))

    passages = F.filter(F.split(_bound(parsed, marked), START), lambda p: p != "")
    lines = F.filter(parsed, lambda x: (x["line"] != "") & ~x["head"])
    lines = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), F.lit(1).alias("kind"), x["line"].alias("unit")))
    return F.concat(F.flatten(F.transform(passages, sentences)), lines)


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): the earlier message that each quoting message answers."""
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", _parsed(F.col("text")).alias("p"))
    rows = rows.select("conv_id", "turn", F.explode(_units(F.col("p"))).alias("u")).select("conv_id", "turn", "u.*")
    rows = rows.withColumn("h", F.xxhash64("unit"))
    key = ["conv_id", "h", "unit"]
    quoted = rows.where("level > 0").groupBy(*key, "turn", "kind").agg(F.min("level").alias("level"))
    quoted = cut(quoted, "quoted")
    own = rows.where("level = 0").groupBy(*key).agg(F.min("turn").alias("first"))
    asked = quoted.groupBy(*key).agg(F.count("*").alias("n"))
    found = join_hot(quoted, cut(asked.join(own, key), "originals"), key).where("first < turn")
    sizes = found.groupBy("conv_id", "turn", "level", "first", "kind").agg(F.sum(F.length("unit")).alias("size"))
    weights = sizes.groupBy("conv_id", "turn", "level", "first").agg(F.max("size").alias("size"))
    best = F.max(F.struct(-F.col("level"), F.col("size"), F.col("first")))
    return weights.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.first").alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth): the first message of each reply's chain and its distance, by doubling."""
    current = cut(replies.select("*", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    for _ in range(MAX_ROUNDS):
        up = current.select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more")
        )
        here = current.groupBy("conv_id", "thread").agg(F.count("*").alias("n"))
        joined = join_hot(current, cut(here.join(up, ["conv_id", "thread"]), "above"), ["conv_id", "thread"], how="left")
        following = joined.select(
            "conv_id",
            "turn",
            "reply_to",
            F.coalesce("above", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("above").isNotNull().alias("moved"),
        )
        following = cut(following, "threads")
        drop(current)
        moved = following.where("moved").limit(1).count()
        current = following
        if not moved:
            return current.drop("moved")
        path = current._cut_path
        current = current.drop("moved")
        current._cut_path = path
    raise RuntimeError("a chain of replies longer than 2^64")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text, any more columns) to one row per input row, to be read by (conv_id, thread,
    turn): every reply stands in the thread of the message it answers, after it.

    Columns: conv_id, turn, role, reply_to (null: quotes nothing that an earlier turn of the conversation says), thread
    (the turn that starts it), depth (0 for that turn), n_quoted (quoted lines), text (own lines only). A null text is
    empty; rows with a null conv_id or turn link to nothing; rows repeated with one (conv_id, turn) are one message for
    links and keep a row each; whole texts are read; an empty table gives no rows; other columns are not read.
    """
    parsed = messages.select("conv_id", "turn", "role", _parsed(F.col("text")).alias("p"))
    own = F.transform(F.filter("p", lambda x: (x["level"] == 0) & ~x["head"]), lambda x: x["raw"])
    quoted = F.size(F.filter("p", lambda x: x["level"] > 0)).cast("long")
    left = parsed.select("conv_id", "turn", "role", F.trim(F.array_join(own, "\n")).alias("text"), quoted.alias("n_quoted"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    nothing = [F.lit(None).cast("long").alias(c) for c in ("reply_to", "thread")] + [F.lit(None).cast("int").alias("depth")]
    # rows without a full key would meet in one task of the join
    joined = left.where(named).join(threads(links(messages)), ["conv_id", "turn"], "left")
    joined = joined.unionByName(left.where(~named).select("*", *nothing))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce(F.col("depth"), F.lit(0)).cast("long").alias("depth"),
        "n_quoted",
        "text",
    )


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


ORACLE_SQL = rf"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), x AS (
  SELECT rid, conv_id, turn, unnest(lines) AS raw, unnest(range(1, len(lines) + 1)) AS i FROM m
), l AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '{MARKS}'), '[^>]', '', 'g')) AS level,
    lower(trim(regexp_replace(regexp_replace(raw, '{MARKS}', ''), '{SPACE}', ' ', 'g'), ' ')) AS line FROM x
), a AS MATERIALIZED (
  SELECT *, coalesce(regexp_matches(raw, '{ATTRIBUTION}') AND lead(level) OVER w > level, false) AS head
  FROM l WINDOW w AS (PARTITION BY rid ORDER BY i)
), b AS (
  SELECT *, CASE WHEN i = 1 OR lag(level) OVER w <> level OR lag(line) OVER w = '' OR lag(head) OVER w THEN 1 ELSE 0 END AS fresh
  FROM a WINDOW w AS (PARTITION BY rid ORDER BY i)
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS place FROM b
), p AS (
  SELECT rid, conv_id, turn, level, place, string_agg(line, ' ' ORDER BY i) AS passage
  FROM g WHERE line <> '' AND NOT head GROUP BY ALL
), u AS MATERIALIZED (
  SELECT conv_id, turn, level, 0 AS kind, unnest(string_split(regexp_replace(passage, '{SENTENCE}', '\1' || chr(3), 'g'), chr(3))) AS unit FROM p
  UNION ALL SELECT conv_id, turn, level, 1, line FROM a WHERE line <> '' AND NOT head
), q AS (
  SELECT conv_id, turn, kind, unit, min(level) AS level FROM u WHERE level > 0 GROUP BY ALL
), o AS (
  SELECT conv_id, unit, min(turn) AS first FROM u WHERE level = 0 GROUP BY ALL
), k AS (
  SELECT q.conv_id, q.turn, q.level, q.kind, o.first, sum(length(q.unit)) AS size
  FROM q JOIN o ON q.conv_id = o.conv_id AND q.unit = o.unit AND o.first < q.turn GROUP BY ALL
), w AS (
  SELECT conv_id, turn, level, first, max(size) AS size FROM k GROUP BY ALL
), r AS (
  SELECT conv_id, turn, first AS reply_to FROM w
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, first DESC) = 1
), t AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM r
  UNION ALL
  SELECT t.conv_id, t.turn, r.reply_to, t.depth + 1 FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.thread
), d AS (
  SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM t GROUP BY ALL
), s AS (
  SELECT rid, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT head) AS own,
    count(*) FILTER (WHERE level > 0) AS n_quoted FROM a GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role, r.reply_to, coalesce(d.thread, m.turn) AS thread,
  CAST(coalesce(d.depth, 0) AS BIGINT) AS depth, s.n_quoted, trim(coalesce(s.own, ''), ' ') AS text
FROM m JOIN s ON s.rid = m.rid LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn
LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn
"""

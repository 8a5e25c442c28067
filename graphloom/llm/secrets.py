r"""Secret scans with DataFrame functions only.

Base kinds are regular expressions. The method adds `entropy` spans: in candidate strings, a window slides over the
characters of one class (hexadecimal in either case, base64) and its Shannon entropy is kept up to date from the counts of the
character that leaves and the one that enters. A candidate is reported if its largest window entropy reaches the
class's threshold, unless an allow-list pattern matches it or a base span overlaps it.

Positions: Spark's functions return matches without offsets, so a text is split at the matches and the lengths of gaps
and matches are summed up. All positions are code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table

#: kind, pattern, group whose length counts, least length. The order breaks ties of equal starts.
KINDS = (
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
#: What a text must contain for a kind to occur in it; each is implied by the kind's pattern and least length.
PRESENT = {"assign": "[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Strings whose entropy is looked at; a digit must be among their characters.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: class, its characters, least entropy in bits of a window.
CLASSES = (
    ("hex", "0123456789abcdef", 3.0),
    ("upper hex", "0123456789ABCDEF", 3.0),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
#: Candidates that are no secrets: UUIDs, digits and dates, words and short numbers joined by dashes, placeholders.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9_/+=-]+$",
    "^([A-Za-z]+|[0-9]{1,4})([_/=-]+([A-Za-z]+|[0-9]{1,4}))*$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
)
SLACK = 1e-9
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _located(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose counted group is long enough."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part"))
    state = f"struct<at:int,out:{SPANS}>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            x["hit"].alias("value"),
        )
        out = F.when(F.length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(state)

    first = F.struct(F.lit(0).alias("at"), _none().alias("out")).cast(state)
    return F.aggregate(pieces, first, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    found = [
        F.when(text.rlike(PRESENT[kind]), _located(text, pattern, group, least, kind, rank)).otherwise(_none())
        for rank, (kind, pattern, group, least) in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*found))


def window_entropy(value: Column, letters: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of windows of ``window`` characters of one class; -1 where none fits.

    A character of another class empties the window.
    """
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(letters)) - 1)
    empty = F.array_repeat(F.lit(0), len(letters))
    state = "struct<counts:array<int>,run:int,total:double,best:double>"
    steps = F.arrays_zip(
        places.alias("new"),
        F.concat(F.array_repeat(F.lit(-1), window), places).alias("old"),
    )

    def step(acc: Column, x: Column) -> Column:
        full = acc["run"] == window
        new, old = x["new"], F.when(full, x["old"]).otherwise(F.lit(-1))
        into, outof = F.get(acc["counts"], new), F.get(acc["counts"], old)
        enters = F.get(logs, into + 1) - F.get(logs, into)
        leaves = F.when(full, F.get(logs, outof - 1) - F.get(logs, outof)).otherwise(F.lit(0.0))
        total = F.when(new == old, acc["total"]).otherwise(acc["total"] + enters + leaves)
        counts = F.transform(
            acc["counts"], lambda c, j: c + (j == new).cast("int") - (full & (j == old)).cast("int")
        )
        run = F.least(acc["run"] + 1, F.lit(window))
        entropy = F.lit(math.log2(window)) - total / window
        best = F.when(run == window, F.greatest(acc["best"], entropy)).otherwise(acc["best"])
        on = F.struct(counts.alias("counts"), run.alias("run"), total.alias("total"), best.alias("best")).cast(state)
        off = F.struct(
            empty.alias("counts"), F.lit(0).alias("run"), F.lit(0.0).alias("total"), acc["best"].alias("best")
        ).cast(state)
        return F.when(new.isNull(), acc).when(new < 0, off).otherwise(on)

    first = F.struct(
        empty.alias("counts"), F.lit(0).alias("run"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best")
    ).cast(state)
    return F.aggregate(steps, first, step, lambda acc: acc["best"])


def _secret(value: Column) -> Column:
    """Does a candidate string look random in some class, and does no allow-list pattern match it?"""
    high = F.lit(False)
    for _, letters, least in CLASSES:
        high = high | (window_entropy(value, letters) >= least - SLACK)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return value.rlike("[0-9]") & ~allowed & high


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans that the method adds to the base ones."""
    found = _located(text, CANDIDATE, 0, WINDOW, "entropy", len(KINDS))
    apart = F.filter(
        found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    some = text.rlike("[0-9]") & text.rlike(CANDIDATE)
    return F.when(some, F.filter(apart, lambda s: _secret(s["value"]))).otherwise(_none())


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, any more columns) with ``base`` and ``spans``, arrays of (start, rank, end, kind, value).

    A null or empty text has no spans; whole texts are scanned; null ids, repeated rows and other columns pass through;
    an empty table gives no rows. Columns named base or spans are replaced.
    """
    return _scanned(docs, "base", "spans")


def _scanned(docs: DataFrame, base: str, spans: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(base, base_spans(text))
    return found.withColumn(spans, F.array_sort(F.concat(F.col(base), entropy_spans(text, F.col(base)))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents, columns as they came, with every span in their text replaced by ``mark``; n_chars follows."""
    columns, spans = docs.columns, "spans"
    while {spans, spans + "base"} & {c.lower() for c in columns}:
        spans += "_"
    found = _scanned(docs, spans + "base", spans)
    text, state = F.col("text"), "struct<at:int,out:string>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out")).cast(state)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state)
    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size(spans) > 0, F.aggregate(F.col(spans), first, step, tail)).otherwise(text)
    out = found.withColumn("text", clean)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def _located_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, rank, kind, hits[j] AS value,
    list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda h: length(h))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM (
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, string_split_regex(t, '{quoted}') AS gaps,
      regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS parts FROM d))
  WHERE length(parts[j]) >= {least}"""


def _oracle() -> str:
    base = " UNION ALL ".join(_located_sql(k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS))
    allowed = " OR ".join(f"regexp_matches(value, '{p}')" for p in ALLOWED)
    high = " OR ".join(
        f"(letters = '{name}' AND h >= {least - SLACK!r})" for name, _, least in CLASSES
    )
    classes = ", ".join(
        "('{}', '^[{}]+$')".format(name, letters.replace("-", "") + ("-" if "-" in letters else ""))
        for name, letters, _ in CLASSES
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in KINDS)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in KINDS)
    listed_sql = "string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(s + length(value) AS BIGINT)), ',' ORDER BY s, rank)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({base}), c AS MATERIALIZED (
  SELECT * FROM ({_located_sql("entropy", len(KINDS), CANDIDATE, 0, WINDOW)}) x
  WHERE regexp_matches(value, '[0-9]') AND NOT ({allowed}) AND NOT EXISTS (
    SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.s < x.s + length(x.value) AND x.s < b.s + length(b.value))
), v AS MATERIALIZED (SELECT DISTINCT value FROM c),
w AS (
  SELECT value, i, substr(value, i, {WINDOW}) AS part FROM (SELECT value, unnest(range(1, length(value) - {WINDOW - 2})) AS i FROM v)
), k AS (SELECT * FROM (VALUES {classes}) AS k(letters, pattern)),
e AS (
  SELECT value, letters, i, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS h FROM (
    SELECT value, letters, i, ch, count(*) AS n FROM (
      SELECT value, letters, i, unnest(string_split(part, '')) AS ch FROM w JOIN k ON regexp_matches(part, pattern)
    ) GROUP BY ALL) GROUP BY ALL
), g AS (SELECT DISTINCT value FROM e WHERE {high}),
o AS (SELECT doc_id, {counts}, {listed_sql} AS listed FROM b GROUP BY doc_id),
a AS (
  SELECT doc_id, {listed_sql} AS spans FROM (
    SELECT doc_id, rank, kind, value, s FROM b UNION ALL SELECT doc_id, rank, kind, value, s FROM c WHERE value IN (SELECT value FROM g)
  ) GROUP BY doc_id
)
SELECT d.doc_id, {zero}, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle()

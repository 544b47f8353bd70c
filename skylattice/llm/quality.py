"""Quality rules and cross-document line frequency, in DataFrame functions alone.

Each non-blank line is normalised (lower case, runs of white space made one space, trimmed) and hashed.
For each host, the documents that hold a line are counted once each; a line in more than ``LINE_DOCUMENTS``
documents and more than one in ``LINE_SHARE`` of the host's is boilerplate.  Boilerplate lines are removed, and a document
that loses more than half of its characters is rejected.

Documents count by their ids: rows that repeat an id are one document of each host (rows without an id
are one too), and pairs of line and id are made distinct before any count, so a line in every document
is added up in every task.  Null texts have no words and fail the base rules; a null host is a host of
its own, not the empty one.  Rows that repeat an id, host and text get the same result.  Very long
texts are single arrays of hashes.  There are no ties: the limits are strict.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate above both: documents of the host, and one of so many of the host's documents.
LINE_DOCUMENTS, LINE_SHARE = 20, 100
#: Words of a window, least words of a document, and the largest percentage of repeated words.
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORDS), lambda w: w != "")


def _filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _covered(positions: Column) -> Column:
    """Words in the windows that start at the sorted positions."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(positions, zero, step, lambda acc: acc["n"])


def base_rules(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_t"), F.transform(_words(text), lambda w: F.xxhash64(w)).alias("_w"), F.transform(_filled_lines(text), lambda x: F.xxhash64(x)).alias("_l"))
    n = F.size("_w")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_v", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("_again", F.size(F.array_distinct("_v")) < F.size("_v"))
    listed = F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.col("_again"), listed))
    same = lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"])
    twice = F.transform("_s", lambda x, k: F.when(F.coalesce(same(x, k), x["h"] == F.get("_s", k + 1)["h"], x["h"] == F.get("_s", k - 1)["h"], F.lit(False)), x["i"]))
    rows = rows.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.array_compact(twice))))
    out = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WORDS, "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), _covered(F.col("_p"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _host(column: str) -> Column:
    """A host's name with a mark in front; a null host is the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Host, id and hash of the text, and the normalised lines as structs of hash and characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = F.transform(_filled_lines(text), lambda x: F.trim(F.regexp_replace(F.lower(x), WORDS, " ")))
    lines = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))
    return docs.select(_host(host_col).alias("host"), "doc_id", F.xxhash64(text).alias("mark"), lines.alias("lines"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """``host, h`` of the lines above the limits."""
    held = lines.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    counted = held.groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = lines.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    often = counted.where(F.col("n") > LINE_DOCUMENTS)
    return often.join(hosts, "host").where(LINE_SHARE * F.col("n") > F.col("documents")).select("host", "h")


def line_removal(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``host, doc_id, mark, removed_chars`` of the documents that hold boilerplate lines (mark: hash of the text)."""
    lines = _lines(docs, text_col, host_col)
    key = ["host", "doc_id", "mark"]
    each = lines.select(*key, F.posexplode("lines").alias("at", "line")).select(*key, "at", "line.h", "line.n")
    found = each.join(boilerplate(lines), ["host", "h"])
    once = found.groupBy(*key, "at").agg(F.max("n").alias("n"))
    return once.groupBy(*key).agg(F.sum("n").alias("removed_chars"))


def quality(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base rules and the verdict of every document (see the module's docstring)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).alias("source"), text.alias("text"))
    normal = F.transform(_filled_lines(F.col("text")), lambda x: F.length(F.trim(F.regexp_replace(x, WORDS, " "))))
    total = F.aggregate(normal, F.lit(0).cast("long"), lambda acc, n: acc + n)
    marked = own.select("*", _host("source").alias("host"), F.xxhash64("text").alias("mark"), total.alias("line_chars"))
    base = base_rules(marked, "text", ("host", "doc_id", "mark", "line_chars"))
    gone = line_removal(own, "text", "source").select(F.col("host").alias("g_host"), F.col("doc_id").alias("g_doc"), F.col("mark").alias("g_mark"), "removed_chars")
    same = F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("host") == F.col("g_host")) & (F.col("mark") == F.col("g_mark"))
    out = base.join(gone, same, "left")
    removed = F.coalesce("removed_chars", F.lit(0))
    kept = ~F.col("base_failed") & (2 * removed <= F.col("line_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), removed.cast("long").alias("removed_chars"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
v AS (SELECT doc_id, i, ws[i:i+4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM v) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT doc_id, host, unnest(ls) AS x FROM w)),
f AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM l GROUP BY host, line),
h AS (SELECT host, count(DISTINCT doc_id) AS documents FROM d GROUP BY host),
b AS (SELECT f.host, f.line FROM f JOIN h USING (host) WHERE n > 20 AND 100 * n > documents),
c AS (SELECT doc_id, sum(length(l.line)) AS line_chars, sum(CASE WHEN b.line IS NOT NULL THEN length(l.line) ELSE 0 END) AS removed FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(line_chars, 0) AS line_chars, coalesce(removed, 0) AS removed
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * removed <= line_chars AS kept,
  CAST(removed AS BIGINT) AS removed_chars
FROM s
"""

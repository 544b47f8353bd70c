"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

DataFrame functions alone.  Matches get their code-point offsets by marking them in the text and
splitting at the marks.  Strings of at least ``MIN_LENGTH`` key characters in what the patterns' matches
leave of a text are scored by the log-likelihood ratio of two first-order character models: one of random
strings (values that the patterns find in a bounded sample, and digests in hex and base 64), one of
the other words of the sample.  A string holds a secret if in some stretch of ``MIN_LENGTH`` or more
of its characters the ratio is at least ``MIN_BITS`` in all and ``MIN_BITS_EACH`` for each
transition, so what is joined to a secret can't hide it; the span is the whole string.

Arrays of matches are built in blocks of ``BLOCK``, so work grows with the text and its matches even in
very long texts.  Null and empty texts have no spans.  Repeated rows get equal results.  Spans that
start together are listed by kind; a sum equal to a limit reaches it.  An empty table gives no rows, and
a corpus without samples is scanned with the models of the digests alone.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Kinds in the order in which spans of one start are listed: marking pattern, quick test of a text.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
#: Least lengths of an assigned value and of an access key.  Runs of hex digits and of candidate
#: characters are maximal, so their least lengths stand in the patterns and short runs aren't marked.
MIN_ASSIGNED, MIN_ACCESS = 6, 20
#: Characters of candidate strings, their least length, and the least ratio in bits.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]+"
MIN_LENGTH, MIN_BITS, MIN_BITS_EACH = 16, 30.0, 4.0
LONG = f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
#: Bound of the training sample (documents, the least by a hash of the id), and digests of each form.
MAX_DOCUMENTS, DIGESTS = 1500, 1000
#: Weight, in counts, of the characters' own frequencies in each transition.
PRIOR = 2.0

#: Parts of a text that are handled at once (even, so that each block starts outside a match).
BLOCK = 256

_MARK, _OTHER = "\ue000", "\ue001"
SPAN = "array<struct<start:int,end:int,s:string>>"
KINDS = ("assign", "access", "hex", "markov")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results before each of a few values, from zero, and the last."""
    start = F.struct(F.lit(0).alias("now"), F.array(F.lit(0)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = combine(acc["now"], x)
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _numbers(items: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int"))


def _block(items: Column, b: Column) -> Column:
    return F.slice(items, b * BLOCK + 1, BLOCK)


def matches(text: Column, pattern: str, test: str) -> Column:
    """All leftmost matches of a pattern as (start, end, s); ``test`` finds the texts worth marking."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    none = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("s")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def found(parts: Column) -> Column:
        sums = F.transform(_numbers(parts), lambda b: F.aggregate(_block(parts, b), F.lit(0), lambda acc, x: acc + F.length(x)))

        def spans(starts: Column) -> Column:
            zero = lambda b: F.struct(F.get(starts, b).alias("at"), F.lit(False).alias("odd"), none.alias("out"))
            return F.flatten(F.transform(_numbers(parts), lambda b: F.aggregate(_block(parts, b), zero(b), step, lambda acc: acc["out"])))

        return _let(_before(sums, lambda x, y: x + y), spans)

    return F.when(text.rlike(test), _let(F.split(marked, _MARK), found)).otherwise(none)


def rebuilt(text: Column, spans: Column, piece: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with ``piece(start, end, fresh)`` for each of the sorted (start, end); start is where the
    span leaves earlier ones, and fresh says whether it overlaps none."""

    def build(x: Column) -> Column:
        tops = F.transform(_numbers(x), lambda b: F.aggregate(_block(x, b), F.lit(0), lambda acc, y: F.greatest(acc, y["end"])))

        def put(reach: Column) -> Column:
            def block(b: Column) -> Column:
                first = F.get(reach, b)

                def pieces(own: Column) -> Column:
                    def step(acc: Column, y: Column) -> Column:
                        gap = F.substring(own, acc["at"] - first + 1, F.greatest(F.lit(0), y["start"] - acc["at"]))
                        new = piece(F.greatest(acc["at"], y["start"]), F.greatest(acc["at"], y["end"]), y["start"] >= acc["at"])
                        return F.struct(F.greatest(acc["at"], y["end"]).alias("at"), F.concat(acc["out"], F.array(gap, new)).alias("out"))

                    start = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))
                    return F.aggregate(_block(x, b), start, step, lambda acc: acc["out"])

                return _let(F.substring(text, first + 1, F.get(reach, b + 1) - first), pieces)

            rest = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
            return F.concat(F.array_join(F.flatten(F.transform(_numbers(x), block)), ""), rest)

        return _let(_before(tops, lambda a, c: F.greatest(a, c)), put)

    return F.when(F.size(spans) > 0, _let(spans, build)).otherwise(text)


def _bounds(*lists: Column) -> Column:
    """All spans as sorted (start, end)."""
    return F.array_sort(F.transform(F.concat(*lists), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))


def base_spans(text: Column) -> Column:
    """The spans ``assign``, ``access`` and ``hex`` of the fixed patterns, as a struct."""
    return F.struct(
        F.filter(matches(text, ASSIGN, ASSIGN.removesuffix("+)") + f"{{{MIN_ASSIGNED},}})"), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= MIN_ASSIGNED).alias("assign"),
        F.filter(matches(text, ACCESS, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"), lambda x: F.length(x["s"]) >= MIN_ACCESS).alias("access"),
        matches(text, HEX, HEX).alias("hex"),
    )


def _transitions(strings: DataFrame) -> list[float]:
    """Log2 probabilities of the transitions between the characters of ``strings(s)``, smoothed."""
    size = len(ALPHABET)
    pairs = strings.select("s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")).select(F.expr("substring(s, i, 2)").alias("pair"))
    counts, single = [0.0] * (size * size), [0.5] * size
    for row in pairs.groupBy("pair").count().collect():  # at most one row for each pair of the alphabet
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0:
            counts[a * size + b] += row["count"]
            single[b] += row["count"]
    # A character that is rare after any other stays rare after one that was never seen.
    share = [PRIOR * n / sum(single) for n in single]
    totals = [sum(counts[a * size : (a + 1) * size]) + PRIOR for a in range(size)]
    return [log2((c + share[i % size]) / totals[i // size]) for i, c in enumerate(counts)]


def train(docs: DataFrame) -> list[int]:
    """Log-likelihood ratios of all transitions, in thousandths of a bit."""
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS)
    # At most MAX_DOCUMENTS ids of eight bytes are broadcast.
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").select(text.alias("text"), base_spans(text).alias("base")).select("text", "base.*")
    values = F.concat(F.transform("assign", lambda x: F.regexp_extract(x["s"], ASSIGN, 2)), F.transform("access", lambda x: x["s"]), F.transform("hex", lambda x: x["s"]))
    cleaned = F.transform(values, lambda v: F.regexp_replace(v, "[^A-Za-z0-9+/_=-]", ""))
    digest = spark.range(DIGESTS).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    drawn = digest.select(F.explode(F.array(F.substring("h", 1, 40), F.base64(F.unhex("h")), F.upper(F.base64(F.unhex("h"))))).alias("s"))
    random = marked.select(F.explode(cleaned).alias("s")).where("length(s) > 1").union(drawn)
    clean = F.regexp_replace(F.col("text"), ASSIGN + "|" + ACCESS + "|[0-9a-f]{24,}", " ")
    plain = marked.select(F.explode(F.regexp_extract_all(clean, F.lit(f"({CANDIDATE})"), F.lit(1))).alias("s")).where("length(s) > 3")
    return [round(1000 * (p - q)) for p, q in zip(_transitions(random), _transitions(plain), strict=True)]


def holds_secret(s: Column, table: Column) -> Column:
    """Whether some stretch of a candidate string reaches the limits.

    ``recent`` has the running sums of the ratios beyond the limit at the last characters, ``low`` the
    least of those at which a stretch that is long enough can start.
    """
    chars = F.transform(F.split(s, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    steps = MIN_LENGTH - 1
    # A stretch has MIN_LENGTH - 1 transitions at least, and MIN_BITS in all follows where they suffice for it.
    each = int(1000 * max(MIN_BITS_EACH, MIN_BITS / steps))
    zero, far = F.lit(0).cast("long"), F.lit(1 << 62).cast("long")

    def step(acc: Column, b: Column) -> Column:
        now = F.element_at(acc["recent"], -1) + F.when(acc["a"] >= 0, F.coalesce(F.get(table, acc["a"] * len(ALPHABET) + b), F.lit(0)) - each).otherwise(zero)
        full = F.size(acc["recent"]) >= steps + 1
        low = F.when(full, F.least(acc["low"], F.get(acc["recent"], F.lit(1)))).otherwise(acc["low"])
        kept = F.when(full, F.slice(acc["recent"], 2, steps)).otherwise(acc["recent"])
        return F.struct(F.concat(kept, F.array(now)).alias("recent"), low.alias("low"), (acc["hit"] | (now >= low)).alias("hit"), b.alias("a"))

    return F.aggregate(chars, F.struct(F.array(zero).alias("recent"), far.alias("low"), F.lit(False).alias("hit"), F.lit(-1).alias("a")), step, lambda acc: acc["hit"])


def spans_of(text: Column, table: list[int]) -> Column:
    """The spans of the four kinds as a struct; ``markov`` has those that the models add."""
    text = F.coalesce(text, F.lit(""))
    values = F.lit(table) if table else F.array().cast("array<int>")

    def with_models(base: Column) -> Column:
        known = [base[k] for k in KINDS[:3]]
        blanked = rebuilt(text, _bounds(*known), lambda start, end, fresh: F.repeat(F.lit(" "), end - start))
        added = _let(blanked, lambda rest: F.filter(matches(rest, LONG, LONG), lambda c: holds_secret(c["s"], values)))
        return F.struct(*[x.alias(k) for k, x in zip(KINDS, [*known, added], strict=True)])

    return _let(base_spans(text), with_models)


def find(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``text`` and the spans of the four kinds in every document."""
    table = train(docs) if table is None else table
    return docs.select("doc_id", "text", spans_of(F.col("text"), table).alias("spans")).select("doc_id", "text", "spans.*")


def _listed(kinds: tuple[str, ...]) -> Column:
    """The spans of the kinds as ``kind:start:end``, by start and then kind."""

    def numbered(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("k"), x["end"].alias("end")))

    parts = [numbered(i, kind) for i, kind in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    number = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *number, F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def redact(docs: DataFrame, replacement: str = "[secret]") -> DataFrame:
    """The documents with every secret of the text replaced (overlapping ones once); ``n_chars`` follows
    where there were some, all else stays, null texts too.  Columns of any name are kept."""
    name = unused(docs, "spans")
    rows = docs.withColumn(name, spans_of(F.col("text"), train(docs)))
    spans = _bounds(*[F.col(name)[k] for k in KINDS])
    some = sum((F.size(F.col(name)[k]) for k in KINDS), F.lit(0)) > 0
    clean = rebuilt(F.col("text"), spans, lambda start, end, fresh: F.when(fresh, F.lit(replacement)).otherwise(F.lit("")))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(some, clean).otherwise(F.col("text"))}
    rows = rows.select(name, *[x.alias(c) for c, x in columns.items()])
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[f"`{c}`" for c in docs.columns])

"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction. DataFrame functions only.

Base kinds are regular expressions with a check of each match. For the bootstrapping, every identifier-like token
(letters, digits and underscores with a digit, 8 to 64 long) outside base matches is a candidate instance, and what
stands before it on its line (a word and the marks after it) is its lexical pattern. Seed instances are tokens of
well-known shapes; they only start the search. Patterns and instances form a graph that is scored in turns: a pattern by
the share of its distinct instances' scores, an instance by the patterns that lead to it (noisy or). A pattern of high
score that MIN_SUPPORT sure instances stand behind, seeds or found by other patterns, marks every candidate it leads to,
whatever its shape, so that these can lead to further patterns in the next turn, until scores settle.

The texts are scanned once, in code generated by Spark; later steps see spans only. The graph is an aggregation by
(pattern, instance) and so is small beside the texts; a hot pattern is joined as any other and split by skew handling.
What is marked depends on a text alone, so redaction joins the marks of texts back by their hashes: only texts that hold
a marked candidate, told by a Bloom filter of a fixed size, are shuffled.

Regular expressions start at run boundaries and use possessive repeats, so that they are linear in the text's length
and need no recursion; they match what the plain forms beside them match. Spans are summed up in two levels, and
overlaps are found by one walk over sorted spans, so a text of many spans takes no square of them. Cases: a null text
counts as empty. Very long texts are scanned whole. Repeated rows are scanned each (rows are told apart by position).
Null ids stay null. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_filter, cut, in_filter, pick

# The base patterns, in the order of the kinds.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Characters without which a kind cannot occur.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]{0,63}[0-9])[A-Za-z0-9_]{8,64}(?![A-Za-z0-9_])"
PATTERN = r"([\p{L}]*[^\p{L}0-9\n]{1,4})$"
# Shapes of seed instances: cloud access keys; hexadecimal secrets with letters and digits mixed.
SEED = r"^(?:AKIA[0-9A-Z]{16}|(?=(?:[a-f]*[0-9]){4})(?=(?:[0-9]*[a-f]){4})[0-9a-f]{16,64})$"
#: Turns at most; one that changes the sum of all scores by less than SETTLED is the last.
ROUNDS, SETTLED = 8, 0.01
SMOOTH = 2.0
MIN_SUPPORT = 3
MIN_SCORE = 0.5
#: Steps that are summed up together.
CHUNK = 64

SPAN = "array<struct<start:int,end:int,value:string,tail:string>>"


def _spans(gaps: Column, found: Column) -> Column:
    """Starts and ends, in code points, from the texts between matches and the matches: the lengths of chunks of steps
    are summed up first, then the steps inside each chunk."""
    steps = F.zip_with(gaps, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.coalesce(F.length(b), F.lit(0)).alias("size"), b.alias("value"), F.right(a, F.lit(40)).alias("tail")))

    def in_chunks(steps):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))

    def starts(chunks):
        lengths = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def merge(acc, x):
        first = acc["at"] + x["gap"]
        span = F.struct(first.alias("start"), (first + x["size"]).alias("end"), x["value"].alias("value"), x["tail"].alias("tail"))
        return F.struct((first + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    inside = lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), merge, lambda acc: acc["out"])
    spans = _let(_let(steps, in_chunks), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), inside)))
    return F.filter(spans, lambda x: x["value"].isNotNull())


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _free(candidates: Column, taken: Column) -> Column:
    """The candidates that overlap no taken span, by one walk over both in order: a candidate is hit by a span that
    starts before its end and ends behind its start. Verdicts gather as characters, each written when the next
    candidate comes."""
    event = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    events = F.sort_array(F.concat(F.transform(taken, event(0)), F.transform(candidates, event(1))))
    begin = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("end"), F.lit("").alias("last"), F.lit("").alias("out"))

    def walk(acc, x):
        is_taken = x["kind"] == 0
        return F.struct(
            F.when(is_taken, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"]).alias("reach"),
            F.when(is_taken, acc["end"]).otherwise(x["end"]).alias("end"),
            F.when(is_taken, F.when((acc["last"] != "") & (x["start"] < acc["end"]), "0").otherwise(acc["last"])).otherwise(F.when(acc["reach"] > x["start"], "0").otherwise("1")).alias("last"),
            F.when(is_taken, acc["out"]).otherwise(F.concat(acc["out"], acc["last"])).alias("out"),
        )

    verdicts = F.aggregate(events, begin, walk, lambda acc: F.concat(acc["out"], acc["last"]))
    told = F.zip_with(candidates, F.split(verdicts, ""), lambda c, v: F.struct(c.alias("c"), v.alias("v")))
    return F.transform(F.filter(told, lambda x: x["v"] == "1"), lambda x: x["c"])


def _with_matches(df: DataFrame, name: str, pattern: str, text: str = "text") -> DataFrame:
    """df with a column of all leftmost non-overlapping matches of the pattern."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if name in NEEDS:
        found = F.when(F.contains(F.col(text), F.lit(NEEDS[name])), found).otherwise(none)
    df = df.withColumn("_found", found)
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)).otherwise(none))
    return df.withColumn(name, F.when(F.size("_found") > 0, _spans(F.col("_gaps"), F.col("_found"))).otherwise(F.array().cast(SPAN))).drop("_found", "_gaps")


def _ip_ok(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(x["value"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.right(part(p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def _card_ok(x: Column) -> Column:
    digits = F.regexp_replace(x["value"], "[ -]", "")
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return n.between(13, 19) & F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _phone_ok(x: Column) -> Column:
    return F.length(F.regexp_replace(x["value"], "[^0-9]", "")).between(9, 15)


def _labels(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def _with_spans(df: DataFrame) -> DataFrame:
    """df, whose text has no nulls, with a column of spans for each base kind, and one of candidates outside all of
    them with their patterns."""
    for kind, pattern in BASE.items():
        df = _with_matches(df, kind, pattern)
    for kind, ok in (("ip", _ip_ok), ("card", _card_ok), ("phone", _phone_ok)):
        df = df.withColumn(kind, F.filter(kind, ok))
    df = _with_matches(df, "candidate", CANDIDATE)
    taken = F.concat(*BASE)
    free = F.when((F.size("candidate") > 0) & (F.size("_taken") > 0), _free(F.col("candidate"), F.col("_taken"))).otherwise(F.col("candidate"))
    df = df.withColumn("_taken", taken).withColumn("candidate", free).drop("_taken")
    bare = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    candidate = F.transform("candidate", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("instance"), F.lower(F.regexp_extract(x["tail"], PATTERN, 1)).alias("pattern")))
    return df.withColumns({k: bare(k) for k in BASE} | {"candidate": candidate})


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, spans of each base kind, and candidates of every row."""
    df = pick(docs, doc_id=id_col, text=text_col).withColumn("row_id", F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))
    return _with_spans(df).select("row_id", "doc_id", *BASE, "candidate")


def score_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score and turn (of the last scoring) of the patterns that mark identifiers, from rows of (pattern,
    instance)."""
    edges = cut(found.where(F.col("pattern") != "").groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.col("instance").rlike(SEED).cast("double")))
    scored, before = edges.withColumn("s", F.col("seed")), -1.0
    for turn in range(1, rounds + 1):
        patterns = scored.groupBy("pattern").agg((F.sum("s") / (F.count(F.lit(1)) + SMOOTH)).alias("score"), F.count_if(F.col("s") >= MIN_SCORE).alias("sure"))
        patterns = cut(patterns.where((F.col("sure") >= MIN_SUPPORT) & (F.col("score") >= MIN_SCORE)).select("pattern", "score", F.lit(turn).alias("turn")))
        total = patterns.agg(F.sum("score")).first()[0] or 0.0
        if abs(total - before) < SETTLED:
            break
        before = total
        led = edges.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("q"))
        scored = edges.join(led, "instance", "left").withColumn("s", F.greatest("seed", F.coalesce("q", F.lit(0.0)))).drop("q")
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, a column of spans for each base kind, and `id`, the spans of discovered identifiers."""
    slim = cut(base_spans(docs, id_col, text_col))
    candidates = slim.where(F.size("candidate") > 0).select("row_id", F.explode("candidate").alias("c")).select("row_id", "c.*")
    patterns = score_patterns(candidates.select("pattern", "instance"))
    marked = candidates.join(patterns, "pattern").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("id"))
    return slim.drop("candidate").join(marked, "row_id", "left").withColumn("id", F.coalesce("id", F.array().cast("array<struct<start:int,end:int>>")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span found in the text replaced by its kind in angle brackets; other columns and null texts as
    they are. Overlapping spans become one, named after the first. One pass finds the patterns and the marks of each
    text; a second applies them, where the text stands unless the filter says that it may have marks."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = lambda t: [F.xxhash64(t).alias("key"), F.xxhash64(t, F.lit(1)).alias("key2")]
    # Rows of one text are one row here.
    found = _with_spans(docs.select(text.alias("text"))).where(F.size("candidate") > 0)
    found = cut(found.select(*keys(F.col("text")), F.explode("candidate").alias("c")).select("key", "key2", "c.*").distinct())
    marked = cut(found.join(score_patterns(found.select("pattern", "instance")).select("pattern"), "pattern").groupBy("key", "key2").agg(F.collect_list(F.struct("start", "end")).alias("led")))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), *keys(text))
    work = in_filter(work, "key", cut(bit_filter(marked, "key")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    plain = work.where("NOT in_filter").select("row", "text", none.alias("led"))
    led = work.where("in_filter").join(marked, ["key", "key2"], "left").select("row", "text", F.coalesce("led", none).alias("led"))
    work, text = _with_spans(plain.unionByName(led)), F.col("text")
    kinds = {k: F.col(k) for k in BASE} | {"id": F.col("led")}

    def named(kind: str):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))

    spans = F.sort_array(F.concat(*[F.transform(c, named(k)) for k, c in kinds.items()]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def merge(acc, x):
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        fresh = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), x["kind"], F.lit(">"))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"))

    clean = F.aggregate("spans", begin, merge, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    work = work.withColumn("spans", spans)
    fresh = F.when(F.size("spans") > 0, clean).otherwise(F.col("row").getField(text_col))
    return work.select(*[fresh.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' hash and all spans as text, for every row of find_personal_data."""
    base = F.array_join(F.concat(*[_labels(k, F.col(k)) for k in BASE]), ",")
    everything = F.array_join(F.concat(*[_labels(k, F.col(k)) for k in [*BASE, "id"]]), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), everything.alias("spans"))

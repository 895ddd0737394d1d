"""Personal data: identifiers by form, and more of them by context patterns that the former bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

# Forms, each to match leftmost and without overlap. Runs are possessive and begin at their first character (or
# where the last match ended), which matches the same and takes time in proportion to the text.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
# What may be an identifier of no known form: a run of such characters with a digit or an at sign.
CANDIDATE = r"(?<![A-Za-z0-9@+:._%/-])[A-Za-z+:._%/-]*+[0-9@][A-Za-z0-9@+:._%/-]*+"
# Identifiers of several words: digits in groups with a blank or a bracket between them, and spelled addresses.
DIGIT_GROUP = r"[0-9]++(?:[./-][0-9]++)*+(?![A-Za-z0-9@%_+/:])"
BEFORE_WORD, AFTER_WORD = r"(?:\x20?[(\[{<]\x20?|[\x20_-])", r"(?:\x20?[)\]}>]\x20?|[\x20_-])"
AT, DOT = (rf"{BEFORE_WORD}(?i:{word}){AFTER_WORD}" for word in ("at", "dot"))
LOCAL_WORD = r"[A-Za-z0-9.%+]++(?:[_-](?!(?i:at|dot)[_-])[A-Za-z0-9.%+]++)*+"
HOST_WORD = r"[A-Za-z0-9]++(?:[_-](?!(?i:dot)[_-])[A-Za-z0-9]++)*+"
RUNS = {
    "digits": rf"(?<![A-Za-z0-9@+:._%/-])\+?\(?{DIGIT_GROUP}(?:(?:\)[\x20-]?|\x20\(?|\(){DIGIT_GROUP})++",
    # begins with the first of its words: from a later one the same search would end at the same place
    "spelled": rf"(?<![A-Za-z0-9._%+-])(?<![A-Za-z0-9.%+]{DOT}){LOCAL_WORD}(?:{DOT}{LOCAL_WORD})*+{AT}{HOST_WORD}(?:{DOT}{HOST_WORD})++",
}
SHAPES = {
    "email": r"@|(?i)[^a-z]at[^a-z].*[^a-z]dot[^a-z]",
    "ip": r"^[0-9a-fA-F]*[.:][0-9a-fA-F.:]*[.:][0-9a-fA-F.:]*$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^\+?(?:[^0-9A-Za-z]*[0-9]){7,15}[^0-9A-Za-z]*$",
}
KINDS = list(FORMS)
LEAST_RISE = 1e-6  # of a score; with less it rests
LEAST_SUPPORT = 3.0  # identifiers of a kind that a pattern must be seen with
PATTERN_CONFIDENCE = 0.6
INSTANCE_CONFIDENCE = 0.8


def _near_words(gap: Column, before: bool) -> Column:
    """The two words next to a gap's end or start, lower case and without digits; '^' where the gap ends."""
    part = T.last_words(gap, 2) if before else T.first_words(gap, 1)
    words = F.regexp_extract_all(F.regexp_replace(F.lower(part), "[0-9]+", "#"), F.lit(T.WORD), F.lit(0))
    return F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), -2, 2) if before else F.slice(F.concat(words, F.array(F.lit("^"))), 1, 1)


def _found(text: Column, kind: str, pattern: str, there: Column) -> Column:
    """Matches of a pattern as structs: kind, i, gap (characters since the match before), value, context."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def cells(pair: Column) -> Column:
        return F.transform(
            pair["values"],
            lambda value, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.length(F.get(pair["gaps"], i)).alias("gap"),
                value.alias("value"),
                _near_words(F.get(pair["gaps"], i), True).alias("left"),
                _near_words(F.get(pair["gaps"], i + 1), False).alias("right"),
            ),
        )

    pair = F.struct(gaps.alias("gaps"), values.alias("values"))
    nothing = F.array().cast("array<struct<kind:string,i:int,gap:int,value:string,left:array<string>,right:array<string>>>")
    return F.when(there, F.transform(F.array(pair), cells)[0]).otherwise(nothing)


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, found: a row per row of docs with all its matches, stored; row numbers stay."""
    text = F.coalesce(docs["text"], F.lit(""))
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    parts = [
        _found(text, "email", FORMS["email"], at),
        _found(text, "ip", FORMS["ip"], digit),
        _found(text, "card", FORMS["card"], digit),
        _found(text, "phone", FORMS["phone"], F.contains(text, F.lit("+")) & digit),
        _found(text, "", CANDIDATE, digit | at),
        _found(text, "digits", RUNS["digits"], digit),
        _found(text, "spelled", RUNS["spelled"], text.rlike("(?i)dot")),
    ]
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], F.concat(*parts).alias("found")), "found")


def _fitting(value: Column) -> Column:
    """The kinds whose shape a value has."""
    return F.array_compact(F.array(*[F.when(value.rlike(SHAPES[kind]), F.lit(kind)) for kind in KINDS]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(digit: Column, i: Column) -> Column:
        number = digit.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(number > 9, number - 9).otherwise(number)

    each = F.transform(F.split(F.reverse(digits), ""), part)
    return F.aggregate(each, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def mentions(scanned: DataFrame) -> DataFrame:
    """row, kind ('' for candidates), value, begin, end, patterns: valid matches, and candidates apart from them.

    A word inside a run of several is a candidate of its own only if it has the shape of an identifier by itself.
    """
    cells = scanned.select("row", F.inline("found"))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("gap") + F.length("value")).over(before), F.lit(0))
    trimmed = F.when(F.col("kind") == "", F.regexp_replace("value", "[.:]+$", "")).otherwise(F.col("value"))
    placed = cells.withColumn("begin", passed + F.col("gap")).withColumn("value", trimmed)
    placed = placed.withColumn("end", F.col("begin") + F.length("value"))
    digits = F.length(_digits(F.col("value")))
    valid = (
        F.when(F.col("kind") == "ip", F.col("value").rlike(VALID_IP))
        .when(F.col("kind") == "card", digits.between(14, 19) & _luhn(_digits(F.col("value"))))
        .when(F.col("kind") == "phone", digits.between(10, 15))
        .when(F.col("kind").isin(*RUNS), F.size(_fitting(F.lower("value"))) > 0)
        .otherwise(True)
    )
    left, right = F.col("left"), F.col("right")
    patterns = F.array(
        F.concat(F.lit("2:"), left[0], F.lit(" "), left[1]),
        F.concat(F.lit("1:"), left[1], F.lit(" | "), right[0]),
        F.concat(F.lit("0:"), left[1]),
    )
    placed = placed.filter(valid).select("row", "kind", "value", "begin", "end", patterns.alias("patterns"))
    # a candidate that touches a valid match is no candidate
    known, run = F.col("kind").isin(*KINDS), F.col("kind").isin(*RUNS)
    by_place = Window.partitionBy("row").orderBy("begin", F.when(known, 0).when(run, 1).otherwise(2))
    before, after = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(1, Window.unboundedFollowing)
    known_end, known_begin = F.max(F.when(known, F.col("end"))).over(before), F.min(F.when(known, F.col("begin"))).over(after)
    apart = (F.coalesce(known_end, F.lit(0)) <= F.col("begin")) & (F.coalesce(known_begin, F.col("end")) >= F.col("end"))
    marked = placed.withColumn("apart", known | apart).filter("apart").drop("apart")
    run_end = F.coalesce(F.max(F.when(run, F.col("end"))).over(before), F.lit(0))
    same = F.coalesce(F.max(F.when(run, F.struct("begin", "end"))).over(before) == F.struct("begin", "end"), F.lit(False))
    alone = (run_end < F.col("end")) | (~same & (F.size(_fitting(F.lower("value"))) > 0))
    marked = marked.withColumn("alone", known | run | alone).filter("alone").drop("alone")
    marked = marked.withColumn("kind", F.when(run, "").otherwise(F.col("kind")))
    return stored(marked, "mentions")


def discover(found: DataFrame) -> DataFrame:
    """value, kind of candidates that confident patterns reach.

    Patterns and values are the two sides of a graph, each distinct edge counted once. In a round, a pattern's
    confidence for a kind is the score of the values it is seen with over their number; a candidate of fitting shape
    gets the chance that one of its confident patterns is right; those that pass become seeds of the next round. More
    seeds only raise confidences and chances, so rounds go on until no value is new and no score rises.
    """
    value = F.lower("value").alias("value")
    edges = found.select(F.explode("patterns").alias("pattern"), value, "kind").distinct()
    edges = stored(edges, "edges")
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    candidates = edges.filter("kind = ''").select("pattern", "value").withColumn("kind", F.explode(_fitting(F.col("value"))))
    candidates = stored(candidates, "candidates")
    seeds = edges.filter("kind <> ''").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    reached = None
    while True:
        scored = seeds
        if reached is not None:
            scored = seeds.unionByName(candidates.join(reached, ["value", "kind"]).select("pattern", "value", "kind", "score"))
        support = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("support")).filter(F.col("support") >= LEAST_SUPPORT)
        confident = support.join(totals, "pattern").withColumn("confidence", F.least(F.lit(0.99), F.col("support") / F.col("total")))
        confident = confident.filter(F.col("confidence") >= PATTERN_CONFIDENCE).select("pattern", "kind", "confidence")
        missed = F.round(F.sum(F.log(1 - F.col("confidence"))), 9)
        chances = candidates.join(confident, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(missed)).alias("score"))
        after = stored(chances.filter(F.col("score") >= INSTANCE_CONFIDENCE), "reached")
        before = reached
        reached = after
        if before is None:
            rests = after.isEmpty()
        else:
            old = before.withColumnRenamed("score", "old")
            rests = after.join(old, ["value", "kind"], "left").filter(F.coalesce(F.col("score") - F.col("old"), F.lit(1.0)) > LEAST_RISE).isEmpty()
        if rests:
            break
    best = reached.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return best


def held_out_recall(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """kind, withheld, reached, wrong: how many identifiers contexts find that are not told to be any.

    Of the distinct base values of each kind one in so many, drawn by hash, are made candidates in all places; reached
    counts those that patterns of the other seeds give back with their kind, wrong those with another one. A kind of
    which nothing is drawn has no row. Nulls, empty texts and repeated rows count as in personal_data.
    """
    found = mentions(scan(T.needed(docs, "doc_id", "text")))
    drawn = F.col("kind").isin(*KINDS) & (F.pmod(F.xxhash64(F.lower("value")), F.lit(one_in)) == 0)
    hidden = found.withColumn("kind", F.when(drawn, "").otherwise(F.col("kind")))
    reached = discover(hidden).withColumnsRenamed({"value": "_value", "kind": "_kind"})
    withheld = found.filter(drawn).select("kind", F.lower("value").alias("value")).distinct()
    return withheld.join(reached, F.col("value") == F.col("_value"), "left").groupBy("kind").agg(
        F.count("*").alias("withheld"),
        F.count_if(F.col("_kind") == F.col("kind")).alias("reached"),
        F.count_if(F.col("_kind") != F.col("kind")).alias("wrong"),
    )


def _joined_spans(spans: Column) -> Column:
    """kind:begin:end by begin, then kind in the order of KINDS, joined by commas."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found: one row per row of docs.

    Base spans are the valid matches of each form in the whole text, in code points, end exclusive; base_sha256 is the
    digest of them. spans also has the n_found ones that contexts discovered; those never touch a base span. A null
    or empty text has none. Of discovered ones inside one another the longest stays. Repeated rows are rows of their own, but their values count once in the graph.
    """
    frame = T.needed(docs, "doc_id", "text")
    scanned = scan(frame)
    found = mentions(scanned)
    reached = discover(found).withColumnsRenamed({"value": "_value", "kind": "_kind"})
    more = found.filter("kind = ''").join(reached, F.lower("value") == F.col("_value"))
    # of reached candidates inside one another the longest stays
    outer_end = F.max("end").over(Window.partitionBy("row").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    more = more.withColumn("_outer", F.coalesce(outer_end, F.lit(0))).filter(F.col("_outer") < F.col("end"))
    base = found.filter("kind <> ''").select("row", "kind", "begin", "end", F.lit(True).alias("base"))
    spans = base.unionByName(more.select("row", F.col("_kind").alias("kind"), "begin", "end", F.lit(False).alias("base")))
    order = F.element_at(F.create_map(*[x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))]), F.col("kind"))
    cell = F.struct("begin", order.alias("order"), "end", "kind")
    each = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
        F.count_if(~F.col("base")).alias("n_found"),
        F.collect_list(F.when(F.col("base"), cell)).alias("base_spans"),
        F.collect_list(cell).alias("all_spans"),
    )
    rows = scanned.select("row", "doc_id").join(each, "row", "left")
    number = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.select(
        "doc_id",
        *[number(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce(_joined_spans(F.col("base_spans")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined_spans(F.col("all_spans")), F.lit("")).alias("spans"),
        number("n_found"),
    )

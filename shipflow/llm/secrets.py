"""Secrets in texts: candidates by form, false ones removed by a random forest trained on labelled findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

# A candidate is a longest run of such characters, of 12 or more, with a digit; and any value of a secret-like name.
CHARACTERS = "A-Za-z0-9+/_.@%-"
CANDIDATE = rf"(?<![{CHARACTERS}])(?=[A-Za-z+/_.@%-]*+[0-9])[{CHARACTERS}]{{12,}}+"
WORDS_BEFORE, WORDS_AFTER = 4, 2  # of the text beside a candidate
SECRET_NAMES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
ASSIGNED = rf"{SECRET_NAMES}[A-Za-z0-9_-]*[\x20\x09]*[=:][\x20\x09]*[\"']?$"
# Values assigned to a name or following one, quoted or up to a blank. Each form is what leads to the value, and it.
SIGN = r"[\"']?[\x20\x09]*+(?:(?:is|was|are)[\x20\x09]*+)?(?:=>|->|[=:]{1,2})[\x20\x09]*+(?:(?:bearer|basic|token)[\x20\x09]++)?"
NAMED = rf"{SECRET_NAMES}[A-Za-z0-9_-]*+{SIGN}"
FOLLOWED = rf"(?<![A-Za-z]){SECRET_NAMES}s?(?:[0-9_-][A-Za-z0-9_-]*+)?[\x20\x09]++(?:(?:is|was|are)[\x20\x09]++)?+"
PLAIN = rf"(?!{NAMED})[^\x20\x09-\x0D\"'](?:(?![&;,][A-Za-z0-9_-]++[=:])(?:[^\x20\x09-\x0D\"']|[\"'](?=[^\x20\x09-\x0D\"',;)}}\]])))*+"
VALUE = rf"(?:\"(?:[^\"\\\n]|\\.)++\"|'(?:[^'\\\n]|\\.)++'|[\"']?{PLAIN})"
VALUE_FORMS = {
    NAMED: rf"{NAMED}{VALUE}",
    FOLLOWED: rf"{FOLLOWED}(?!(?:is|was|are)?[\x20\x09]*+(?:[=:]|->)|{SECRET_NAMES}s?[\x20\x09]){VALUE}",
}
KEY_FORMS = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk-[A-Za-z0-9_-]{20,}$"
# What a candidate is instead of a secret: an address, a host or file name, a number.
OTHER_FORMS = r"@[A-Za-z0-9-]+\.|^(?:[A-Za-z0-9-]+\.)+[a-z]{2,4}$|^[0-9.+%/-]+$|/.*\.[a-z]{2,4}$"
TRAINING_ROWS = 20_000  # labelled findings the forest is fitted on, at most, drawn by hash
DICTIONARY_SHARE = 0.002  # of all documents
FEATURES = (
    "length digits upper lower other transitions distinct hexadecimal covered slashes dots at example"
    " assigned quoted left_word right_word document_path"
).split()
TREES, DEPTH, SEED = 40, 6, 7


def _share(value: Column, characters: str) -> Column:
    return F.regexp_count(value, F.lit(f"[{characters}]")) / F.length(value)


def _value(rest: Column, lead: Column) -> Column:
    """A value without its closing quote, or without the marks of the sentence around it."""
    marks = F.when(rest.rlike(r"[(\[{<]"), F.regexp_replace(rest, r"[,;.]+$", "")).otherwise(F.regexp_replace(rest, r"[,;.)\]}>]+$", ""))
    closed = lead.rlike("[\"']$") & (F.right(rest, F.lit(1)) == F.right(lead, F.lit(1)))
    return F.when(closed, F.left(rest, F.length(rest) - 1)).otherwise(marks)


def _found(text: Column, form: int, pattern: str, leading: str | None = None) -> Column:
    """Matches of a pattern as structs; the value is what comes after the leading part."""
    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("wholes"))

    def cell(p: Column, whole: Column, i: Column) -> Column:
        lead = F.regexp_extract(whole, rf"^(?:{leading})[\"']?", 0) if leading else F.lit("")
        rest = F.substr(whole, F.length(lead) + 1)
        value = _value(rest, lead) if leading else whole
        tail = F.substr(rest, F.length(value) + 1)
        return F.struct(
            F.lit(form).alias("form"),
            i.alias("i"),
            F.length(F.get(p["gaps"], i)).alias("gap"),
            F.length(whole).alias("whole"),
            F.length(lead).alias("lead"),
            value.alias("value"),
            T.last_words(F.concat(F.get(p["gaps"], i), lead), WORDS_BEFORE).alias("left"),
            T.first_words(F.concat(tail, F.get(p["gaps"], i + 1)), WORDS_AFTER).alias("right"),
        )

    return F.transform(F.array(pair), lambda p: F.transform(p["wholes"], lambda whole, i: cell(p, whole, i)))[0]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, begin, end, value, left, right: every candidate of each whole text, each span once.

    left and right are the words next to it, four before and two after at most, whole, and none of the candidates of its
    form beside it. The value of a name may hold candidates that are runs; it does not replace them.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    runs, named = _found(text, 0, CANDIDATE), text.rlike(SECRET_NAMES)
    values = [_found(text, form, pattern, leading) for form, (leading, pattern) in enumerate(VALUE_FORMS.items(), 1)]
    found = docs.filter(text.rlike("[0-9]") | named).select("doc_id", "source", F.when(named, F.concat(runs, *values)).otherwise(runs).alias("found"))
    found = found.filter(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id())
    rows = stored(found, "found").select("row", "doc_id", "source", F.inline("found"))
    before = Window.partitionBy("row", "form").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("gap") + F.col("whole")).over(before), F.lit(0)) + F.col("gap") + F.col("lead")
    placed = rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("value")).filter("value <> ''")
    copy = F.row_number().over(Window.partitionBy("row", "begin", "end").orderBy("form"))
    return placed.withColumn("copy", copy).filter("copy = 1").select("doc_id", "source", "begin", "end", "value", "left", "right")


def dictionary(docs: DataFrame, least_share: float = DICTIONARY_SHARE) -> DataFrame:
    """Words of three letters or more, lower case, that more than this share of all documents and two different texts have.

    A share, so that a corpus and many times the same corpus have one dictionary.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"), F.lit(0)))
    each = docs.select(F.xxhash64("text").alias("text"), F.explode(words).alias("word"))
    counted = each.groupBy("word").agg(F.count("*").alias("documents"), (F.min("text") < F.max("text")).alias("several"))
    return counted.filter(F.col("several") & (F.col("documents") > least_share * docs.count())).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with their numeric features; `covered` is the share of characters in dictionary words."""
    value = F.col("value")
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    left_word = F.lower(F.regexp_extract("left", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    right_word = F.lower(F.regexp_extract("right", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    transitions = sum((F.regexp_count(value, F.lit(f"[{c}](?=[^{c}])")) for c in ("a-z", "A-Z", "0-9")), F.lit(0))
    columns = {
        "length": F.length(value),
        "digits": _share(value, "0-9"),
        "upper": _share(value, "A-Z"),
        "lower": _share(value, "a-z"),
        "other": _share(value, "^A-Za-z0-9"),
        "transitions": transitions / F.length(value),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "hexadecimal": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "covered": F.coalesce("covered", F.lit(0)) / F.length(value),
        "slashes": F.regexp_count(value, F.lit("/")),
        "dots": F.regexp_count(value, F.lit("[.]")),
        "at": F.contains(value, F.lit("@")),
        "example": value.rlike("(?i)example|sample|dummy|test|xxxx"),
        "assigned": F.col("left").rlike(r"[=:][\x20\x09]*[\"']?$"),
        "quoted": F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']"),
        "left_word": left_word.rlike(SECRET_NAMES) | F.col("left").rlike(SECRET_NAMES + r"[^A-Za-z]*$"),
        "right_word": right_word.rlike(SECRET_NAMES),
        "document_path": F.coalesce(F.col("source").rlike("(?i)test|example|fixture|doc"), F.lit(False)),
    }
    joined = found.join(covered, "value", "left")
    return joined.withColumns({f"f_{name}": F.coalesce(columns[name].cast("double"), F.lit(0.0)) for name in FEATURES}).drop("covered")


def label() -> Column:
    """1 for findings whose form or assignment confirms them, 0 for what is something else, else null.

    Something else is what has another known form, or consists of dictionary words for the most part. Of assigned values
    that are no runs, those of 6 characters or more with a digit and a letter, or not mostly of words, are confirmed;
    words without a digit are something else; the others (short ones, numbers, addresses) have no label.
    """
    value, assigned = F.col("value"), F.col("left").rlike(ASSIGNED)
    run = value.rlike(rf"^(?=[^0-9]*+[0-9])[{CHARACTERS}]{{12,}}+$")
    words, other, digit = F.col("f_covered") >= 0.5, value.rlike(OTHER_FORMS) | value.rlike("://"), value.rlike("[0-9]")
    likely = (F.length(value) >= 6) & ~other & ~value.rlike(r"[\x20\x09]") & (~words | (digit & value.rlike("[A-Za-z]")))
    confirmed = value.rlike(KEY_FORMS) | (assigned & (run | likely))
    unknown = assigned & ~(words & ~digit)
    return F.when(confirmed, 1.0).when(unknown, F.lit(None)).when(value.rlike(OTHER_FORMS) | words, 0.0)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{name}" for name in FEATURES], outputCol="features").transform(rows)


def train(labelled: DataFrame, most_rows: int = TRAINING_ROWS) -> RandomForestClassificationModel | None:
    """A forest fitted on findings with features and label; None unless both labels are there.

    At most most_rows of them, a value counted once, those of least hash: the same in each run. They are put in one
    order, as the trees draw their samples from it.
    """
    names = [f"f_{name}" for name in FEATURES]
    rows = labelled.filter("label IS NOT NULL").groupBy("value", "label").agg(*[F.max(name).alias(name) for name in names])
    drawn = rows.orderBy(F.xxhash64("value"), "value", "label").limit(most_rows)
    drawn = stored(drawn.coalesce(1).sortWithinPartitions(F.xxhash64("value"), "value", "label"), "training")
    if drawn.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(_assembled(drawn.coalesce(1)))


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Findings with features as doc_id, begin, end, value, score, is_secret.

    Without a model (nothing to learn from) the score is the label, and 0 where there is none.
    """
    if model is None:
        score = F.coalesce("label", F.lit(0.0))
        scored = found.withColumn("score", score)
    else:
        scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "begin", "end", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def findings(docs: DataFrame) -> DataFrame:
    """All candidates of docs with features and label, stored. Null texts have none; repeated rows have their own."""
    frame = T.needed(docs, "doc_id", "source", "text")
    found = stored(candidates(frame), "candidates")
    return stored(with_features(found, dictionary(frame)).withColumn("label", label()), "findings")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, most_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, begin, end (code points, end exclusive), value, score, is_secret: a row per candidate of each text.

    labelled: findings with features and label to learn from; by default those of docs that a confirmed form labels.
    An empty table has no candidates and gives no rows.
    """
    found = findings(docs)
    return judge(found, train(found if labelled is None else labelled, most_rows))

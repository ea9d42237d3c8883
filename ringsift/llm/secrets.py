"""Secret scan with a random forest that removes false positives; DataFrame and SQL functions only.

A finding is a run of 16 or more characters that keys are made of, inside a word, or what is assigned
to a keyword, whatever its length. Its features are its length, changes between classes of characters,
how much of it is words that stand in the corpus, whether it stands in a path or address, and the words
next to it. Findings are labelled by a given table, or else by rules: known formats are secrets, and so is
one in two of the values that are assigned to a keyword; plain numbers and plain words without a keyword
are none. The other half of the assigned values, and all that the rules do not know, carry no label and are
left to the forest, which is trained on a bounded sample of the labelled ones. What the rules go by, the
keyword, the assignment and its quotes, are no features of it and are taken out of the neighbouring words,
so it cannot repeat them: it learns from the value and what else surrounds it, and decides on all findings,
labelled ones too.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

VALUE = "[A-Za-z0-9+/_-]{16,}"
#: Letters of the shortest words that count for coverage.
LEAST_LETTERS = 3
#: Documents in which a word must stand to be one of the dictionary.
LEAST_DOCS = 2
#: One in so many of the different values that are assigned to a keyword is labelled a secret.
BELIEVED = 2
#: Different labelled values of each label that the forest is trained on, at most.
SAMPLE = 5000
TREES, DEPTH, SEED = 40, 6, 7
#: A finding with this score or more is a secret.
THRESHOLD = 0.5

KEYWORDS = "token|passw|pwd|secret|api.?key|access.?key|auth|credential|private.?key|bearer"
#: A keyword, an equals sign or colon, and the value, which ends the words that are looked at.
KEYED = f"(?i)(?:{KEYWORDS})[A-Za-z0-9_-]*[\"']? ?[=:]+ ?[\"']?([^\\s\"',;=:]+)\\S*$"
#: Formats that vendors document: access key ids, tokens with a prefix, keys of services.
FORMATS = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^sk_live_[0-9A-Za-z]{16}|^AIza[0-9A-Za-z_-]{35}$|^glpat-"
#: Values that documentation puts where a key would stand.
DUMMIES = "(?i)example|x{8}|0{12}|1234567890"

FEATURES = ["length", "transitions", "distinct_share", "digit_share", "coverage", "path_depth", "address", "neighbour_letters", "neighbour_words"]


def findings(docs: DataFrame) -> DataFrame:
    """One row per finding: doc_id, ordinal (from 0, in text order), value, what stands around it, copies."""
    # The words are bound once per text by a lambda's name: as a column, they would be split again for every word.
    around = "concat_ws(' ', get(w, i - 2), get(w, i - 1)) as before, coalesce(get(w, i + 1), '') as after"
    signs = "(contains(x, '=') or contains(x, ':') or coalesce(right(get(w, i - 1), 1) in ('=', ':'), false))"
    candidates = f"""filter(transform(w, (x, i) -> struct(x as word, {around},
        if(length(x) >= 16, regexp_extract_all(x, _run, 1), cast(array() as array<string>)) as runs,
        if({signs}, regexp_extract(concat_ws(' ', get(w, i - 2), get(w, i - 1), x), _keyed, 1), '') as keyed)),
      p -> size(p.runs) > 0 or p.keyed <> '')"""
    values = f"""flatten(transform(flatten(transform(array(split(text, _blank)), w -> {candidates})), p -> transform(
        concat(p.runs, filter(array(p.keyed), v -> v <> '' and not exists(p.runs, r -> instr(v, r) > 0))),
        v -> struct(v as value, p.word as word, p.before as before, p.after as after))))"""
    # Python's string form of a pattern is not SQL's, so patterns come as columns of one value.
    patterns = {"_keyed": F.lit(KEYED), "_run": F.lit(f"({VALUE})"), "_blank": F.lit(r"[ \t\n\x0B\f\r]+")}
    held = docs.select("doc_id", "text").withColumns({"_text": F.xxhash64("text"), **patterns})
    rows = held.select("doc_id", "_text", F.posexplode(F.expr(values)).alias("ordinal", "f"))
    parts = rows.select("doc_id", "_text", F.col("ordinal").cast("bigint").alias("ordinal"), "f.*")
    counted = parts.groupBy(*parts.columns).agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("prefix", F.expr("substring(word, 1, locate(value, word) - 1)"))


def dictionary(docs: DataFrame) -> DataFrame:
    """The words of letters only that stand by themselves in two documents or more, lower case; fragments of keys do not."""
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_+/=-]+"))
    words = docs.select(F.explode(tokens).alias("part")).filter(F.col("part").rlike(f"^\\p{{L}}{{{LEAST_LETTERS},}}$"))
    return words.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCS).select("part")


def _parts(value: Column) -> Column:
    """The runs of letters of a value, cut where a small letter meets a capital one."""
    return F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with ``FEATURES``; coverage is worked out once per distinct value."""
    n = F.length("value").cast("double")
    cut = found.select("value").distinct().select("value", F.explode(_parts(F.col("value"))).alias("part"))
    known = cut.join(words.withColumn("_in", F.lit(1)), "part", "left")
    covered = known.groupBy("value").agg(F.sum(F.when(F.col("_in") == 1, F.length("part")).otherwise(0)).alias("_covered"))
    classes = "value"
    for pattern, name in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^aA0]", "_")):
        classes = F.regexp_replace(classes, pattern, name)
    flag = lambda c: c.cast("double")
    around = F.concat_ws(" ", "before", "prefix")
    # Keywords and lone signs are what the labels rest on, so they do not count as neighbours.
    beside = F.filter(F.split(F.concat_ws(" ", "before", "after"), " "), lambda x: (x != "") & ~x.rlike(f"(?i){KEYWORDS}") & x.rlike("[\\p{L}\\p{N}]"))
    letters = F.length(F.regexp_replace(F.concat_ws("", "_beside"), "[^\\p{L}]", ""))
    return (
        found.join(covered, "value")
        .withColumn("length", n)
        .withColumn("transitions", (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / F.greatest(n - 1, F.lit(1.0)))
        .withColumn("distinct_share", F.size(F.array_distinct(F.split("value", ""))) / n)
        .withColumn("digit_share", (n - F.length(F.regexp_replace("value", "[0-9]", ""))) / n)
        .withColumn("coverage", F.col("_covered") / n)
        .withColumn("path_depth", (F.length("word") - F.length(F.replace("word", F.lit("/"), F.lit("")))).cast("double"))
        .withColumn("address", flag(F.col("word").rlike("://|@|^www[.]|[.](com|org|net)")))
        .withColumn("keyword", flag(around.rlike(f"(?i)({KEYWORDS})")))
        .withColumn("assigned", flag(around.rlike("[=:][\"' ]*$")))
        .withColumn("quoted", flag(F.col("prefix").rlike("[\"']$")))
        .withColumn("_beside", beside)
        .withColumn("neighbour_letters", F.when(F.size("_beside") == 0, 1.0).otherwise(letters / F.length(F.concat_ws("", "_beside"))))
        .withColumn("neighbour_words", F.when(F.size("_beside") == 0, 1.0).otherwise(
            F.size(F.filter("_beside", lambda x: x.rlike("^\\p{L}+[.,;!?]?$"))) / F.size("_beside")))
        .drop("_covered", "_beside")
    )


def labelled(found: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """label 1 for secrets, 0 for what is none, null where only the forest can tell.

    ``labels`` (value_sha256, label) goes first: findings that somebody has judged. Else a value of a known format is a
    secret, one of a dummy's form none; without digits, or of digits and separators only, none unless a keyword stands before it;
    with digits and assigned to a keyword, a secret if the value's hash chooses it, the same value always or never.
    """
    value = F.col("value")
    plain = (value.rlike("^[A-Za-z/_+-]+$") | value.rlike("^[0-9/_+-]+$")) & (F.col("keyword") == 0)
    out = found.withColumn("value_sha256", F.sha2("value", 256))
    chosen = (F.col("keyword") == 1) & (F.col("assigned") == 1) & value.rlike("[0-9]") & (F.pmod(F.xxhash64("value"), F.lit(BELIEVED)) == 0)
    ruled = F.when(value.rlike(DUMMIES), 0).when(value.rlike(FORMATS) | chosen, 1).when(plain, 0)
    if labels is None:
        return out.withColumn("label", ruled.cast("int"))
    judged = labels.groupBy("value_sha256").agg(F.max(F.col("label").cast("int")).alias("_judged"))
    return out.join(judged, "value_sha256", "left").withColumn("label", F.coalesce("_judged", ruled).cast("int")).drop("_judged")


def _sample(found: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` different values of each label, by hash, each as it stands in one place; each label weighs the same."""
    place = F.struct(F.xxhash64("value", "_text", "ordinal"), "_text", "ordinal")
    known = found.filter("label is not null").groupBy("label", "value").agg(F.min_by(F.struct(*FEATURES), place).alias("f"))
    known = known.select("label", "value", F.xxhash64("value").alias("_o"), "f.*")
    parts = [known.filter(F.col("label") == i).sort("_o", "value").limit(SAMPLE) for i in (0, 1)]
    drawn = stored(parts[0].unionByName(parts[1]), "sample")
    sizes = drawn.groupBy("label").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return drawn.join(sizes, "label").repartition(1).sortWithinPartitions("_o", "value", "label")


def score(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per finding: doc_id, ordinal, copies, value_sha256, the features, label, score, is_secret.

    ``labels`` (value_sha256, label) names findings that have been judged; see ``labelled``. A null or empty
    text has no findings; values themselves are not returned. Findings are numbered in each text; rows that
    repeat a doc_id and a text give one row with the number of copies. Null ids are spread by their texts.
    Without labels of both kinds there is no forest: what is assigned to a keyword and has a digit scores 1
    then, all else 0. Further columns are left out; an empty table stays empty; texts are read whole.
    """
    found = stored(labelled(features(stored(findings(docs), "findings"), dictionary(docs)), labels), "labelled")
    sample = stored(_sample(found), "training")
    if sample.select("label").distinct().count() == 2:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        fitted = forest.fit(assembler.transform(sample))
        scored = fitted.transform(assembler.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("score", F.col("keyword") * F.col("assigned") * F.signum("digit_share"))
    return scored.select(
        "doc_id", "ordinal", "copies", "value_sha256", *FEATURES, "keyword", "assigned", "quoted", "label", "score", (F.col("score") >= THRESHOLD).alias("is_secret"),
    )

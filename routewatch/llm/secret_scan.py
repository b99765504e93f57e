"""Secrets in texts: candidate strings scored by a random forest that removes false positives.

DataFrame functions and Spark's own forest only. A candidate is a run of at least 16 letters, digits
and ``+/=_-`` within a word. Its features are its length and make-up, how usual its character
transitions are in the corpus, how much of it dictionary words cover, whether it looks like a path,
and the words beside it. The forest is trained from labelled findings (a bounded sample of each
label). Without findings reviewed by people, ``rule_labels`` marks the clear ones.

Both language tables are of bounded size whatever the corpus: 27 x 27 transitions, and the letter
triples (at most 17,576) of words that make up a set share of all words.
"""

import json
import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .quality import fold
from .shared import whole_text, written

CANDIDATE = r"[A-Za-z0-9+/=_-]{16,}"
SPACES = r"[\x20\x09-\x0D]+"
#: A dictionary word makes up at least this share of all words.
WORD_SHARE = 1e-6
#: The bound of the training sample, for each label, and the forest's size.
TRAIN_ROWS, TREES, DEPTH, SEED = 10_000, 20, 6, 5
#: Names that stand before secrets, and letters of a key's wrapping.
NAMES = r"(?i)(token|secret|passw|passphrase|api_?key|access_?key|private|auth|credential)"
FEATURES = [
    "chars", "digits", "uppers", "lowers", "signs", "turns", "case_turns", "vowels", "letters_run", "different", "transitions",
    "coverage", "slashes", "extension", "has_scheme", "assigned", "named", "quoted", "word_rest", "next_plain",
]


def words_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(whole_text(docs), SPACES).alias("words"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, part, finding, and the words around it. Words are numbered from 0, parts of a word too."""
    words = words_of(docs)
    long_ones = F.filter(F.transform("words", lambda w, i: F.when(F.octet_length(w) >= 16, i)), lambda i: i.isNotNull())
    rows = words.select("doc_id", "words", F.explode(long_ones).alias("word_no"))
    at = lambda back: F.coalesce(F.get("words", F.col("word_no") + back), F.lit(""))
    rows = rows.select("doc_id", "word_no", at(0).alias("word"), at(-1).alias("before"), at(-2).alias("before2"), at(1).alias("after"))
    return rows.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("part", "finding"))


def language_tables(docs: DataFrame, share=WORD_SHARE):
    """Log-probabilities of transitions between the letters a-z and anything else, and the dictionary's letter triples.

    Counted over all words of all documents: words are combined in the map tasks first. Both lists
    come to the driver; their sizes are fixed.
    """
    words = words_of(docs).select(F.explode("words").alias("word"))
    words = words.select(F.lower("word").alias("word")).filter("length(word) < 16").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = written(words, "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    letter = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(0)
    steps = words.filter("length(word) > 1").select("n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1),
        lambda i: letter(F.substring("word", i, 1)) * 27 + letter(F.substring("word", i + 1, 1)))).alias("step"))
    counts = dict(steps.groupBy("step").agg(F.sum("n").alias("n")).collect())
    from_letter = [sum(counts.get(a * 27 + b, 0) for b in range(27)) for a in range(27)]
    logs = [math.log((counts.get(i, 0) + 0.5) / (from_letter[i // 27] + 13.5)) for i in range(27 * 27)]

    dictionary = words.filter(F.col("word").rlike("^[a-z]{3,}$") & (F.col("n") >= total * share))
    triples = dictionary.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, 3))).alias("triple")).distinct()
    known = {r[0] for r in triples.collect()}
    a = "abcdefghijklmnopqrstuvwxyz"
    return logs, [int(x + y + z in known) for x in a for y in a for z in a]


def featured(found: DataFrame, tables) -> DataFrame:
    """Candidates with their features."""
    logs, triples = (F.from_json(F.lit(json.dumps(t)), kind) for t, kind in zip(tables, ("array<double>", "array<tinyint>")))
    c, low = F.col("finding"), F.lower("finding")
    n = F.length(c)
    code = lambda i: F.ascii(F.substring(low, i, 1)) - 97
    is_letter = lambda x: x.between(0, 25)
    letter = lambda i: F.when(is_letter(code(i)), code(i) + 1).otherwise(0)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    mean_log = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda total, i: total + F.get(logs, (letter(i) * 27 + letter(i + 1)).cast("int"))) / (n - 1)
    covered = F.aggregate(F.sequence(F.lit(1), n - 2), F.lit(0), lambda total, i: total + F.when(
        is_letter(code(i)) & is_letter(code(i + 1)) & is_letter(code(i + 2)),
        F.get(triples, (code(i) * 676 + code(i + 1) * 26 + code(i + 2)).cast("int")).cast("int")).otherwise(0))
    around = F.regexp_replace("word", CANDIDATE, "")
    return found.withColumns({
        "chars": n, "digits": count("[0-9]"), "uppers": count("[A-Z]"), "lowers": count("[a-z]"), "signs": count("[+/=_-]"),
        "turns": count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), "case_turns": count("(?<=[a-z])[A-Z]"), "vowels": count("(?i)[aeiou]"),
        "letters_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)),
        "different": F.size(F.array_distinct(F.split(low, ""))), "transitions": mean_log, "coverage": covered / (n - 2),
        "slashes": F.regexp_count("word", F.lit("[/\\\\]")), "extension": F.col("word").rlike(r"\.[a-z]{1,4}\W*$").cast("int"),
        "has_scheme": F.col("word").contains("://").cast("int"),
        "assigned": (F.col("before").rlike("[=:]$") | F.col("word").rlike(r"^\w*[=:]")).cast("int"),
        "named": (F.col("before").rlike(NAMES) | F.col("before2").rlike(NAMES) | F.col("word").rlike(NAMES)).cast("int"),
        "quoted": F.col("word").rlike("[\"'`]").cast("int"), "word_rest": F.length(around),
        "next_plain": F.col("after").rlike(r"^\p{L}+[.,;]?$").cast("int"),
    })


def rule_labels(rows: DataFrame) -> DataFrame:
    """Clear findings as labels: is_secret 1 for a quoted value of mixed letters and digits that a name is assigned,
    0 for letters or digits alone with no name near; the others are unclear and left out."""
    mixed = (F.col("digits") > 0) & (F.col("uppers") + F.col("lowers") > 0)
    yes = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & mixed
    no = (F.col("named") == 0) & ~mixed
    return rows.withColumn("is_secret", F.when(yes, 1).when(no, 0)).filter("is_secret is not null")


def train(labelled: DataFrame, rows=TRAIN_ROWS, seed=SEED):
    """A forest from featured findings with ``is_secret``; held-out documents (see ``quality.fold``) are never learned from.

    At most ``rows`` findings of each label, those with the smallest hashes. None if a label is missing.
    """
    usable = labelled.filter(fold() != 1)
    by_hash = [F.xxhash64("doc_id", "word_no", "part", "finding", F.lit(seed)), "doc_id", "word_no", "part"]
    columns = ["is_secret", *FEATURES]
    # both parts are bounded
    sample = written(usable.filter("is_secret = 1").orderBy(*by_hash).limit(rows).select(*columns)
                     .unionByName(usable.filter("is_secret = 0").orderBy(*by_hash).limit(rows).select(*columns)), "secret-sample")
    if sample.select("is_secret").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="is_secret", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(_vectors(sample))


def _vectors(rows):
    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)


def secret_scan(docs: DataFrame, labels: DataFrame | None = None, share=WORD_SHARE) -> DataFrame:
    """One row per candidate: doc_id, held_out, word_no, part, finding, score (0 to 1), secret (score >= 0.5).

    ``labels`` are reviewed findings (doc_id, word_no, part, is_secret); without them ``rule_labels``
    gives the clear ones. Null texts are empty and have no candidates; repeated rows are all
    returned. If either label is missing, scores are 0.5 and every candidate is reported. An empty
    table gives no rows; other columns are not read.
    """
    rows = written(featured(candidates(docs), language_tables(docs, share)), "secret-candidates")
    if labels is None:
        labelled = rule_labels(rows)
    else:
        marks = labels.select("doc_id", "word_no", "part", "is_secret").dropna().dropDuplicates(["doc_id", "word_no", "part"])
        labelled = rows.join(marks, ["doc_id", "word_no", "part"])
    model = train(labelled)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(_vectors(rows)).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), F.col("word_no").cast("long").alias("word_no"),
                         F.col("part").cast("long").alias("part"), "finding", "score", (F.col("score") >= 0.5).alias("secret"))

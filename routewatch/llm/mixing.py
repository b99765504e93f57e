"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is domain, language, source. A token budget goes down it: at every node the children share
by weight, a child that cannot use its share (its tokens times the epochs allowed) gets what it can,
and the rest goes to its siblings by weight. As a node's capacity is the sum of its leaves', a
shortage leaves a family only when the whole family is full. Each leaf then takes full epochs of its
documents and a token-prefix of the next, in a seeded order of its own.

No leaf is sorted whole. Documents fall into buckets by the first digits of their order key; sums of
buckets say which are taken, and only within a bucket are documents in order. A leaf with a third of
all rows is spread over thousands of buckets.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import whole_text, written

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order key that name a bucket: 4096 buckets a leaf and epoch.
BUCKET_DIGITS = 3
#: Domains of the sources of ``documents``, and weights; what is not listed has weight 1.
DOMAINS = {"web": [f"src{i}" for i in range(0, 5)], "forum": [f"src{i}" for i in range(5, 10)],
           "books": [f"src{i}" for i in range(10, 15)], "reference": [f"src{i}" for i in range(15, 20)]}
WEIGHTS = {"domain": {"web": 4, "forum": 2, "books": 3, "reference": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
EPOCHS, SEED = 2, 11


def domain_of(source: Column, domains=DOMAINS) -> Column:
    out = F.lit("other")
    for name, sources in domains.items():
        out = F.when(source.isin(sources), name).otherwise(out)
    return out


def _weight(level, weights):
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def _exact(column, digits=20):
    return column.cast(f"decimal({digits},0)")


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``allotted`` to rows (parent columns, child, capacity, weight, budget of the parent).

    Whole tokens, rounded down. With children ordered by capacity per weight, one is full if giving
    it and all before it their capacity still leaves every later one as much per weight.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # a family has a row per child: languages of a domain, sources of a language
    ordered = family.orderBy((F.col("capacity") / F.col("weight")).asc_nulls_first(), child)
    rows = children.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
    rows = rows.withColumns({
        "before": F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)),
    })
    w = _exact(F.col("weight"), 10)
    full = (_exact(F.col("before")) * w + _exact(F.col("capacity")) * _exact(F.col("open"), 10) <= _exact(F.col("budget")) * w)
    rows = rows.withColumn("full", (F.col("weight") == 0) | full)
    rows = rows.withColumns({
        "left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family),
        "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family),
    })
    rows = rows.withColumn("part", _exact(F.col("left")) * w).withColumn(
        "allotted", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("part div cast(open as decimal(10,0))")).cast("long"))
    return rows.select(*parent, child, "capacity", "allotted")


def budgets(leaves: DataFrame, budget: int | None = None, weights=WEIGHTS, epochs=EPOCHS) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with their allotted tokens. Without a budget it is the tokens there are."""
    parent, above = [], None
    for depth, level in enumerate(LEVELS):
        path = LEVELS[:depth + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("capacity")).withColumn("weight", _weight(level, weights))
        if above is None:
            usable = F.sum("capacity").over(Window.partitionBy(F.lit(0)))  # a row per domain
            nodes = nodes.withColumn("budget", F.least(usable, F.lit(budget)) if budget is not None else (usable / epochs).cast("long"))
        else:
            nodes = nodes.join(above.withColumnRenamed("allotted", "budget").drop("capacity"), parent)
        parent, above = path, share(nodes, parent, level)
    return leaves.join(above.drop("capacity"), LEVELS)


def counted(docs: DataFrame, domains=DOMAINS) -> DataFrame:
    """doc_id, domain, lang, source, text_md5, n_tokens (words) of every different row; nulls of lang and source count as empty."""
    text = whole_text(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.coalesce("source", F.lit("")), domains).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.unhex(F.md5(text)).alias("text_md5"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
    ).distinct()


def mix(docs: DataFrame, budget=None, weights=WEIGHTS, domains=DOMAINS, epochs=EPOCHS, seed=SEED) -> DataFrame:
    """One row per document and epoch that is taken: doc_id, epoch, domain, lang, source, n_tokens, text_md5.

    ``budget`` in tokens (default: the tokens there are; more than ``epochs`` times those cannot be
    used). A leaf takes documents in seeded order while their running sum stays within its allotment.
    Null texts have no tokens; they are taken where the prefix reaches them. Null languages and
    sources are leaves of their own. Rows repeated with the same doc_id, language, source and text
    count once; equal order keys go by text. A weight of 0 takes nothing but documents without tokens.
    An empty table gives no rows.
    """
    rows = written(counted(docs, domains), "mix-rows")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    allotted = budgets(leaves, budget, weights, epochs).select(
        *LEVELS, F.expr("CASE WHEN tokens > 0 THEN allotted div tokens ELSE 1 END").alias("full_epochs"),
        F.expr("CASE WHEN tokens > 0 THEN allotted % tokens ELSE 0 END").alias("rest"))

    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    each = each.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    each = each.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))

    place = [*LEVELS, "epoch"]
    sums = each.groupBy(*place, "bucket").agg(F.sum("n_tokens").alias("tokens")).join(allotted, LEVELS)
    # at most 4096 rows in each of these windows
    until = F.sum("tokens").over(Window.partitionBy(*place).orderBy("bucket"))
    # a bucket of a full epoch is taken whole, one of the next as far as the rest goes
    room = F.when(F.col("epoch") < F.col("full_epochs"), F.col("tokens")).otherwise(F.col("rest") - (F.col("until") - F.col("tokens")))
    reached = sums.filter(F.col("epoch") <= F.col("full_epochs")).withColumn("until", until).withColumn("room", room).filter("room >= 0")
    taken = each.join(reached.select(*place, "bucket", "room"), [*place, "bucket"])
    running = F.sum("n_tokens").over(Window.partitionBy(*place, "bucket").orderBy("order_key", "text_md5").rowsBetween(Window.unboundedPreceding, 0))
    return taken.withColumn("running", running).filter("running <= room").select("doc_id", "epoch", *LEVELS, "n_tokens", "text_md5")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``mix`` takes them; of rows repeated in doc_id, lang, source and text one,
    that which reads least as JSON."""
    from .shared import one_of_each

    chosen = mix(docs, **options).groupBy("doc_id", "lang", "source", "text_md5").agg(F.count(F.lit(1)).cast("int").alias("times"))
    keys = {"doc_id": F.col("doc_id").cast("long"), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")),
            "text_md5": F.unhex(F.md5(whole_text(docs)))}
    found = one_of_each(docs, keys, chosen)
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__chosen_times"))).alias("__copy")).drop("__copy")

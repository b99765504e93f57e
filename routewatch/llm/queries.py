"""The operators as registered queries, each over its whole table, and the SQL that states a result where SQL can."""

from pyspark.sql import functions as F

import public_tokenizers

from .conversation_repair import damaged, repair
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import mix
from .phrase_mining import collocations
from .quality import fit, score
from .secret_scan import secret_scan
from .shared import table
from .simhash_dedup import near_groups
from .token_counts import prefix_counts
from .token_records import read_records, write_records
from .topk_search import top_k, vectors
from .warc import normalise, read_archives, write_monolithic

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op1_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_token_records(spark, sf_dir):
    return read_records(write_records(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)))


def op3_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))


def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark, sf_dir):
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("text_md5")


def op7_warc(spark, sf_dir):
    found = read_archives(normalise(write_monolithic(table(spark, sf_dir, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark, sf_dir):
    found = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_secret_scan(spark, sf_dir):
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "word_no", "part", F.length("finding").cast("long").alias("length"),
                        F.sha2("finding", 256).alias("finding_sha256"), "score", "secret")


def op10_simhash_dedup(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op11_topk_search(spark, sf_dir):
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("vec_id % 20 = 0"), 20)


def op12_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)


def op13_phrase_mining(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_line_dedup, op2_token_records, op3_quality, op4_decontamination, op5_exact_dedup, op6_mixing, op7_warc,
    op8_token_counts, op9_secret_scan, op10_simhash_dedup, op11_topk_search, op12_conversation_repair,
    op13_phrase_mining)}

#: Words and lines in DuckDB's SQL. String literals have no escapes there, so patterns read as they are.
_TEXT = "coalesce(text, '')"

_OP1 = r"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS content, md5(coalesce(text, '')) AS text_md5 FROM documents),
lines AS (
  SELECT doc_id, text_md5, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
  FROM docs),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, text_md5 ORDER BY line_no) AS following FROM lines),
ranked AS (
  SELECT *, following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, text_md5, line_no) > 1 AS later
  FROM pairs),
judged AS (
  SELECT *, later OR coalesce(lag(later) OVER (PARTITION BY doc_id, text_md5 ORDER BY line_no), false) AS gone FROM ranked),
edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, text_md5 ORDER BY line_no), false) AS starts FROM judged)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (starts) AS removed_chunks, count(*) FILTER (gone) AS removed_lines,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
FROM edged GROUP BY doc_id, text_md5
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size, doc_id = min(doc_id) OVER p AS kept, sha256(content) AS text_sha256
FROM d WINDOW p AS (PARTITION BY content)
"""


def _case(column, table, default):
    whens = " ".join(f"WHEN {column} = '{name}' THEN {value}" for name, value in table.items())
    return f"CASE {whens} ELSE {default} END" if whens else str(default)


def _shared_out(name, rows, parent, child):
    """CTEs that share out a budget among the children of each parent in whole tokens."""
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    key = ", ".join([*parent, child])
    return f"""
{name}_o AS (
  SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM {rows} WINDOW o AS ({by}ORDER BY capacity / weight, {child})),
{name}_f AS (SELECT *, before * weight + capacity * open <= budget * weight AS f FROM {name}_o),
{name} AS (
  SELECT {key}, CAST(CASE WHEN f THEN capacity
    ELSE (budget - coalesce(sum(capacity) FILTER (f) OVER p, 0)) * weight // sum(weight) FILTER (NOT f) OVER p END AS HUGEINT) AS budget
  FROM {name}_f WINDOW p AS ({by.strip()}))"""


def _op6():
    from .mixing import DOMAINS, EPOCHS, SEED, WEIGHTS

    domain = _case("coalesce(source, '')", {s: f"'{d}'" for d, sources in DOMAINS.items() for s in sources}, "'other'")
    levels = []
    for depth, level in enumerate(("domain", "lang", "source")):
        path = ["domain", "lang", "source"][:depth + 1]
        weight = _case(level, WEIGHTS[level], 1)
        of = "" if depth == 0 else f" JOIN share{depth} USING ({', '.join(path[:-1])})"
        budget = "CAST(sum(sum(tokens)) OVER () AS HUGEINT)" if depth == 0 else "any_value(budget)"
        levels.append(f"""
level{depth + 1} AS (
  SELECT {', '.join(path)}, CAST(sum(tokens) * {EPOCHS} AS HUGEINT) AS capacity, CAST({weight} AS HUGEINT) AS weight, {budget} AS budget
  FROM leaves{of} GROUP BY {', '.join(path)}),{_shared_out(f'share{depth + 1}', f'level{depth + 1}', path[:-1], level)}""")
    return rf"""
WITH d AS (
  SELECT DISTINCT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5({_TEXT}) AS text_md5,
    CAST(len(regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),{','.join(levels)},
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS full_epochs,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM leaves JOIN share3 USING (domain, lang, source)),
ordered AS (
  SELECT d.*, CAST(epoch AS INT) AS epoch, full_epochs, rest, sum(n_tokens) OVER (
    PARTITION BY domain, lang, source, epoch ORDER BY md5(concat('{SEED}:', epoch, ':', coalesce(CAST(doc_id AS VARCHAR), ''))), text_md5
    ROWS UNBOUNDED PRECEDING) AS running
  FROM d JOIN plan USING (domain, lang, source), (SELECT unnest(range({EPOCHS})) AS epoch))
SELECT doc_id, epoch, domain, lang, source, n_tokens FROM ordered WHERE epoch < full_epochs OR (epoch = full_epochs AND running <= rest)
"""


_OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_OP13 = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS p
    FROM documents)),
words AS (
  SELECT lang, piece, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w1
  FROM (SELECT lang, piece, regexp_extract_all(p, '[^ 	]+') AS ws FROM pieces)),
runs AS (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, concat_ws(' ', t.w1, t.w2) AS phrase, t.f AS a, a1.f AS l, b1.f AS r, 1 AS k
  FROM f2 AS t JOIN f1 AS a1 ON a1.lang = t.lang AND a1.w1 = t.w1 JOIN f1 AS b1 ON b1.lang = t.lang AND b1.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = t.lang AND f3.w1 = t.w1 AND f3.w2 = t.w2 AND 100 * f3.f >= 50 * t.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = t.lang AND f3.w2 = t.w1 AND f3.w3 = t.w2 AND 100 * f3.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, a1.f, b2.f, 1
  FROM f3 AS t JOIN f1 AS a1 ON a1.lang = t.lang AND a1.w1 = t.w1 JOIN f2 AS b2 ON b2.lang = t.lang AND b2.w1 = t.w2 AND b2.w2 = t.w3
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, a2.f, b1.f, 2
  FROM f3 AS t JOIN f2 AS a2 ON a2.lang = t.lang AND a2.w1 = t.w1 AND a2.w2 = t.w2 JOIN f1 AS b1 ON b1.lang = t.lang AND b1.w1 = t.w3),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang)
WHERE rank <= 2000
"""


ORACLES = {"op13_phrase_mining": _OP13, "op11_topk_search": _OP11, "op1_line_dedup": _OP1, "op5_exact_dedup": _OP5, "op6_mixing": _op6()}

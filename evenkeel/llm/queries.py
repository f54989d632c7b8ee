"""Queries of the text operators over the given tables, with their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import conversation, crf, kneser_ney, ledger, lsa, maxscore, minhash, ngram_scores, resync, sparse_suffix, transducer, weak_pii, winnow
from evenkeel.plans.registry import Tables, query


@query("op1_bpe_transducer")
def bpe_transducer(t: Tables) -> DataFrame:
    return transducer.digests(t.documents, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query("op6_ngram_jaccard_join")
def ngram_jaccard_join(t: Tables) -> DataFrame:
    return minhash.jaccard_join(t.documents).select("doc_id", "class_id", "n_links")


TOKEN_LIMIT = 512


@query("op8_token_counts")
def token_counts(t: Tables) -> DataFrame:
    counts = resync.token_counts(t.documents, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


LINE_DEDUP_SQL = r"""
WITH line AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), filled AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS c,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), three AS (
  SELECT doc_id, c, body, n, lead(body, 1) OVER w AS body2, lead(n, 1) OVER w AS n2, lead(body, 2) OVER w AS body3
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), run AS (
  SELECT doc_id, c, 3 AS lines, body || chr(10) || body2 || chr(10) || body3 AS run FROM three WHERE body3 IS NOT NULL
  UNION ALL SELECT doc_id, c, 2, body || chr(10) || body2 FROM three WHERE n + n2 >= 50
  UNION ALL SELECT doc_id, c, 1, body FROM three WHERE n >= 50
), later AS (
  SELECT doc_id, c, lines FROM run QUALIFY row_number() OVER (PARTITION BY lines, run ORDER BY doc_id, c) > 1
), gone AS (
  SELECT DISTINCT filled.doc_id, filled.pos FROM filled JOIN later ON filled.doc_id = later.doc_id AND filled.c BETWEEN later.c AND later.c + later.lines - 1
)
SELECT line.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
  md5(coalesce(string_agg(line.line, chr(10) ORDER BY line.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_md5
FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.pos = gone.pos
GROUP BY line.doc_id
"""


@query("op4_line_dedup", LINE_DEDUP_SQL)
def line_dedup(t: Tables) -> DataFrame:
    done = winnow.dedup_lines(t.documents)
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.md5("kept").alias("kept_md5"))


@query("op5_toxicity_crf")
def toxicity_crf(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    scored = crf.tag(docs, crf.train(docs, t.labels))
    return scored.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


@query("op2_benchmark_leaks")
def benchmark_leaks(t: Tables) -> DataFrame:
    found = lsa.find_leaks(t.documents, t.benchmark)
    return found.select("doc_id", "item_id", F.round("shared", 6).alias("shared"), F.col("start").cast("long").alias("start_word"))


QUALITY_RULES_SQL = r"""
WITH word AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), gram AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM word)
), twice AS (
  SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS t(k) GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_distinct(words)) AS n_unique_words, coalesce(covered.n, 0) AS n_repeat_words
  FROM word LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (5 * n_exclamations > n_words)::INT
    + 16 * (2 * n_capitals > word_chars)::INT + 32 * (2 * n_dup_lines > n_lines)::INT
    + 64 * (n_words > 0 AND NOT word_chars BETWEEN 3 * n_words AND 12 * n_words)::INT + 128 * (10 * n_unique_words < 3 * n_words)::INT AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed::INT AS failed FROM judged
"""


@query("op7_quality_rules", QUALITY_RULES_SQL)
def quality_rules(t: Tables) -> DataFrame:
    judged = ledger.apply_policy(ledger.ledger(t.documents))
    base_failed = F.col("failed").bitwiseAND(F.lit(ledger.BASE)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failed")


@query("op9_pii_weak_supervision")
def pii_weak_supervision(t: Tables) -> DataFrame:
    found = weak_pii.find_pii(t.documents)
    counts = [weak_pii.number_of("base", k).alias(f"n_{name}") for k, name in enumerate(weak_pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(weak_pii.listed("base"), 256).alias("base_sha256"), weak_pii.listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@query("op10_sparse_suffix_repeats")
def sparse_suffix_repeats(t: Tables) -> DataFrame:
    found = sparse_suffix.repeated_passages(t.documents)
    return found.select("doc_id", F.col("begin").cast("long").alias("begin_word"), F.col("end").cast("long").alias("end_word"), (F.col("end") - F.col("begin")).cast("long").alias("n_words"))


@query("op3_kneser_ney_quality")
def kneser_ney_quality(t: Tables) -> DataFrame:
    return kneser_ney.classify(t.documents, t.labels)


RANKED_SEARCH_SQL = r"""
WITH term AS (
  SELECT doc_id, nr, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, row_number() OVER () AS nr, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL)
), posting AS (
  SELECT nr, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM term GROUP BY nr, term
), length AS (
  SELECT nr, sum(tf)::BIGINT AS n FROM posting GROUP BY nr
), size AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM length
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posting, size GROUP BY term
), scored AS (
  SELECT item_id, nr, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN posting USING (term) JOIN length USING (nr), size GROUP BY item_id, nr
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query("op11_pair_maxscore", RANKED_SEARCH_SQL)
def pair_maxscore(t: Tables) -> DataFrame:
    return maxscore.search(maxscore.build_index(t.documents), t.benchmark)


@query("op13_conversation_repair")
def conversation_repair(t: Tables) -> DataFrame:
    return conversation.audit_report(t.conversations)


@query("op12_trie_scores")
def trie_scores(t: Tables) -> DataFrame:
    return ngram_scores.score(t.documents)

"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import align, decontam, fingerprints, htmlmain, linededup, merkle, mixing, ngramjoin, pii, records, tokencount, toxicity, urlfilter
from .common import LOWER, UPPER, bound_batches, table


def op1_fingerprints(spark, sf_dir):
    return fingerprints.compare_fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op4_pii(spark, sf_dir):
    return pii.detect_pii(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return linededup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_main_text(spark, sf_dir):
    bound_batches(spark)
    return htmlmain.extract_main(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark, sf_dir):
    return ngramjoin.near_duplicate_classes(table(spark, sf_dir, "documents"), n=3, threshold="0.9")


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op11_binary_output(spark, sf_dir):
    return records.token_records(table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    return merkle.merkle_proofs(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark, sf_dir):
    return align.cross_tokenizer(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, rest, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in urlfilter.HOST_RULES)}
), fits AS (
  SELECT p.page_id, p.rest, p.host, p.path, rules.rule, rules.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rules.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN verdict
            WHEN regexp_matches(lower(rest), '(^|[^a-z0-9])({"|".join(urlfilter.BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block'
            ELSE '{urlfilter.DEFAULT_VERDICT}' END AS verdict
FROM fits WHERE k = 1
"""

_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: The leaves, the levels of each tree, the siblings of each node, and the way up from each leaf.
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree, {_LEAF("text")} AS leaf, {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} AS folded,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc
  FROM documents
), lf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM d
), lv AS (
  SELECT tree, 0 AS level, place, leaf AS h, size FROM lf
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (size + 7) // 8 FROM lv WHERE size > 1 GROUP BY tree, level, place // 8, size
), tops AS (
  SELECT tree, h AS subroot FROM lv WHERE size = 1
), root AS (
  SELECT sha256(string_agg(subroot, '' ORDER BY tree)) AS root FROM tops
), near AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM lv a JOIN lv b ON a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.size > 1 GROUP BY ALL
), beside AS (
  SELECT a.tree, coalesce(string_agg(b.subroot, '' ORDER BY b.tree) FILTER (b.tree < a.tree), '') AS l, coalesce(string_agg(b.subroot, '' ORDER BY b.tree) FILTER (b.tree > a.tree), '') AS r
  FROM tops a, tops b GROUP BY a.tree
), up AS (
  SELECT lf.doc_id, lf.leaf, lf.tree, 0 AS level, lf.place, lf.leaf AS start, '' AS proof, CASE WHEN crc % 3 = 0 THEN folded ELSE leaf END AS acc FROM lf
  UNION ALL
  SELECT up.doc_id, up.leaf, up.tree, up.level + 1, up.place // 8, up.start, up.proof || l || r, sha256(l || acc || r) FROM up JOIN near USING (tree, level, place)
), ended AS (
  SELECT up.*, subroot FROM up JOIN tops USING (tree) WHERE level = (SELECT max(level) FROM lv WHERE lv.tree = up.tree)
)
SELECT doc_id, leaf, subroot, root, sha256(proof || l || r) AS proof_sha256, sha256(l || acc || r) AS folded_root, sha256(l || acc || r) = root AS verified
FROM ended JOIN beside USING (tree), root
"""

QUERIES = {
    "op1_fingerprints": op1_fingerprints, "op2_mixing": op2_mixing, "op3_url_filter": op3_url_filter, "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup, "op6_decontamination": op6_decontamination, "op7_html_main_text": op7_html_main_text,
    "op8_ngram_jaccard": op8_ngram_jaccard, "op9_toxicity": op9_toxicity, "op10_token_counts": op10_token_counts, "op11_binary_output": op11_binary_output,
    "op12_merkle": op12_merkle, "op13_tokenizer_alignment": op13_tokenizer_alignment, "pipeline": pipeline,
}
ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op12_merkle": OP12_SQL}

"""DuckDB SQL of the operator queries that SQL can express."""
from __future__ import annotations

from ledgerlens.llm.mixing import Mix
from ledgerlens.llm.quality_rules import CLASS_RUNS, Rules
from ledgerlens.llm.sharding import LIMIT


def _kept_chars(runs: str) -> str:
    runs = runs.replace("'", "''")
    return f"length(regexp_replace(t, '{runs}', '', 'g'))"


def _js(p: str, q: str) -> str:
    def half(x, y):
        return (f"CASE WHEN z[{x}] > 0 THEN z[{x}] * log2(z[{x}] / ((z[1] + z[2]) / 2)) ELSE 0 END")
    return (f"round(list_sum(list_transform(list_zip({p}, {q}), lambda z: {half(1, 2)} + {half(2, 1)})) / 2, 9)")


def quality_rules(source: str = "documents", r: Rules = Rules()) -> str:
    """All of op4: base counts, references by language, divergences, verdicts."""
    runs = [_kept_chars(x) for x in CLASS_RUNS.values()]
    n = len(CLASS_RUNS) + 1
    sums = ", ".join(f"sum(c[{i + 1}])" for i in range(n))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
s AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  {_kept_chars("[^#*$%&|<>]+")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  [{', '.join(runs)}] AS cc FROM w),
s2 AS (SELECT *, list_concat([word_chars - list_sum(cc)], cc) AS c FROM s),
win AS (SELECT rid, i, w[i:i + 4] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_rep FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
big AS (SELECT * FROM s2 WHERE n_words >= {r.min_words}),
rc AS (SELECT lang, list_transform(l, lambda x: x / list_sum(l)) AS ref_c FROM (SELECT lang, [{sums}] AS l FROM s2
  WHERE word_chars >= {r.min_chars} GROUP BY lang)),
tot AS (SELECT lang, sum(len(w)) AS ref_n, sum(len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{L}}')))) AS ref_marks FROM big GROUP BY lang),
cnt AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM big)
  WHERE regexp_matches(word, '^\\p{{L}}+$') GROUP BY lang, word),
top AS (SELECT lang, list(word ORDER BY k) AS ref_words, list(n ORDER BY k) AS ns FROM (SELECT *,
  row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM cnt) WHERE k <= {r.n_common} GROUP BY lang),
ref AS (SELECT tot.lang, ref_n, ref_words, ref_c, list_concat(list_transform(ns, lambda x: x / ref_n), [ref_marks / ref_n]) AS p FROM tot, top, rc
  WHERE tot.lang IS NOT DISTINCT FROM top.lang AND tot.lang IS NOT DISTINCT FROM rc.lang AND ref_n >= {r.min_reference_words}),
j AS (SELECT s2.*, ref_n, ref_c, ref_words, list_concat(p, [1.0 - list_sum(p)]) AS ref_p,
  CASE WHEN n_words >= {r.min_words} AND word_chars >= {r.min_chars} AND ref_n IS NOT NULL
    THEN list_concat(list_transform(ref_words, lambda k: len(list_filter(w, lambda x: x = k)) / len(w)),
      [len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) / len(w)]) END AS h
  FROM s2 LEFT JOIN ref ON s2.lang IS NOT DISTINCT FROM ref.lang),
v AS (SELECT *, CASE WHEN h IS NOT NULL THEN {_js(f"list_transform(c, lambda x: x / word_chars)", "ref_c")} END AS class_js,
  CASE WHEN h IS NOT NULL THEN {_js("list_concat(h, [1.0 - list_sum(h)])", "ref_p")} END AS word_js FROM j),
o AS (SELECT v.*, coalesce(n_rep, 0) AS n_repeat_words FROM v LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {r.min_n_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, class_js, word_js, base_failed,
  NOT base_failed AND NOT coalesce(class_js > {r.max_class_js} OR word_js > {r.max_word_js}, FALSE) AS kept FROM b"""


def mixing(source: str = "documents", m: Mix = Mix(), sweeps: int = 25) -> str:
    """All of op1: topics, cells, tempered targets, ``sweeps`` raking sweeps, draws."""
    keys = ["source", "lang", "topic"]
    steps, was = [], "c0"
    steps.append("c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens, "
                 "CAST(sum(n) AS DOUBLE) AS w FROM t WHERE n > 0 GROUP BY ALL)")
    for k in keys:
        steps.append(f"g_{k} AS MATERIALIZED (SELECT {k} AS l, s / sum(s) OVER () AS share FROM "
                     f"(SELECT {k}, pow(sum(tokens), {m.temper}) AS s FROM c0 GROUP BY {k}))")
    for i in range(sweeps):
        for k in keys:
            now = f"c{i}_{k}"
            steps.append(f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * share / "
                         f"sum(w) OVER (PARTITION BY {k}) AS w FROM {was} JOIN g_{k} ON {k} IS NOT DISTINCT FROM l)")
            was = now
    same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM {source}),
n AS (SELECT *, len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n,
  length(t) - length(replace(t, chr(10), '')) + 1 AS lines,
  length(regexp_replace(t, '[^#*$%&|<>=+@/\\\\^_~{{}}\\[\\]`]+', '', 'g')) AS marks FROM d),
t AS (SELECT doc_id, source, lang, n, CASE WHEN marks * 20 > n THEN 'markup' WHEN n < 6 * lines THEN 'list'
  WHEN n < 200 THEN 'note' ELSE 'prose' END AS topic FROM n),
{", ".join(steps)},
r AS (SELECT source, lang, topic, w / tokens AS r FROM {was}),
p AS (SELECT source, lang, topic, r / (SELECT max(r) FROM r) * {m.rate} AS p FROM r)
SELECT doc_id, t.source, t.lang, t.topic, CAST(n AS BIGINT) AS n_tokens, round(coalesce(p, 0), 6) AS probability,
  CAST('0x' || substr(md5('{m.seed}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(p, 0) AS sampled
FROM t LEFT JOIN p ON {same}"""


def sharding(source: str = "documents", limit: int = LIMIT, deepest: int = 24) -> str:
    """op9 where no id repeats and no bucket is deeper than ``deepest``: the shortest prefix whose
    rows fit the limit, or the row alone."""
    return f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) AS BIGINT) AS h FROM {source}),
e AS (SELECT *, h >> (44 - depth) AS bucket FROM d, (SELECT unnest(range(0, {deepest + 1})) AS depth)),
f AS (SELECT depth, bucket, sum(bytes) AS total FROM e GROUP BY ALL HAVING total <= {limit}),
g AS (SELECT doc_id, min(e.depth) AS depth FROM e JOIN f USING (depth, bucket) GROUP BY doc_id)
SELECT doc_id, CASE depth WHEN 0 THEN '' ELSE lpad(bin(h >> (44 - depth)), CAST(depth AS INTEGER), '0') END AS shard,
  CAST(depth AS INTEGER) AS depth, CAST(bytes AS BIGINT) AS bytes, FALSE AS oversized FROM d JOIN g USING (doc_id)"""


def hard_negatives(source: str = "embeddings") -> str:
    """op11 where all vectors are of one length."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM {source}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10"""


ORACLE = {"op1_mixing": mixing(), "op9_sharding": sharding(), "op11_hard_negatives": hard_negatives(),
          "op4_quality_rules": quality_rules()}

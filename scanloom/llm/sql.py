"""SQL twins of the corpus queries, written from their definitions."""

from __future__ import annotations

from scanloom.llm import centroids as ct
from scanloom.llm import resampling as rs
from scanloom.llm import rules
from scanloom.llm import statistics as st

CHAT = """
WITH rows AS (
  SELECT conv_id, turn, role, COALESCE(role, '') AS who, COALESCE(text, '') AS said,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS position
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, who AS speaker FROM rows WHERE who <> 'system'
), shown AS (
  SELECT r.conv_id, s.speaker, r.position,
         CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN who = 'system' OR who = speaker THEN NULL ELSE who END AS name, said
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), headed AS (
  SELECT *, '<|im_start|>' || role || COALESCE(' name=' || name, '') || chr(10) AS head FROM shown
), summed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS rendered,
         SUM(LENGTH(head || said || '<|im_end|>' || chr(10))) OVER (PARTITION BY conv_id, speaker ORDER BY position) AS stop
  FROM headed
)
SELECT conv_id, speaker, CAST(position AS BIGINT) AS position, role, name, rendered,
       CAST(stop - LENGTH(rendered) + LENGTH(head) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, role = 'assistant' AS trained
FROM summed
"""

LINES = r"""
WITH docs AS (
  SELECT doc_id, text, ROW_NUMBER() OVER () AS n FROM documents
), split AS (
  SELECT doc_id, n, string_split(text, chr(10)) AS lines FROM docs WHERE text IS NOT NULL
), wins AS (
  SELECT doc_id, n, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS win
  FROM (SELECT doc_id, n, lines, UNNEST(range(len(lines) - 2)) AS i FROM split WHERE len(lines) >= 3)
), real AS (
  SELECT * FROM wins WHERE regexp_matches(win, '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT win, MIN(ROW(doc_id, i)) AS first FROM real GROUP BY win HAVING COUNT(*) > 1
), gone AS (
  SELECT DISTINCT n, i + k AS line FROM real JOIN firsts USING (win), (SELECT UNNEST(range(3)) AS k)
  WHERE ROW(doc_id, i) <> first
), counts AS (
  SELECT n, COUNT(*) AS n_removed, COUNT(*) FILTER (WHERE line <> COALESCE(before, -9) + 1) AS n_spans, LIST(line) AS covered
  FROM (SELECT n, line, LAG(line) OVER (PARTITION BY n ORDER BY line) AS before FROM gone) GROUP BY n
), left_ AS (
  SELECT n, STRING_AGG(line, chr(10) ORDER BY i) AS text
  FROM (SELECT s.n, UNNEST(lines) AS line, UNNEST(range(len(lines))) AS i FROM split s) l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.n = l.n AND g.line = l.i) GROUP BY n
)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE COALESCE(l.text, '') END AS text,
       CAST(COALESCE(len(s.lines), 0) AS BIGINT) AS n_lines,
       CAST(COALESCE(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(c.n_spans, 0) AS BIGINT) AS n_spans
FROM docs d LEFT JOIN split s USING (n) LEFT JOIN counts c USING (n) LEFT JOIN left_ l USING (n)
"""

_CLASSES = ", ".join(f"LENGTH(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c{i}" for i, p in enumerate(st.CLASSES.values()))
_N = len(st.CLASSES)
_KNOWN = " + ".join(f"c{i}" for i in range(_N))

_LIMITS = " ".join(f"WHEN n_words >= {n} THEN CASE kind WHEN 'class' THEN {c} ELSE {w} END" for n, c, w in rules.GUARDS)

RULES = rf"""
WITH docs AS (
  SELECT ROW_NUMBER() OVER () AS n, doc_id, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs
), words AS (
  SELECT n, lang, UNNEST(words) AS w, UNNEST(range(len(words))) AS i FROM split
), eights AS (
  SELECT n, i, LIST(w) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM words
), twice AS (
  SELECT n, i FROM (SELECT n, i, COUNT(*) OVER (PARTITION BY n, win) AS c FROM eights WHERE len(win) = 8) WHERE c > 1
), repeated AS (
  SELECT n, SUM(LEAST(8, COALESCE(next - i, 8))) AS n_repeat_words
  FROM (SELECT n, i, LEAD(i) OVER (PARTITION BY n ORDER BY i) AS next FROM twice) GROUP BY n
), lines AS (
  SELECT n, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
  FROM (SELECT n, UNNEST(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n
), measured AS (
  SELECT n, doc_id, lang, len(words) AS n_words, COALESCE(list_sum(list_transform(words, lambda w: LENGTH(w))), 0) AS word_chars,
         LENGTH(text) AS chars, {_CLASSES}
  FROM split
), classed AS (
  SELECT *, chars - word_chars AS c{_N}, GREATEST(0, chars - ({_KNOWN} + chars - word_chars)) AS c{_N + 1} FROM measured
), short AS (
  SELECT n, lang, LOWER(w) AS word FROM words WHERE regexp_full_match(LOWER(w), '\p{{L}}{{1,{rules.SHORT}}}')
), chosen AS (
  SELECT lang, SUM(n_words) AS n_words, {", ".join(f"SUM(c{i}) AS c{i}" for i in range(_N + 2))}
  FROM classed WHERE lang <> '' GROUP BY lang HAVING SUM(classed.n_words) >= {rules.REFERENCE_WORDS}
  UNION ALL
  SELECT '', SUM(n_words), {", ".join(f"SUM(c{i})" for i in range(_N + 2))} FROM classed
), counted AS (
  SELECT lang, word, COUNT(*) AS k FROM short WHERE lang <> '' GROUP BY lang, word
  UNION ALL SELECT '', word, COUNT(*) FROM short GROUP BY word
), common AS (
  SELECT lang, word, k / n_words AS share
  FROM counted JOIN chosen USING (lang)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY k DESC, word) <= {rules.COMMON}
), refs AS (
  SELECT n, n_words, lang FROM classed WHERE lang IN (SELECT lang FROM chosen)
), class_terms AS (
  SELECT n, i, p / NULLIF(SUM(p) OVER (PARTITION BY n), 0) AS p, q / NULLIF(SUM(q) OVER (PARTITION BY n), 0) AS q
  FROM (SELECT d.n, UNNEST(range({_N + 2})) AS i, UNNEST([{", ".join(f"d.c{i}" for i in range(_N + 2))}]) AS p,
               UNNEST([{", ".join(f"c.c{i}" for i in range(_N + 2))}]) AS q
        FROM classed d JOIN refs USING (n) JOIN chosen c ON c.lang = refs.lang)
), used AS (
  SELECT s.n, s.word, COUNT(*) AS k FROM short s JOIN refs USING (n) JOIN common c ON c.lang = refs.lang AND c.word = s.word GROUP BY s.n, s.word
), word_terms AS (
  SELECT r.n, c.word, COALESCE(u.k, 0) / NULLIF(r.n_words, 0) AS p, c.share AS q
  FROM refs r JOIN common c ON c.lang = r.lang LEFT JOIN used u ON u.n = r.n AND u.word = c.word
  UNION ALL
  SELECT r.n, NULL, (r.n_words - COALESCE(u.k, 0)) / NULLIF(r.n_words, 0), GREATEST(0, 1 - COALESCE(c.share, 0))
  FROM refs r LEFT JOIN (SELECT n, SUM(k) AS k FROM used GROUP BY n) u USING (n)
  LEFT JOIN (SELECT lang, SUM(share) AS share FROM common GROUP BY lang) c ON c.lang = r.lang
), distances AS (
  SELECT n, kind, SQRT(GREATEST(0, SUM((CASE WHEN p > 0 THEN p * LOG2(2 * p / (p + q)) ELSE 0 END
                                     + CASE WHEN q > 0 THEN q * LOG2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d
  FROM (SELECT n, 'class' AS kind, p, q FROM class_terms UNION ALL SELECT n, 'word', p, q FROM word_terms) GROUP BY n, kind
), far AS (
  SELECT n, BOOL_OR(d > CASE {_LIMITS} END) AS far
  FROM distances JOIN classed USING (n) GROUP BY n
), judged AS (
  SELECT m.*, LENGTH(regexp_replace(d.text, '{st.SYMBOLS}', '', 'g')) AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines,
         COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(far, FALSE) AS far
  FROM classed m JOIN docs d USING (n) LEFT JOIN lines USING (n) LEFT JOIN repeated USING (n) LEFT JOIN far USING (n)
), failed AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEATED_PERCENT} * n_words AS base_failed FROM judged
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT far AS kept
FROM failed
"""

RESAMPLING = rf"""
WITH crc_table AS (
  SELECT LIST(list_reduce(list_prepend(i, range(8)), lambda acc, x: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), texts AS (
  SELECT 's' AS side, ROW_NUMBER() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 't', ROW_NUMBER() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT side, n, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), used AS (
  SELECT side, n, word, COUNT(*) AS k FROM (SELECT side, n, UNNEST(words) AS word FROM split) GROUP BY side, n, word
), spelled AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM used)
), bytes AS (
  SELECT word, list_transform(range(LENGTH(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM spelled
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) % {rs.BUCKETS} AS bucket
  FROM bytes, crc_table
), totals AS (
  SELECT bucket, COALESCE(SUM(k) FILTER (WHERE side = 's'), 0) AS s, COALESCE(SUM(k) FILTER (WHERE side = 't'), 0) AS t
  FROM used JOIN hashed USING (word) GROUP BY bucket
), sides AS (
  SELECT SUM(s) AS s_all, SUM(t) AS t_all FROM totals
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + {rs.BUCKETS}) AS DOUBLE) / CAST((s + 1) * (t_all + {rs.BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM totals, sides
), weights AS (
  SELECT n, CAST(floor(CAST(SUM(k * gain) AS DOUBLE) / SUM(k)) AS BIGINT) AS weight
  FROM used JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY n
), scored AS (
  SELECT doc_id, len(words) AS n_features, COALESCE(weight, 0) AS weight,
         CAST('0x' || substr(sha256('{rs.SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM split LEFT JOIN weights USING (n) WHERE side = 's'
), summed AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= {rs.LEAST_WORDS} AS able FROM scored
), placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place,
         SUM(CASE WHEN able THEN 1 ELSE 0 END) OVER () * {rs.PERCENT} // 100 AS draw
  FROM summed
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN able AND place <= draw THEN place END AS BIGINT) AS rank FROM placed
"""


def _round(k: int) -> str:
    """The assignment to the centroids c{k}, and the centroids after it."""
    return f"""
), a{k} AS MATERIALIZED (
  SELECT n, vec_id, v, list_min(list_transform(range(len(cs)), lambda i: {{'d': list_sum(list_transform(list_zip(v, cs[i + 1]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'i': i}})) AS best
  FROM whole, (SELECT LIST(c ORDER BY k) AS cs FROM c{k})
), s{k} AS (
  SELECT k, LIST(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c
  FROM (SELECT best.i AS k, pos, SUM(x) AS s, COUNT(*) AS n FROM (SELECT best, UNNEST(v) AS x, UNNEST(range(len(v))) AS pos FROM a{k}) GROUP BY best.i, pos)
  GROUP BY k
), c{k + 1} AS MATERIALIZED (
  SELECT o.k, COALESCE(s.c, o.c) AS c FROM c{k} o LEFT JOIN s{k} s USING (k)"""


CENTROIDS = f"""
WITH whole AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({ct.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {ct.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {ct.DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER (ORDER BY sha256('{ct.SEED}:' || COALESCE(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c
  FROM whole QUALIFY k < {ct.CLUSTERS}{"".join(map(_round, range(ct.ROUNDS + 1)))}
), sums AS (
  SELECT best.i AS k, SUM(best.d) AS cluster_inertia FROM a{ct.ROUNDS} GROUP BY best.i
)
SELECT vec_id, CAST(best.i AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT SUM(cluster_inertia) FROM sums) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ct.ROUNDS} JOIN c{ct.ROUNDS} o ON o.k = best.i JOIN sums ON sums.k = best.i
"""

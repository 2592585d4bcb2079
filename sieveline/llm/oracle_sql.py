"""SQL of op4_simhash, op10_mix, op11_jaccard and op13_trie, which DuckDB runs: all by their definitions, over whole tables."""

from __future__ import annotations

import xxhash

from .hash_sql import crc32, hashed_number, hashed_texts
from .mixing import BLOCK_WORDS, CAP, MIN_PIECES, PIECE_ROWS, SEED, SHARDS, WEIGHTS
from .simhash import MAX_BITS, SHINGLE_WORDS
from .simhash import SEED as HASH_SEED

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_BIT_SUMS = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {2**b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
_NEXT = ", ".join(f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY pos)" for k in range(1, SHINGLE_WORDS))

SIMHASH = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
shingles AS (
  SELECT doc_id, g FROM (SELECT doc_id, total, pos, concat_ws(' ', word, {_NEXT}) AS g FROM words)
  WHERE pos + {SHINGLE_WORDS - 1} <= total OR (total < {SHINGLE_WORDS} AND pos = 1)),
{hashed_texts("hashes", "SELECT DISTINCT g FROM shingles", HASH_SEED)},
voted AS (SELECT doc_id, {_BIT_SUMS} AS fp FROM shingles JOIN hashes USING (g) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce(CAST(voted.fp AS UBIGINT), 0::UBIGINT) AS fp FROM documents LEFT JOIN voted USING (doc_id)),
nodes AS (SELECT fp, min(doc_id) AS own FROM prints GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= {MAX_BITS}),
reach AS (SELECT fp, fp AS other FROM nodes UNION SELECT fp, b FROM reach JOIN links ON a = other),
components AS (SELECT reach.fp, min(own) AS component_id FROM reach JOIN nodes ON nodes.fp = other GROUP BY reach.fp)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM prints JOIN components USING (fp)"""


# Seats are given one by one by quotient: goals are whole numbers of 2 * `open` parts, so ties are exact.
_ROW_SEED = xxhash.xxh64_intdigest(SEED.to_bytes(4, "little"), 42)
_WEIGHT = "CASE (row_number() OVER (ORDER BY none, name) - 1) % " + str(len(WEIGHTS)) + "".join(f" WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS)) + " END"
MIX = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS none, coalesce(CAST(source AS VARCHAR), '') AS name, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS crc FROM documents),
{hashed_number("by_id", "sized", "doc_id, none, name, size, crc", "doc_id", str(_ROW_SEED))},
{hashed_number("by_text", "by_id", "doc_id, none, name, size", "crc", "h")},
per AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS words, count(*) AS n_rows FROM sized GROUP BY none, name),
-- targets: sources in the order in which they meet their limits as the level rises
weighed AS (SELECT *, CAST({_WEIGHT} AS BIGINT) AS w, row_number() OVER (ORDER BY none, name) AS nth, sum(words) OVER () AS total FROM per),
levels AS (SELECT *, 3 * total - 2 * {CAP} * (sum(words) OVER o - words) AS rest, sum(w) OVER () - (sum(w) OVER o - w) AS open FROM weighed WINDOW o AS (ORDER BY CAST(words AS DOUBLE) / w, nth ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min(rest, CAST(words AS DOUBLE) / w) AS rest, arg_min(open, CAST(words AS DOUBLE) / w) AS open FROM levels WHERE rest * w <= 2 * {CAP} * words * open),
goals AS (SELECT none, name, nth, words, total, n_rows, CAST(least(level.rest * w, 2 * {CAP} * words * level.open) AS BIGINT) AS goal, CAST(2 * level.open AS BIGINT) AS unit FROM levels, level),
seats AS (
  SELECT nth, row_number() OVER (ORDER BY CAST(goal AS DOUBLE) / (2 * t + 1) DESC, nth, t) AS seat, CAST((3 * total + {BLOCK_WORDS}) // {2 * BLOCK_WORDS} AS BIGINT) AS seats
  FROM (SELECT nth, goal, total, unnest(range(0, ({CAP} * words + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS t FROM goals WHERE goal > 0)),
shards AS (SELECT nth, none, name, words, unnest(range(0, {SHARDS})) AS k, (words + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks FROM goals),
edged AS (SELECT *, blocks * k // {SHARDS} AS first_block, blocks * (k + 1) // {SHARDS} AS end_block FROM shards),
asked AS (SELECT e.*, {CAP} * (end_block - first_block) AS room, (SELECT count(*) FROM seats s WHERE s.nth = e.nth AND seat > seats * k // {SHARDS} AND seat <= seats * (k + 1) // {SHARDS}) AS quota FROM edged e),
-- what is above a shard's room goes on to later ones, and what is left after the last to earlier ones
walked AS (SELECT *, sum(quota - room) OVER (PARTITION BY nth ORDER BY k) AS sum_over FROM asked),
carried AS (SELECT *, sum_over - least(0, min(sum_over) OVER (PARTITION BY nth ORDER BY k)) AS over FROM walked),
passed AS (SELECT *, quota + lag(over, 1, 0) OVER (PARTITION BY nth ORDER BY k) - over AS given, last_value(over) OVER (PARTITION BY nth ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS left_over FROM carried),
returned AS (SELECT *, given + greatest(0, least(room - given, left_over - coalesce(sum(room - given) OVER (PARTITION BY nth ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))) AS blocks_taken FROM passed),
{hashed_texts("starts", "SELECT DISTINCT k || CASE WHEN none THEN '|True|' ELSE '|False|' END || name AS g FROM shards", SEED)},
ranges AS (
  SELECT nth, first_block * {BLOCK_WORDS} AS p_lo, least(words, end_block * {BLOCK_WORDS}) AS p_hi, least(blocks_taken * {BLOCK_WORDS}, {CAP} * (p_hi - p_lo)) AS taken_words,
    first_block * {BLOCK_WORDS} + CAST(h % CAST(end_block - first_block AS UBIGINT) AS BIGINT) * {BLOCK_WORDS} AS p_first
  FROM returned JOIN starts ON g = k || CASE WHEN none THEN '|True|' ELSE '|False|' END || name WHERE end_block > first_block),
parts AS (SELECT nth, p_lo, p_hi, p_first, CAST(taken_words // (p_hi - p_lo) AS BIGINT) AS rounds, CAST(taken_words % (p_hi - p_lo) AS BIGINT) AS more FROM ranges),
placed AS (
  SELECT doc_id, size, nth, words, goal, unit, sum(size) OVER (PARTITION BY nth ORDER BY piece, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS d_hi
  FROM (SELECT doc_id, size, nth, words, goal, unit, CAST(h AS HUGEINT) - CASE WHEN h >= {2**63} THEN {2**64} ELSE 0 END AS h, (h >> 20) % CAST(greatest({MIN_PIECES}, (max(n_rows) OVER () + {PIECE_ROWS - 1}) // {PIECE_ROWS}) AS UBIGINT) AS piece FROM by_text JOIN goals USING (none, name))),
met AS (
  SELECT doc_id, d_hi, rounds, p_lo, p_hi, p_first, more, greatest(d_hi - size, p_lo) AS lo, least(d_hi, p_hi) AS hi FROM placed JOIN parts USING (nth) WHERE d_hi - size < p_hi AND d_hi > p_lo AND size > 0),
got AS (
  SELECT doc_id, d_hi, sum(rounds * (hi - lo) + greatest(0, least(hi, p_first + more) - greatest(lo, p_first)) + greatest(0, least(hi, p_first + more - (p_hi - p_lo)) - greatest(lo, p_first - (p_hi - p_lo)))) AS taken FROM met GROUP BY doc_id, d_hi)
SELECT doc_id, size, words AS source_size, CAST(goal AS DOUBLE) / unit AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN (SELECT doc_id, sum(taken) AS taken FROM got GROUP BY doc_id) USING (doc_id)"""


# Nodes are told by the digests of their turns; what lies below a node is found from the beginnings of each node's smallest member.
TRIE = f"""
WITH turns AS (
  SELECT conv_id, n, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, k) AS pos
  FROM (SELECT conv_id, turn, r, CAST(strlen(t) AS BIGINT) AS n, md5(strlen(r) || ':' || r || t) AS k
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))),
convs AS (SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS own, pos, k, n FROM convs c JOIN turns t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, k, n FROM convs JOIN turns USING (conv_id) WHERE pos > h),
whole AS (SELECT conv_id, coalesce(list(k ORDER BY own, pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(n ORDER BY own, pos) FILTER (k IS NOT NULL), []) AS ns FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
begun AS (SELECT conv_id, d, d = len(ks) AS ended, array_to_string(ks[1:d], ',') AS p, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS last FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, p, any_value(up) AS up, min(conv_id) AS low, count(*) AS n, (count(*) - 1) * any_value(last) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
  FROM begun GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.p, count(*) FILTER (kids.k IS NULL) AS leaves, CAST(sum(nodes.saved) AS BIGINT) AS saved
  FROM nodes LEFT JOIN kids USING (d, p) JOIN begun a ON a.conv_id = nodes.low AND a.d <= nodes.d GROUP BY a.d, a.p)
SELECT nodes.low AS conv_id, nodes.d AS depth, above.low AS parent_conv_id, nodes.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, below.saved AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes LEFT JOIN kids USING (d, p) JOIN below USING (d, p) LEFT JOIN nodes above ON above.d = nodes.d - 1 AND above.p = nodes.up"""


_SHINGLE = 5
_AFTER = ", ".join(f"lead(word, {k}) OVER (PARTITION BY nth ORDER BY pos)" for k in range(1, _SHINGLE))
# Rows are told by their place, as ids can repeat or be null; equal sets are compared once.
JACCARD = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, row_number() OVER () AS nth, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
words AS (SELECT nth, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
shingles AS (
  SELECT DISTINCT nth, g FROM (SELECT nth, total, pos, concat_ws(' ', word, {_AFTER}) AS g FROM words)
  WHERE pos + {_SHINGLE - 1} <= total OR (total < {_SHINGLE} AND pos = 1)),
sets AS (SELECT nth, list(g ORDER BY g) AS own FROM shingles GROUP BY nth),
classes AS (SELECT min(nth) AS class, min(doc_id) AS low, own, len(own) AS n FROM sets JOIN texts USING (nth) GROUP BY own),
elements AS (SELECT class, n, unnest(own) AS g FROM classes),
links AS (
  SELECT a.class AS a, b.class AS b FROM elements a JOIN elements b ON a.g = b.g AND a.class <> b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT class, class AS other FROM classes UNION SELECT class, b FROM reach JOIN links ON a = other),
roots AS (SELECT reach.class, min(low) AS component_id FROM reach JOIN classes ON classes.class = other GROUP BY reach.class)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN own IS NULL THEN doc_id ELSE component_id END AS component_id
FROM texts LEFT JOIN sets USING (nth) LEFT JOIN classes USING (own) LEFT JOIN roots USING (class)"""

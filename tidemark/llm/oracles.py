"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

from . import collocations, line_frequency, line_templates, mixing, suffix_automaton

#: A row's words, and its text with a null read as the empty text.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _mixed() -> str:
    """Operator 2. The order of a shard is that of md5, so its quotas and takes follow from sizes alone."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    key = rf"md5(concat_ws(chr(31), '{mixing.SEED}', coalesce('=' || doc_id::VARCHAR, '-'), coalesce('=' || text, '-')))"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, {key} AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
v AS (SELECT *, ([{weights}])[((rank - 1) % {len(mixing.WEIGHTS)}) + 1] AS weight, {mixing.REPEATS} * source_size AS most FROM w),
total AS (SELECT {mixing.SHARE} * sum(source_size) AS goal FROM v),
shared(step, rank, weight, most, stopped, rate) AS (
  SELECT 0, rank, weight, most, false, (SELECT goal FROM total)::DOUBLE / sum(weight) OVER () FROM v
  UNION ALL
  SELECT step + 1, rank, weight, most, stopped OR weight * rate >= most,
    ((SELECT goal FROM total) - coalesce(sum(CASE WHEN stopped OR weight * rate >= most THEN most END) OVER (), 0))::DOUBLE
      / nullif(sum(CASE WHEN stopped OR weight * rate >= most THEN 0 ELSE weight END) OVER (), 0)
  FROM shared WHERE step < 60 AND rate IS NOT NULL),
t AS (SELECT rank, CASE WHEN stopped OR rate IS NULL THEN most::DOUBLE ELSE least(most, weight * rate) END AS target
      FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY step DESC) AS last FROM shared) WHERE last = 1),
g AS (SELECT v.*, t.target, floor(sum(t.target) OVER () / {mixing.BLOCK} + 0.5)::BIGINT AS seats, sum(t.target) OVER () AS votes,
      greatest(1, ceil((source_size + 8 * n) / {mixing.SHARD}))::BIGINT AS shards FROM v JOIN t USING (rank)),
q AS (SELECT rank, k, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) AS place, seats
      FROM (SELECT rank, target, seats, unnest(generate_series(1, (seats * target / nullif(votes, 0))::BIGINT + (SELECT count(*) FROM g) + 1)) AS k FROM g)),
b AS (SELECT rank, count(*) AS blocks FROM q WHERE place <= seats GROUP BY rank),
p AS (SELECT d.*, g.rank, source_size, target, shards, coalesce(blocks, 0) AS blocks, (('0x' || substr(key, 1, 8))::BIGINT % shards) AS shard
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON b.rank = g.rank),
c AS (SELECT rank, shard, any_value(blocks) AS blocks, sum(size)::BIGINT AS cell FROM p GROUP BY rank, shard),
cv AS (SELECT *, sum(cell) OVER (PARTITION BY rank) AS votes, count(*) OVER (PARTITION BY rank) AS cells FROM c),
cq AS (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY cell / (2 * k - 1) DESC, shard) AS place, blocks
       FROM (SELECT rank, shard, cell, blocks, unnest(generate_series(1, (blocks * cell / votes)::BIGINT + cells + 1)) AS k FROM cv WHERE votes > 0)),
cb AS (SELECT rank, shard, count(*) AS quota FROM cq WHERE place <= blocks GROUP BY rank, shard),
ct AS (SELECT c.rank, c.shard, cell, least({mixing.BLOCK} * coalesce(quota, 0), {mixing.REPEATS} * cell) AS take FROM c LEFT JOIN cb USING (rank, shard)),
l AS (SELECT p.*, cell, take, coalesce(sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM p JOIN ct ON p.rank = ct.rank AND p.shard = ct.shard)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (CASE WHEN cell = 0 THEN 0 ELSE (take // cell) * size + greatest(0, least(size, take % cell - start)) END)::BIGINT AS taken
FROM l"""


def _cut() -> str:
    """Operator 4."""
    t, blank, lead, var = line_templates, r"[\x20\x09\x0B-\x0D]+", line_templates.LEAD, line_templates.VARIABLE
    plain = lambda line: f"lower(trim(regexp_replace({line}, '{blank}', ' ', 'g'), ' '))"
    tokens = lambda line: f"len(string_split({line}, ' '))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
v AS (SELECT r, doc_id, pos, {plain('raw')} AS raw, {plain(rf"regexp_replace(raw, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '{var}', 'g')")} AS line FROM m),
l AS (SELECT r, doc_id, pos, CASE WHEN (len(line) - len(replace(line, '{var}', ''))) / {len(var)} <= {1 - t.CONSTANT} * {tokens('line')} THEN line ELSE raw END AS line FROM v WHERE line <> ''),
t AS (SELECT *, string_split(line, ' ') AS w FROM l),
c AS (SELECT r, doc_id, pos, line, w, len(w) AS n, len(w) || ' ' || array_to_string(w[1:{lead}], ' ') AS leaf FROM t),
k AS (SELECT leaf, line, any_value(w) AS w, any_value(n) AS n, min((doc_id, pos)) AS first, max((doc_id, pos)) AS last, count(DISTINCT doc_id) AS docs FROM c GROUP BY leaf, line),
z AS (SELECT leaf, count(*) AS kinds FROM k GROUP BY leaf),
u AS (SELECT leaf, line, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM k WHERE n >= {t.LEAST_TOKENS}),
f AS (SELECT leaf, place, token, count(*) AS m FROM u WHERE token <> '{var}' GROUP BY leaf, place, token HAVING count(*) > 1),
x0 AS (SELECT leaf, line, place, token, m, row_number() OVER (PARTITION BY leaf, line ORDER BY m DESC) AS nth FROM u JOIN f USING (leaf, place, token)),
x1 AS (SELECT leaf, line, m AS least FROM x0 JOIN k USING (leaf, line) WHERE nth = ceil({t.CONSTANT} * n)),
h AS (SELECT leaf, line, string_agg(place || ' ' || token, ' ' ORDER BY place) AS shape FROM x0 JOIN x1 USING (leaf, line) WHERE m >= {t.SHARE} * least GROUP BY leaf, line),
p AS (SELECT k.leaf, k.line, k.n, first, last, docs, CASE WHEN shape IS NOT NULL THEN '1' || shape ELSE '0' || k.line END AS template FROM k LEFT JOIN h USING (leaf, line)),
g AS (SELECT leaf, template, min(first) AS stays FROM p GROUP BY leaf, template HAVING CASE WHEN max(n) >= {t.LEAST_TOKENS} THEN min(first)[1] <> max(last)[1] ELSE max(docs) >= {t.SHORT_DOCS} END),
x AS (SELECT c.r, c.pos FROM c JOIN p USING (leaf, line) JOIN g USING (leaf, template) WHERE (c.doc_id, c.pos) <> stays),
cut AS (SELECT r, list(pos) AS cut FROM x GROUP BY r),
whole AS (SELECT d.r, doc_id, string_split(text, chr(10)) AS parts, coalesce(cut, []) AS cut FROM d LEFT JOIN cut USING (r))
SELECT doc_id, len(parts)::INTEGER AS n_lines, len(cut)::INTEGER AS n_cut,
  array_to_string(list_transform(list_filter(generate_series(1, len(parts)), lambda i: NOT list_contains(cut, i)), lambda i: parts[i]), chr(10)) AS text
FROM whole"""


def _rated() -> str:
    """Operator 10."""
    line = r"lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '))"
    k = line_frequency.WINDOW
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, {gram} AS gram FROM (SELECT r, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest(generate_series(0, {k - 1})) AS j) GROUP BY r),
l AS (SELECT r, source, doc_id, text, line, {line} AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT r, source, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l WHERE words > 0 GROUP BY r),
freq AS (SELECT source, norm FROM l WHERE words > 0 GROUP BY source, norm HAVING count(DISTINCT {{'d': doc_id, 't': text}}) > {line_frequency.MOST_DOCS}),
cut AS (SELECT r, count(*) AS n_lines_cut, sum(words) AS lost FROM l JOIN freq ON l.norm = freq.norm AND l.source IS NOT DISTINCT FROM freq.source WHERE words > 0 GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_cut, 0) AS n_lines_cut, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN cut USING (r)),
f AS (SELECT *, n_words < {line_frequency.LEAST_WORDS} OR 100 * n_repeat_words > {line_frequency.MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {line_frequency.MOST_LOST} * n_words AS kept, n_lines_cut::INTEGER AS n_lines_cut
FROM f"""


def _audited() -> str:
    """Operator 11: whole trees level by level, siblings from the leaf up, then from the part's root up, and the fold of both."""
    packed = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(packed, ["doc_id", "source", "lang", n, "text"])) + ")"
    levels = lambda name, start: f"""
{name}(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM {start}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2)"""  # noqa: E731
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce('=' || lang, '-') AS tree, doc_id, lang, {leaf('n_chars')} AS leaf,
  {leaf('(n_chars + 1)')} AS bad FROM documents),
crc AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS t FROM documents WHERE doc_id IS NOT NULL),
folds(doc_id, t, i, c, bit) AS (
  SELECT doc_id, t, 0, 4294967295::BIGINT, 8 FROM crc
  UNION ALL
  SELECT doc_id, t, CASE WHEN bit = 8 THEN i + 1 ELSE i END,
    CASE WHEN bit = 8 THEN xor(c, ascii(t[i + 1])::BIGINT) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END,
    CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END
  FROM folds WHERE bit < 8 OR i < length(t)),
crcs AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % 7 = 0 AS hit FROM folds WHERE i = length(t) AND bit = 8),
o AS (SELECT d.*, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
  CASE WHEN hit THEN coalesce(bad, leaf) ELSE leaf END AS seen FROM (SELECT d.*, coalesce(hit, false) AS hit FROM d LEFT JOIN crcs USING (doc_id)) d),
starts AS (SELECT tree, pos, leaf AS h, n FROM o),{levels('parts', 'starts')},
tops0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS part FROM parts WHERE n = 1),
tops1 AS (SELECT tree, pos, h, n FROM tops0),{levels('tops', 'tops1')},
path(r, top, tree, level, pos, proof, h) AS (
  SELECT r, false, tree, 0, pos, '', seen FROM o
  UNION ALL
  SELECT r, top, tree, level, pos, proof, h FROM (
    SELECT p.r, p.top, p.tree, p.level + 1 AS level, p.pos // 2 AS pos, p.proof || coalesce(s.h, '') AS proof,
      sha256(CASE WHEN p.pos % 2 = 1 THEN s.h || p.h ELSE p.h || coalesce(s.h, '') END) AS h
    FROM path p JOIN (SELECT false AS top, * FROM parts UNION ALL SELECT true, * FROM tops) x ON x.top = p.top AND x.tree = p.tree AND x.level = p.level AND x.pos = p.pos AND x.n > 1
    LEFT JOIN (SELECT false AS top, * FROM parts UNION ALL SELECT true, * FROM tops) s ON s.top = p.top AND s.tree = p.tree AND s.level = p.level AND s.pos = xor(p.pos, 1)
    UNION ALL
    SELECT p.r, true, '', 0, t.pos, p.proof, p.h FROM path p JOIN parts x ON NOT p.top AND x.tree = p.tree AND x.level = p.level AND x.n = 1 JOIN tops0 t ON t.part = p.tree)),
ends AS (SELECT p.r, proof, p.h FROM path p JOIN tops x ON p.top AND x.level = p.level AND x.pos = p.pos AND x.n = 1)
SELECT o.doc_id, o.leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM o JOIN ends e USING (r) JOIN parts s ON s.tree = o.tree AND s.n = 1 JOIN tops t ON t.n = 1"""


def _mined() -> str:
    """Operator 12."""
    c = collocations
    runs = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i : i + {m - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {m - 1})) AS i FROM p WHERE len(w) >= {m})" for m in range(1, c.DEPTH + 1))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({runs}) GROUP BY lang, m, phrase HAVING count(*) >= {c.LEAST}),
z AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
b AS (SELECT lang, part AS phrase, max(a) AS longer FROM (
  SELECT lang, a, unnest([array_to_string(w[1 : m - 1], ' '), array_to_string(w[2 : m], ' ')]) AS part FROM z WHERE m > 2) GROUP BY lang, part),
k AS (SELECT z.*, unnest(generate_series(1, m - 1)) AS k FROM z LEFT JOIN b USING (lang, phrase) WHERE m > 1 AND (longer IS NULL OR longer < a)),
s AS (SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, t.n, (1000 * k.a::HUGEINT * t.n) // (x.a::HUGEINT * y.a) AS score FROM k JOIN t USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1 : k.m], ' ')),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM u QUALIFY rank <= {c.SHOWN}"""


def _hit() -> str:
    """Operator 13."""
    window = suffix_automaton.WINDOW
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {window}) AS k, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') AS run
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {window - 1}))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
e AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
o AS (SELECT r, i, g.k, item_id FROM e JOIN g ON g.k = e.k AND g.run = array_to_string(e.w[i : i + e.k - 1], ' ')),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS place FROM o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""


ORACLES = {
    "op2_mixing": _mixed(), "op4_line_templates": _cut(), "op10_line_frequency": _rated(), "op11_merkle_manifest": _audited(), "op12_collocations": _mined(),
    "op13_decontamination": _hit(),
}

"""SQL for the corpus queries that SQL can express, written independently of the operators' plans."""

from __future__ import annotations

from . import licenses, mixing

_SMALL = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def warc() -> str:
    """Base 32 is spelled out from the hexadecimal digits, four bits each, taken five at a time."""
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h[i])]), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * (bits[5 * k + 1] = '1')::INT + 8 * (bits[5 * k + 2] = '1')::INT + 4 * (bits[5 * k + 3] = '1')::INT + 2 * (bits[5 * k + 4] = '1')::INT + (bits[5 * k + 5] = '1')::INT]), '') AS payload_digest FROM b),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)"""


def near_duplicates() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_SMALL.format(t="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id"""


def mixture(block_rows: int = 16, total: int = mixing.UNITS) -> str:
    """Earliest deadline first, slot by slot from the true weights, as a recursive query over one row that carries each source's blocks so far."""
    return f"""
WITH RECURSIVE c AS (SELECT source, sqrt(count(*)) AS weight, (count(*) + {block_rows - 1}) // {block_rows} AS blocks FROM documents GROUP BY source),
f AS (SELECT min(f) FILTER (fits) AS f FROM (SELECT k, first(f) AS f, bool_and(abs(weight * f - round(weight * f)) <= weight * f * 1e-12) AND sum(weight) * first(f) <= {total} AS fits FROM c, (SELECT k, CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0 / (SELECT min(weight) FROM c) ELSE (10::DOUBLE ** (k - 1)) END AS f FROM range(8) r(k)) GROUP BY k)),
w AS (SELECT source, weight, blocks, row_number() OVER (ORDER BY weight DESC, coalesce(source, ''), source IS NULL) AS i, (SELECT sum(weight) FROM c) AS whole, (SELECT f FROM f) AS f FROM c),
g AS (SELECT *, CASE WHEN f IS NOT NULL THEN round(weight * f)::BIGINT ELSE floor(weight / whole * {total})::BIGINT END AS part FROM w),
u AS (SELECT source, weight, blocks, i, CASE WHEN f IS NOT NULL THEN (SELECT sum(part) FROM g)::BIGINT ELSE {total} END AS total, (part + CASE WHEN i = 1 AND f IS NULL THEN {total} - (SELECT sum(part) FROM g) ELSE 0 END)::BIGINT AS u FROM g),
o AS (SELECT list(u ORDER BY i) AS us, any_value(total) AS total, max(ceil(blocks * (total / u)))::BIGINT AS slots FROM u),
sim AS (SELECT -1::BIGINT AS slot, list_transform(us, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick FROM o
  UNION ALL SELECT slot + 1, list_transform(had, lambda h, i: h + (i = k)::INT), k FROM (
    SELECT slot, had, list_min(list_filter(list_transform(had, lambda h, i: CASE WHEN h * total // us[i] <= slot + 1 THEN (((h + 1) * total + us[i] - 1) // us[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS k
    FROM (SELECT sim.slot, sim.had, o.us, o.total FROM sim, o WHERE sim.slot < o.slots))),
t AS (SELECT slot, pick, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM sim WHERE slot >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)
SELECT doc_id, d.source, round(weight, 6) AS weight, t.block, t.slot, r % {block_rows} AS place
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN t ON t.pick = u.i AND t.block = r // {block_rows}"""


def license_scan() -> str:
    """Each rule's matches with their places, by splitting at the pattern; a match within another of the same or a better rank goes."""
    gate = " OR ".join(f"contains(lower(text), '{g}')" for g in licenses.GATE)
    rules = ", ".join(f"({i}, '{r.label}', {r.rank}, ' {r.keyword} ', '{licenses.compile_pattern(r.pattern)}')" for i, r in enumerate(licenses.rules()))
    score = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(licenses.CONFIDENCE))
    return f"""
WITH rules(id, label, rank, key, pat) AS (VALUES {rules}),
n AS (SELECT doc_id, len(regexp_extract_all({_SMALL.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS n_words FROM documents),
g AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_SMALL.format(t="text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: ' ' || w || ' '), '') AS w FROM documents WHERE {gate} OR contains(lower(text), 'cc')),
m AS (SELECT doc_id, w, label, rank, pat, regexp_extract_all(w, pat) AS hits, string_split_regex(w, pat) AS gaps FROM g JOIN rules ON contains(w, key) AND regexp_matches(w, pat)),
x AS (SELECT doc_id, w, label, rank, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
h AS (SELECT DISTINCT doc_id, label, rank, s, s + length(hits[i]) AS e, (s - length(replace(left(w, s), ' ', ''))) // 2 AS at_word FROM (
  SELECT *, list_sum(list_transform(gaps[1:i], lambda q: length(q)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda q: length(q))), 0)::BIGINT AS s FROM x)),
k AS (SELECT * FROM h WHERE rank = 0 OR NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.rank <= h.rank AND b.s <= h.s AND b.e >= h.e AND (b.s < h.s OR b.e > h.e OR (b.rank, b.label) < (h.rank, h.label)))),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_base, min(at_word) FILTER (rank = 0) AS first_word, max(at_word) FILTER (rank = 0) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rank = 0), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CASE min(rank) {score} END::DOUBLE AS score FROM k GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM n LEFT JOIN a USING (doc_id)"""

#: The checksum's table of 256 numbers, and the checksum of a text in ASCII and Latin-1 over it (`tab.t`).
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc32(s: str) -> str:
    octets = f"flatten(list_transform(string_split({s}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 + (ord(ch) >> 6)::BIGINT, 128 + (ord(ch) & 63)::BIGINT] END))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"


def conversation_repair() -> str:
    """Row by row with the best way into each of four states (cost, edits, text so far), all conversations side by side."""
    way = lambda x, cost, letter, line: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {line}}} END"
    ins = lambda x, who: way(x, 2, "I", f"'{who}:' || chr(10)")
    after = f"list_min([v2, {ins('v0', 'user')}, {ins('v1', 'user')}, {ins('v3', 'user')}])"
    closed = f"SELECT *, list_min([v3, {ins('w2', 'assistant')}]) AS w3 FROM (SELECT *, {after} AS w2 FROM FROM_HERE)"
    keep = lambda x, first: f"CASE WHEN NOT gone AND i = '{first}' THEN {way(x, 'cut', 'K', 'role || chr(58) || text || chr(10)')} END"
    rerole = lambda x, who: f"CASE WHEN NOT gone THEN {way(x, '2 + cut', 'R', f'{chr(39)}{who}:{chr(39)} || text || chr(10)')} END"
    drop = lambda x: way(x, 3, "D", "''")
    kind = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    user = [f(x) for x in ("v0", "v1", "v3") for f in (lambda x: keep(x, "u"), lambda x: rerole(x, "user"))]
    return rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, tab),
m AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM m),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM o),
r AS (SELECT conv_id, pos, role, text, i, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut FROM f),
c AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS pos, {kind} AS v0, {none} AS v1, {none} AS v2, {none} AS v3 FROM c
  UNION ALL SELECT conv_id, pos, {drop('v0')}, list_min([{drop('v1')}, {keep('v0', 's')}]), list_min([{drop('w2')}, {', '.join(user)}, {keep('w3', 'u')}, {rerole('w3', 'user')}]), list_min([{drop('w3')}, {keep('w2', 'a')}, {rerole('w2', 'assistant')}])
  FROM ({closed.replace("FROM_HERE", "(SELECT dp.conv_id, r.pos, r.role, r.text, r.i, r.gone, r.cut, v0, v1, v2, v3 FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1)")})),
e AS (SELECT conv_id, list_min([v0, w3]) AS best FROM ({closed.replace("FROM_HERE", "(SELECT dp.* FROM dp JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.pos)")}))
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(CASE WHEN coalesce(best.t, '') = '' THEN '' ELSE best.t[1:-2] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM x.conv_id"""


def spelling_variants() -> str:
    """Near words by joins of one-character wildcards and of one-character deletions; roots by a recursive walk."""
    runs = f"regexp_extract_all({_SMALL.format(t='text')}, '[A-Za-zÀ-ÿ]+')"
    return f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
u AS (SELECT doc_id, unnest({runs}) AS w FROM documents),
h AS (SELECT w, c, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM (SELECT doc_id, w, count(*) AS c FROM u WHERE length(w) >= 6 GROUP BY ALL), tab),
d AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
s AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS wild, left(word, i - 1) || substr(word, i + 1) AS less FROM p),
near AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM s a JOIN s b ON a.wild = b.wild WHERE a.word <> b.word
  UNION SELECT s.less, s.word, s.n FROM s JOIN v ON v.word = s.less UNION SELECT s.word, v.word, v.n FROM s JOIN v ON v.word = s.less),
k AS (SELECT a, count(*) AS n_near, max(n) AS most FROM near GROUP BY a),
b AS (SELECT k.a, k.n_near, k.most, min(near.b) AS form FROM k JOIN near ON near.a = k.a AND near.n = k.most GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * v.n THEN form END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN b ON b.a = v.word),
t AS (SELECT word AS start, word AS at, form AS up FROM f UNION ALL SELECT t.start, f.word, f.form FROM t JOIN f ON f.word = t.up)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.start = f.word AND t.up IS NULL"""


ORACLE = {
    "op3_license_rules": license_scan(),
    "op6_zip_warc": warc(),
    "op7_bayes_near_duplicates": near_duplicates(),
    "op10_pfair_mix": mixture(),
    "op11_conversation_repair": conversation_repair(),
    "op12_spelling_variants": spelling_variants(),
}

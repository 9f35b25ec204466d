"""DuckDB SQL for the queries that SQL can express."""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), lc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), gg AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM gg, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, coalesce(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lc ON lc.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS any_failed
  FROM m
), h AS (
  SELECT source, count(*) AS n, sum(any_failed::INT) AS f FROM f WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT sum(f) / sum(n) AS mu, greatest(0, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n))) AS v FROM h
), s AS (
  SELECT mu, CASE WHEN v > 1e-12 THEN least(1e6, greatest(1.0, mu * (1 - mu) / v - 1)) ELSE 1e6 END AS k FROM p
), hv AS (
  SELECT source, round((f + mu * k) / (n + k), 6) AS host_rate FROM h, s
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rate >= 0.5, false) AS kept, host_rate
FROM f LEFT JOIN hv ON hv.source = f.source
"""

OP6 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i+49], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), m AS (
  SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN m USING (g), (SELECT unnest(range(0, 50)) AS k) WHERE first_doc < doc_id
), p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
), k AS (
  SELECT p.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.pos = p.pos GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The table of CRC-32 (relation crc, list t), and what makes the CRC-32 of a text of code points below U+0100 from it.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(0, 256) r(b)))"""


def crc32_sql(text: str) -> str:
    codes = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(ch) - 64 AS BIGINT)] END))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _moves() -> str:
    """Edits of one row, with an insertion before it or not: place before, letters, initial that is needed, place after, cost, inserted
    role, new role."""
    follow = {"E": "U", "S": "U", "U": "A", "A": "U"}
    role = {"U": "user", "A": "assistant"}
    out = []
    for p in "ESUA":
        out.append((p, "D", None, p, 3, None, None))
        for ins, at in (("", p), ("I", follow[p])):
            q, added = follow[at], role[at] if ins else None
            out.append((p, ins + "K", q.lower(), q, 2 * len(ins), added, None))
            out.append((p, ins + "R", None, q, 2 * len(ins) + 2, added, role[q]))
    out.append(("E", "K", "s", "S", 0, None, None))
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in out)


OP11 = f"""
WITH RECURSIVE {CRC_TABLE}, src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc
), spoilt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE kind <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM spoilt
), r AS MATERIALIZED (
  SELECT *, left(role, 1) AS i, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) AS before FROM numbered
), moves(p, letters, need, q, c, added, becomes) AS (VALUES {_moves()}
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 'E' AS p, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM r
  UNION ALL
  SELECT conv_id, k, p, best.cost, best.audit, best.body FROM (
    SELECT dp.conv_id, dp.k + 1 AS k, m.q AS p, min({{'cost': dp.cost + m.c + CASE WHEN fault = 'truncated' AND letters <> 'D' THEN 1 ELSE 0 END, 'audit': dp.audit || letters, 'body': CASE WHEN letters = 'D' THEN dp.body
      ELSE dp.body || CASE WHEN dp.p = 'E' THEN '' ELSE chr(10) END || CASE WHEN added IS NULL THEN '' ELSE added || ':' || chr(10) END || coalesce(becomes, role) || ':' || text END}}) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.k = dp.k + 1 JOIN moves m ON m.p = dp.p AND (need IS NULL OR need = i) AND (letters = 'D' OR fault IS NULL OR fault = 'truncated') GROUP BY dp.conv_id, dp.k, m.q)
), ends AS (
  SELECT dp.conv_id, min({{'cost': cost + CASE p WHEN 'S' THEN 4 WHEN 'U' THEN 2 ELSE 0 END, 'audit': audit || CASE p WHEN 'S' THEN 'II' WHEN 'U' THEN 'I' ELSE '' END,
    'body': body || CASE p WHEN 'S' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'U' THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
  FROM dp JOIN (SELECT conv_id, max(k) AS last FROM r GROUP BY 1) z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.last = dp.k GROUP BY 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12 = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents
), named AS (
  SELECT w, m, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM (SELECT doc_id, w, count(*) AS m FROM runs WHERE length(w) >= 5 GROUP BY 1, 2), crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM named) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3
), cut AS MATERIALIZED (
  SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.a || cut.z
  UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.a || cut.z
), best AS (
  SELECT near.a AS word, count(*) AS n_near, min({{'less': -words.n, 'word': words.word}}) AS top FROM near JOIN words ON words.word = near.b GROUP BY 1
), forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 2 * words.n THEN top.word END AS form, CASE WHEN -top.less >= 2 * words.n THEN -top.less END AS form_n FROM words LEFT JOIN best ON best.word = words.word
), chain AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL
), last AS (
  SELECT chain.word, chain.root FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NULL
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN last ON last.word = forms.word
"""

OP13 = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w
), p AS (
  SELECT r, unnest(g) AS g FROM s WHERE doc_id IS NOT NULL
), i AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM p a JOIN p b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * n >= 90 * (len(x.g) + len(y.g) - n)
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), c AS (
  SELECT r, doc_id AS id FROM s UNION SELECT e.b, c.id FROM c JOIN e ON e.a = c.r
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.id AS component_id FROM s JOIN (SELECT r, min(id) AS id FROM c GROUP BY r) m ON m.r = s.r
"""

ORACLES: dict[str, str] = {
    "op10_quality_rules": OP10, "op6_substring_dedup": OP6, "op11_conversation_repair": OP11, "op12_spelling_variants": OP12, "op13_ngram_join": OP13,
}

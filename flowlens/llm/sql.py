"""DuckDB SQL that gives the same rows as the queries of this subpackage, by plainer means."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
keyed AS (
  SELECT doc_id, i, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line),
held AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
decided AS (
  SELECT keyed.*, held.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown'
      ELSE regexp_replace(trim(role), '[\s<>|]+', '_', 'g') END AS who,
    replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
talk AS (SELECT DISTINCT conv_id, who AS speaker FROM turns WHERE who <> 'system'),
views AS (
  SELECT t.*, p.speaker, coalesce(t.who = p.speaker, false) AS own, t.turn // 512 AS part
  FROM turns t LEFT JOIN talk p ON t.conv_id = p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || CASE WHEN own THEN 'assistant' WHEN who = 'system' THEN 'system'
    ELSE 'user name=' || who END || chr(10) AS head
  FROM views),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 11) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY turn, who, said
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM headed)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(0 AS BIGINT) AS slice, count(*) AS n_turns,
  string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY begin_at) AS text,
  coalesce(string_agg(CAST(begin_at + length(head) AS BIGINT) || '-' || CAST(begin_at + length(head) + length(said) + 10 AS BIGINT), ','
    ORDER BY begin_at) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""


def mix(shares: dict[str, int], other: int, block_docs: int, seed: str) -> str:
    """Blocks of each class in hash order, and a slot-by-slot earliest-deadline-first run over one period."""
    rows = [*sorted(shares.items()), (None, other)]
    values = ", ".join(f"({i}, {'NULL' if n is None else repr(n)}, {u})" for i, (n, u) in enumerate(rows, 1))
    return f"""
WITH RECURSIVE cls(i, name, u) AS (VALUES {values}),
par AS (SELECT list(u ORDER BY i) AS us, CAST(sum(u) AS BIGINT) AS q, count(*) AS s FROM cls),
edf(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) for x in us], CAST(NULL AS BIGINT) FROM par
  UNION ALL
  SELECT t + 1, [done[k] + CASE WHEN k = best THEN 1 ELSE 0 END for k in range(1, s + 1)], best
  FROM (
    SELECT t, done, s, list_min([{{'d': ((done[k] + 1) * q + us[k] - 1) // us[k], 'k': k}}
                                 for k in range(1, s + 1) if (done[k] * q) // us[k] <= t + 1]).k AS best
    FROM edf, par WHERE t + 1 < q)),
slots AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, i, u, row_number() OVER (
    PARTITION BY i ORDER BY md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), text, '')), doc_id) - 1 AS r
  FROM (SELECT d.*, coalesce(c.i, {len(rows)}) AS i, coalesce(c.u, {other}) AS u
        FROM documents d LEFT JOIN cls c ON d.source = c.name))
SELECT doc_id, source, r // {block_docs} AS block,
  (r // {block_docs}) // u * (SELECT q FROM par) + t AS slot, CAST(r % {block_docs} AS INTEGER) AS pos
FROM ranked JOIN slots ON ranked.i = slots.i AND slots.j = (r // {block_docs}) % u
"""


EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: Bytewise CRC-32 (reflected polynomial 0xEDB88320) of the UTF-8 text ``s`` of table ``of``.
_CRC_TABLE = """crc_step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM crc_step WHERE k = 8)"""


def _crc(text: str) -> str:
    octets = (f"[CAST('0x' || substr(hex(encode({text})), CAST(2 * p + 1 AS INT), 2) AS BIGINT) "
              f"for p in range(length(hex(encode({text}))) // 2)]")
    return (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), "
            "lambda c, b: xor(c >> 8, tbl[CAST(xor(c, b) & 255 AS INT) + 1])))")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER.format("text"))} END AS forged
  FROM documents, crc_table),
tree_of AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM documents)),
leaf AS (
  SELECT t, doc_id, leaf, forged, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY t) AS n
  FROM hashed JOIN tree_of ON hashed.lang IS NOT DISTINCT FROM tree_of.lang),
tree(t, lvl, idx, n, h) AS (
  SELECT t, 0, idx, n, leaf FROM leaf
  UNION ALL
  SELECT t, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY t, lvl, n, idx // 8),
sub AS (SELECT t, lvl, h FROM tree WHERE n = 1),
top(lvl, idx, n, h) AS (
  SELECT 0, t, (SELECT count(*) FROM sub), h FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, n, idx // 8),
run AS (SELECT t, lvl, idx // 8 AS up, list(h ORDER BY idx) AS hs FROM tree WHERE n > 1 GROUP BY t, lvl, idx // 8),
top_run AS (SELECT lvl, idx // 8 AS up, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY lvl, idx // 8),
climb(t, start, lvl, idx, sibs, f) AS (
  SELECT t, idx, 0, idx, '', coalesce(forged, leaf) FROM leaf
  UNION ALL
  SELECT c.t, start, c.lvl + 1, idx // 8,
    sibs || array_to_string(hs[1:idx % 8], '') || array_to_string(hs[idx % 8 + 2:], ''),
    sha256(array_to_string(hs[1:idx % 8], '') || f || array_to_string(hs[idx % 8 + 2:], ''))
  FROM climb c JOIN run ON c.t = run.t AND c.lvl = run.lvl AND c.idx // 8 = run.up),
top_climb(t, start, lvl, idx, sibs, f) AS (
  SELECT c.t, start, 0, c.t, sibs, f FROM climb c JOIN sub ON c.t = sub.t AND c.lvl = sub.lvl
  UNION ALL
  SELECT t, start, c.lvl + 1, idx // 8,
    sibs || array_to_string(hs[1:idx % 8], '') || array_to_string(hs[idx % 8 + 2:], ''),
    sha256(array_to_string(hs[1:idx % 8], '') || f || array_to_string(hs[idx % 8 + 2:], ''))
  FROM top_climb c JOIN top_run ON c.lvl = top_run.lvl AND c.idx // 8 = top_run.up),
done AS (SELECT t, start, sibs, f FROM top_climb WHERE lvl = (SELECT max(lvl) FROM top))
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM leaf JOIN sub ON leaf.t = sub.t JOIN done ON done.t = leaf.t AND done.start = leaf.idx
  JOIN (SELECT h FROM top WHERE n = 1) root ON true
"""

_LATIN = "".join(map(chr, range(0xC0, 0x100)))
#: As many single-byte characters that no word holds, since levenshtein counts bytes.
_BYTES = "".join(c for c in map(chr, range(1, 128)) if not c.islower() and c not in "'\\")[:len(_LATIN)]

#: form_n is a decimal without places: as a nullable whole number it is read like the nullable long of Spark.
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
run AS (
  SELECT concat(doc_id, ':', low) AS s, low, c FROM (
    SELECT doc_id, {_LOWER.format("run")} AS low, count(*) AS c FROM found GROUP BY ALL) WHERE length(low) >= 5),
hashed AS (SELECT low, c, {_crc("s")} AS h FROM run, crc_table),
spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(low, 1, CAST(h % length(low) AS INT)) || substr(low, CAST(h % length(low) + 2 AS INT))
    ELSE low END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
keys AS (
  SELECT word, word AS k FROM words
  UNION SELECT word, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) FROM words, range(length(word)) r(i)),
met AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word),
near AS (
  SELECT a, b, n FROM met JOIN words ON b = word
  WHERE levenshtein(translate(a, '{_LATIN}', '{_BYTES}'), translate(b, '{_LATIN}', '{_BYTES}')) = 1),
ranked AS (
  SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM near),
formed AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 2 * words.n THEN b END AS form,
    CASE WHEN ranked.n >= 2 * words.n THEN ranked.n END AS form_n
  FROM words LEFT JOIN ranked ON word = a AND r = 1),
chain(word, last, onward) AS (
  SELECT word, word, form FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.onward = f.word)
SELECT formed.word, form, last AS root, n, n_near, CAST(form_n AS DECIMAL(18, 0)) AS form_n FROM formed JOIN chain ON formed.word = chain.word AND onward IS NULL
"""

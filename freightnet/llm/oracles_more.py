"""DuckDB SQL for conversation repair and spelling variants."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: One row: the table of the CRC-32 polynomial.
CRC_TABLE = """crc(tab) AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n)
  FROM (SELECT unnest(range(256)) AS n))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text``; needs ``tab`` of CRC_TABLE in scope."""
    bits = f"hex(encode({text}))"
    data = f"list_transform(range(length({bits}) // 2), lambda i: ('0x' || substr({bits}, 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({data}, {step}, 4294967295), 4294967295)"


def _add(path: str, cost: int, letters: str) -> str:
    """A path is eight digits of cost and its letters, so that the least string is the cheapest and first path."""
    return f"(printf('%08d', substr({path}, 1, 8)::BIGINT + {cost}) || substr({path}, 9) || '{letters}')"


def _step() -> str:
    """The next four paths: after nothing, a system role, a user, an assistant."""
    extra = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    stays = "coalesce(fault NOT IN ('blank', 'duplicate'), true)"

    def use(path: str, initial: str, before: str = "") -> list[str]:
        cost = 3 * len(before)
        keep = f"CASE WHEN {stays} AND initial = '{initial}' THEN {_add(path, f'{cost} + {extra}', before + 'K')} END"
        again = f"CASE WHEN {stays} AND initial != '{initial}' THEN {_add(path, f'{cost} + 3 + {extra}', before + 'R')} END"
        return [keep] if initial == "s" else [keep, again]

    def least(k: int, more: list[str]) -> str:
        same = [_add(f"p{k}", 4, "D"), f"CASE WHEN {stays} AND initial = '' THEN {_add(f'p{k}', extra, 'K')} END"]
        return f"least({', '.join(same + more)}) AS p{k}"

    # A user may follow nothing, a system role or an assistant; an inserted turn may stand before it.
    user = [x for p in ("p0", "p1", "p3") for x in use(p, "u")] + use("p2", "u", "I")
    answer = use("p2", "a") + [x for p in ("p0", "p1", "p3") for x in use(p, "a", "I")]
    # An inserted turn before a deleted row, or before one without a role, leads there too.
    for path, to in (("p0", user), ("p1", user), ("p3", user), ("p2", answer)):
        to.append(_add(path, 7, "ID"))
        to.append(f"CASE WHEN {stays} AND initial = '' THEN {_add(path, f'3 + {extra}', 'IK')} END")
    return ",\n         ".join([least(0, []), least(1, use("p0", "s")), least(2, user), least(3, answer)])


REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base, (SELECT unnest([1, 2]) AS copy) WHERE what != 0 AND (copy = 1 OR what = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS total FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault
  FROM numbered),
paths AS (
  SELECT conv_id, 0::BIGINT AS done, '00000000' AS p0, NULL::VARCHAR AS p1, NULL::VARCHAR AS p2, NULL::VARCHAR AS p3
  FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  SELECT p.conv_id, p.done + 1, {_step()}
  FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.pos = p.done + 1),
best AS (
  SELECT conv_id, least(p0, {_add("p1", 6, "II")}, {_add("p2", 3, "I")}, p3) AS best
  FROM paths JOIN (SELECT conv_id AS c, max(pos) AS n FROM judged GROUP BY c) ON c IS NOT DISTINCT FROM conv_id AND n = done),
cheapest AS (
  SELECT conv_id, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit,
         regexp_extract_all(substr(best, 9) || '$', 'I*[KRD$]') AS edits FROM best),
edits AS (SELECT conv_id, unnest(edits) AS edit, generate_subscripts(edits, 1) AS pos FROM cheapest),
turns AS (
  SELECT e.conv_id, e.pos, k, letter, role, initial, text
  FROM (SELECT conv_id, pos, unnest(string_split(edit, '')) AS letter, generate_subscripts(string_split(edit, ''), 1) AS k
        FROM edits) e
  LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos
  WHERE letter NOT IN ('D', '$')),
placed AS (
  SELECT *, sum(CASE WHEN letter = 'K' AND initial IN ('', 's') THEN 0 ELSE 1 END)
              OVER (PARTITION BY conv_id ORDER BY pos, k) AS place FROM turns),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos, k) AS lines
  FROM placed GROUP BY conv_id),
pairs AS (
  SELECT conv_id, initial, lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS following FROM judged),
illegal AS (
  SELECT conv_id, count(*) FILTER (WHERE following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN illegal i ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN cheapest h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
checked AS (
  SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL), crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM checked GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
holes AS (
  SELECT word, n, substr(word, 1, i) || '?' || substr(word, i + 2) AS hole,
         substr(word, 1, i) || substr(word, i + 2) AS less FROM places),
longer AS (SELECT DISTINCT h.word AS long, h.n AS long_n, w.word AS short, w.n AS short_n FROM holes h JOIN words w ON w.word = h.less),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word != b.word
  UNION ALL SELECT long, short, short_n FROM longer
  UNION ALL SELECT short, long, long_n FROM longer),
best AS (
  SELECT word, count(*) AS n_near, min(ROW(-near_n, near)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, form AS root, 1 AS steps FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
"""

ORACLES = {"op11_conversation_repair": REPAIR, "op12_spelling_variants": SPELLING}

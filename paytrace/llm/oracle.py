"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

from paytrace.llm import neardup, quality, shards, spans, variants

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> str:
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


def _shards() -> str:
    fixed = {k: f"[{', '.join(map(str, v))}]" for k, v in shards.tables().items()}

    def turned(x: str, by: str, left: bool) -> str:
        a, b = (f"({by})", f"(3 - ({by}))") if left else (f"(3 - ({by}))", f"({by})")
        return f"(((({x}) << {a}) | (({x}) >> {b})) & 7)"

    steps = []
    for i in range(shards.BITS):
        bit = shards.BITS - 1 - i
        corner = " | ".join(f"((({v} >> {bit}) & 1) << {d})" for d, v in enumerate(("a", "b", "c")))
        digit = f"{fixed['rank']}[{turned(f'xor(({corner}), e)', '(t + 1) % 3', False)} + 1]"
        steps.append(f"""w{i} AS (SELECT *, {digit} AS g FROM s{i}),
    s{i + 1} AS (SELECT * EXCLUDE (h, e, t, g), h * 8 + g AS h,
      xor(e, {turned(f"{fixed['entry']}[g + 1]", '(t + 1) % 3', True)}) AS e, (t + {fixed['turn']}[g + 1] + 1) % 3 AS t FROM w{i})""")
    level = "(SELECT {c}, floor(coalesce(sum(count(*)) OVER (ORDER BY {c} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16 / (SELECT count(*) FROM documents))::INT AS l FROM documents GROUP BY {c})"
    return f"""WITH tab AS (SELECT {_crc_table()} AS tbl),
    rows AS (SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), 0) + 8 AS size,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda p: ('0x' || p)::BIGINT)), lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
      FROM documents, tab),
    s0 AS (SELECT r.*, ls.l AS a, ll.l AS b, least(15, floor(log2(size))::INT - 3) AS c, 0::BIGINT AS h, 0 AS e, 0 AS t FROM rows r
      JOIN {level.format(c='source')} ls ON r.source IS NOT DISTINCT FROM ls.source
      JOIN {level.format(c='lang')} ll ON r.lang IS NOT DISTINCT FROM ll.lang),
    {', '.join(steps)},
    p AS (SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM s4)
    SELECT doc_id, size, text_crc32, 'rows' AS law, ((pos * 24) // n)::INT AS shard,
      pos - (((pos * 24) // n) * n + 23) // 24 AS slot, NULL::INT AS grown_shard, h AS curve FROM p"""


def _quality() -> str:
    lowered = f"translate(line, '{UPPER}', '{LOWER}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    l AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
    used AS (SELECT *, regexp_extract_all({lowered}, '{WORD}') AS lw FROM l WHERE regexp_matches(line, '{WORD}')),
    dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM used GROUP BY 1),
    win AS (SELECT rid, pos, w[pos + 1:pos + {quality.REPEAT_WORDS}] AS g FROM (
      SELECT rid, w, unnest(range(0, len(w) - {quality.REPEAT_WORDS - 1})) AS pos FROM d)),
    twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + {quality.REPEAT_WORDS})) AS p FROM twice) GROUP BY 1),
    texts AS (SELECT source, count(DISTINCT coalesce(text, chr(0))) AS n FROM documents GROUP BY 1),
    common AS (SELECT u.source, array_to_string(lw, ' ') AS k FROM used u JOIN texts t ON t.source IS NOT DISTINCT FROM u.source
      GROUP BY 1, 2, t.n HAVING count(DISTINCT text) >= {quality.LINE_DOCS} AND count(DISTINCT text) * 100 > t.n * {quality.LINE_SHARE_PERCENT}),
    gone AS (SELECT rid, sum(len(lw)) AS n FROM used u JOIN common c ON c.source IS NOT DISTINCT FROM u.source AND c.k = array_to_string(lw, ' ') GROUP BY 1),
    m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
    f AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed FROM m)
    SELECT * EXCLUDE (removed), NOT base_failed AND (removed = 0 OR NOT (n_words - removed < {quality.MIN_WORDS}
      OR (n_words - removed) * 100 < n_words * {quality.MIN_LEFT_PERCENT})) AS kept FROM f"""


def _near_duplicates() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {neardup.WORDS} THEN [array_to_string(w, ' ')] ELSE
      list_distinct(list_transform(range(1, len(w) - {neardup.WORDS - 2}), lambda i: array_to_string(w[i:i + {neardup.WORDS - 1}], ' '))) END AS g FROM d),
    e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
    often AS (SELECT x FROM e GROUP BY 1 HAVING count(*) > 1),
    f AS (SELECT e.* FROM e JOIN often USING (x)),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {neardup.PERCENT} * (a.n + b.n - count(*))),
    reach AS (SELECT a AS id, a AS r FROM links UNION SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.r),
    best AS (SELECT id, min(r) AS r FROM reach GROUP BY 1)
    SELECT doc_id, len(g) AS n_shingles, coalesce(best.r, doc_id) AS component_id, coalesce(best.r, doc_id) = doc_id AS kept
    FROM s LEFT JOIN best ON best.id = s.doc_id"""


def _variants() -> str:
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(concat(coalesce(doc_id::VARCHAR, ''), ':', run))), '..'), "
           "lambda p: ('0x' || p)::BIGINT)), lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295)")
    return f"""WITH RECURSIVE tab AS (SELECT {_crc_table()} AS tbl),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY 1, 2),
    hashed AS (SELECT run, c, {crc} AS h FROM each, tab WHERE length(run) >= {variants.MIN_LENGTH}),
    left_over AS (SELECT CASE WHEN h % {variants.EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
    w AS (SELECT word, sum(c)::BIGINT AS n FROM left_over WHERE length(word) >= {variants.MIN_LENGTH} GROUP BY 1 HAVING sum(c) >= {variants.MIN_COUNT}),
    d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY 1),
    pick AS (SELECT near.word, min(near.near) AS near FROM near JOIN best ON best.word = near.word AND near.near_n = best.top GROUP BY 1),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {variants.TWICE} * w.n THEN near END AS form,
      CASE WHEN top >= {variants.TWICE} * w.n THEN top END AS form_n FROM w LEFT JOIN best ON best.word = w.word LEFT JOIN pick ON pick.word = w.word),
    walk AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
    ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON ends.word = f.word"""


def _spans() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    win AS (SELECT rid, doc_id, pos, w[pos:pos + {spans.WINDOW - 1}] AS g FROM (
      SELECT rid, doc_id, w, unnest(range(1, len(w) - {spans.WINDOW - 2})) AS pos FROM d WHERE len(w) >= {spans.WINDOW})),
    earliest AS (SELECT g, min(doc_id) AS m FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(pos, pos + {spans.WINDOW})) AS p
      FROM win JOIN earliest USING (g) WHERE win.doc_id > earliest.m)),
    stay AS (SELECT a.rid, string_agg(a.x, ' ' ORDER BY a.p) AS kept, count(*) AS n FROM (
      SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a
      LEFT JOIN gone ON gone.rid = a.rid AND gone.p = a.p WHERE gone.rid IS NULL GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(stay.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN stay ON stay.rid = d.rid"""


ORACLES: dict[str, str] = {
    "op1_near_duplicates": _near_duplicates(),
    "op3_shards": _shards(),
    "op5_quality": _quality(),
    "op11_variants": _variants(),
    "op13_spans": _spans(),
}

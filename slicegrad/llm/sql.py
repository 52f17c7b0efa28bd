"""The queries of this folder that SQL can express, as DuckDB SQL.

Not here: op1, op8 and op12 (tokenizer libraries), op4 (a fitted model), op6 (alignment of words on diagonals) and op7
(XXH64).
"""

from __future__ import annotations

from slicegrad.llm import divergence_rules as rules
from slicegrad.llm import mixing
from slicegrad.llm import phrase_graph
from slicegrad.llm import revisits
from slicegrad.llm import secret_scan as secrets

BLANK = r"\x20\x09-\x0D"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, source: str = "documents") -> str:
    """Rows ``doc_id, kind, start, stop, match`` of all matches of a pattern."""
    return f"""
      SELECT doc_id, {kind} AS kind, match, stop - length(match) AS start, stop FROM (
        SELECT doc_id, i, m[i] AS match,
               list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop
        FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), {quoted(pattern)}) AS m,
                 string_split_regex(coalesce(text, ''), {quoted(pattern)}) AS p
          FROM {source})))"""


def secret_scan_sql() -> str:
    allowed = secrets.ALLOWED.replace("(.)\\1{7,}|", "")  # no back references here; see the CASE below
    same = " OR ".join(f"contains(match, {quoted(c * 8)})" for c in secrets.CLASSES[1].alphabet)
    parts = []
    for number, kind in enumerate(secrets.CLASSES, 3):
        gains = "[" + ", ".join(map(str, kind.gains[1:])) + "]"
        parts.append(f"""
          SELECT doc_id, {number} AS kind, start + min(w) AS start, start + max(w) + {kind.window} AS stop FROM (
            SELECT doc_id, start, stop, w, sum(({gains})[n]) AS total FROM (
              SELECT doc_id, start, stop, w, substr(match, w + j, 1) AS c, count(*) AS n FROM (
                SELECT *, unnest(range(1, {kind.window + 1})) AS j FROM (
                  SELECT *, unnest(range(0, len(match) - {kind.window} + 1)) AS w FROM ({_spans(number, kind.pattern)})
                  WHERE regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]')
                    AND NOT regexp_matches(match, {quoted(allowed)}) AND NOT ({same})))
              GROUP BY ALL)
            GROUP BY ALL)
          WHERE total <= {kind.limit} GROUP BY doc_id, start, stop""")
    names = "[" + ", ".join(quoted(k) for k in secrets.KINDS) + "]"
    written = f"string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
      WITH base AS (
        SELECT doc_id, kind, start, stop FROM ({_spans(0, secrets.ASSIGN)})
        WHERE length(regexp_extract(match, {quoted(secrets.ASSIGN)}, 2)) >= {secrets.MIN_ASSIGNED}
        UNION ALL SELECT doc_id, kind, start, stop FROM ({_spans(1, secrets.ACCESS)})
        UNION ALL SELECT doc_id, kind, start, stop FROM ({_spans(2, secrets.HEX)})),
      added AS ({' UNION ALL '.join(parts)}),
      free AS (SELECT a.* FROM added a WHERE NOT EXISTS (
        SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start < a.stop AND a.start < b.stop)),
      totals AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1,
                        count(*) FILTER (kind = 2) AS n2, {written} AS s FROM base GROUP BY doc_id),
      every AS (SELECT doc_id, {written} AS s FROM (FROM base UNION ALL FROM free) GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
             sha256(coalesce(t.s, '')) AS base_sha256, coalesce(e.s, '') AS spans
      FROM documents d LEFT JOIN totals t USING (doc_id) LEFT JOIN every e USING (doc_id)"""


def mixing_sql() -> str:
    entries = f"range(0, {mixing.TABLE})"
    return f"""
      WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
      rates AS (SELECT source, pow(size::DOUBLE, 0.7) / (SELECT sum(pow(size::DOUBLE, 0.7)) FROM sizes)
                  * (SELECT sum(size)::DOUBLE FROM sizes) / size AS rate FROM sizes),
      drawn AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.STEP}))::INT AS parts FROM rates),
      steps AS (SELECT source, parts, k, exp(-rate / parts)
                  * list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, k + 1), lambda i: rate / parts / i)), lambda a, b: a * b) AS p
                FROM (SELECT *, unnest({entries}) AS k FROM drawn)),
      tables AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM (
                   SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps) GROUP BY source, parts),
      tagged AS (SELECT d.*, '1|' || doc_id || '|' || d.source AS tag, parts, cdf FROM documents d JOIN tables t ON d.source = t.source),
      counted AS (SELECT *, list_sum(list_transform(range(1, parts + 1), lambda k: len(list_filter(cdf, lambda c:
                    c <= ('0x' || substr(md5(tag || '|' || k), 1, 13))::BIGINT / {2**52}.0::DOUBLE)))) AS copies FROM tagged)
      SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('order|' || tag || '|' || copy) AS shuffle_key
      FROM (SELECT *, unnest(range(0, copies::BIGINT)) AS copy FROM counted)"""


def divergence_sql() -> str:
    text = "coalesce(text, '')"
    classes = [f"length(regexp_replace({text}, {quoted('[^' + inside + ']+')}, '', 'g'))" for inside in rules.CHAR_CLASSES.values()]
    listed = " ".join(
        f"WHEN lang = {quoted(name)} THEN [{', '.join(f'len(list_filter(low, lambda x: x = {quoted(w)}))' for w in words)}]"
        for name, words in rules.COMMON_WORDS.items()
    )
    bins = max(map(len, rules.COMMON_WORDS.values())) + 1
    sums = lambda column, n: "[" + ", ".join(f"sum({column}[{k + 1}])" for k in range(n)) + "]"

    def distance(p: str, q: str) -> str:
        part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((x.p + x.q) / 2)) ELSE 0 END"
        pairs = f"list_transform(list_zip({p}, {q}), lambda z: {{'p': z[1] / list_sum({p}), 'q': z[2] / list_sum({q})}})"
        return f"sqrt(greatest(0.0, list_sum(list_transform({pairs}, lambda x: ({part('x.p')} + {part('x.q')}) / 2))))"

    return f"""
      WITH cut AS (SELECT *, regexp_extract_all({text}, '[^{BLANK}]+') AS w,
                     list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '[^{BLANK}]')) AS lines FROM documents),
      grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
      inside AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (
                   SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM (
                     SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM grams) WHERE times > 1) GROUP BY doc_id),
      counts AS (SELECT doc_id, lang, len(w) AS n_words, length(regexp_replace({text}, '[{BLANK}]+', '', 'g')) AS word_chars,
                   length(regexp_replace({text}, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, length({text}) AS n_chars,
                   [{', '.join(classes)}] AS c, list_transform(w, lambda x: lower(x)) AS low FROM cut),
      hist AS (SELECT *, list_append(c, n_chars - list_sum(c)) AS chars, list_append(l, n_words - list_sum(l)) AS common
               FROM (SELECT *, CASE {listed} END AS l FROM counts)),
      refs AS (SELECT lang, {sums('chars', len(classes) + 1)} AS rc, {sums('common', bins)} AS rw FROM hist GROUP BY lang),
      far AS (SELECT h.*, coalesce(i.n, 0) AS n_repeat_words,
                CASE WHEN n_chars >= {rules.MIN_CHARS} THEN {distance('chars', 'rc')} ELSE 0 END AS dc,
                CASE WHEN n_words >= {rules.MIN_WORDS} AND common IS NOT NULL THEN {distance('common', 'rw')} ELSE 0 END AS dw
              FROM hist h JOIN refs r ON h.lang IS NOT DISTINCT FROM r.lang LEFT JOIN inside i ON i.doc_id = h.doc_id),
      judged AS (SELECT *, n_words < {rules.MIN_BASE_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM far)
      SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
             n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
             NOT base_failed AND dc <= {rules.MAX_CHAR_DISTANCE} AND dw <= {rules.MAX_WORD_DISTANCE} AS kept
      FROM judged"""


def line_runs_sql() -> str:
    key = lambda x: f"translate(regexp_replace(regexp_replace({x}, '^[{BLANK}]+', ''), '[{BLANK}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
      WITH lines AS (SELECT doc_id, i, l[i] AS line, {key('l[i]')} AS key FROM (
                       SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
                         SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
      frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
      FROM lines LEFT JOIN frequent f ON lines.key = f.key GROUP BY doc_id"""


def canonical_sql(url: str) -> str:
    scheme = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({url}, '{scheme}([^/?#]*)', 1)), ':(80|443)$', ''), '^www[.]', '')"
    path = f"regexp_replace(regexp_extract({url}, '{scheme}[^/?#]*([^?#]*)', 1), '/+$', '')"
    tracking = ", ".join(map(quoted, revisits.TRACKING))
    name = "lower(regexp_extract(p, '^([^=]*)', 1))"
    kept = f"list_sort(list_filter(string_split(regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND {name} NOT IN ({tracking}) AND NOT starts_with({name}, 'utm_')))"
    return f"{host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def revisits_sql() -> str:
    permitted = "[" + ", ".join(map(quoted, revisits.PERMITTED)) + "]"
    match = """coalesce(regexp_replace(r.h['etag'], '^W/', '') = regexp_replace(q.h['etag'], '^W/', ''),
                        r.h['last-modified'] = q.h['last-modified'], r.digest = q.digest)"""
    write = "array_to_string(list_transform(list_sort(map_keys({0})), lambda k: k || ': ' || {0}[k]), chr(10))"
    return f"""
      WITH visits AS (SELECT page_id, url, md5(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS size,
                        unnest(range(0, 1 + ('0x' || substr(md5(page_id::VARCHAR), 1, 4))::BIGINT % 5)) AS visit FROM pages),
      ways AS (SELECT *, CASE WHEN visit = 0 THEN 0 ELSE ('0x' || substr(md5(page_id || '-' || visit), 1, 4))::BIGINT % 6 END AS way FROM visits),
      tags AS (SELECT *, chr(34) || CASE WHEN way IN (1, 4) THEN md5(s || '-' || visit) ELSE s END || chr(34) AS tag,
                 MAP {{'date': 'day ' || visit, 'server': 's'}} AS plain FROM ways),
      captures AS (SELECT page_id * 8 + visit AS record_id, page_id * 60 + visit * 86400 AS ts, way < 2 AS f, s AS digest,
                     {canonical_sql('url')} AS url_key,
                     CASE WHEN way < 2 THEN map_concat(plain, MAP {{'etag': tag, 'last-modified': 'day 0', 'content-length': size::VARCHAR}})
                          WHEN way = 2 THEN map_concat(plain, MAP {{'etag': 'W/' || tag, 'connection': 'close'}})
                          WHEN way = 3 THEN map_concat(plain, MAP {{'last-modified': 'day 0'}})
                          WHEN way = 4 THEN map_concat(plain, MAP {{'etag': tag}}) ELSE plain END AS h FROM tags),
      full_ones AS (SELECT url_key, ts, max_by(record_id, record_id) AS record_id, max_by(h, record_id) AS h, max_by(digest, record_id) AS digest
                    FROM captures WHERE f GROUP BY url_key, ts),
      met AS (SELECT q.record_id, q.url_key, q.h AS qh, r.record_id AS rid, r.h AS rh, {match} AS ok
              FROM (FROM captures WHERE NOT f) q ASOF LEFT JOIN full_ones r ON q.url_key = r.url_key AND q.ts > r.ts),
      merged AS (SELECT *, map_from_entries(list_concat(
                   list_filter(map_entries(rh), lambda e: NOT (list_contains({permitted}, e.key) AND list_contains(map_keys(qh), e.key))),
                   list_filter(map_entries(qh), lambda e: list_contains({permitted}, e.key)))) AS merged_headers FROM met)
      SELECT record_id, url_key, CASE WHEN ok THEN rid END AS response_id,
             CASE WHEN rid IS NULL THEN 'no_response' WHEN ok IS NULL THEN 'no_validator' WHEN ok THEN 'resolved' ELSE 'mismatch' END AS outcome,
             CASE WHEN ok THEN {write.format("merged_headers")} ELSE {write.format('qh')} END AS headers
      FROM merged"""


def merkle_sql() -> str:
    field = lambda x: f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"
    leaf = lambda size: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", size, "text"))) + ")"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])"
    shift = "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"  # one bit of a CRC-32
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({digits})), {shift}), 4294967295::BIGINT)"
    above = "list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], '')))"
    step = lambda level, at: f"(({at} >> {level}) & 1)::VARCHAR || coalesce(nodes[xor({at} >> {level}, 1) + 1], '')"
    return f"""
      WITH RECURSIVE leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
          SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS shown
          FROM documents)),
      tree(lang, level, nodes) AS (
        SELECT lang, 0, list(leaf ORDER BY i) FROM leaves GROUP BY lang
        UNION ALL SELECT lang, level + 1, {above} FROM tree WHERE len(nodes) > 1),
      subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM tree WHERE len(nodes) = 1),
      crown(level, nodes) AS (
        SELECT 0, list(subroot ORDER BY g) FROM subroots
        UNION ALL SELECT level + 1, {above} FROM crown WHERE len(nodes) > 1),
      steps AS (
        SELECT lang, i, list(step ORDER BY height) AS steps FROM (
          SELECT l.lang, i, level AS height, {step('level', 'i')} AS step
          FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND len(nodes) > 1
          UNION ALL SELECT l.lang, i, 1000 + level, {step('level', 'g')}
          FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN crown ON len(nodes) > 1)
        GROUP BY lang, i),
      folded AS (
        SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM crown WHERE len(nodes) = 1) AS root,
               sha256(list_aggregate(list_transform(coalesce(steps, ['0']), lambda s: substr(s, 2)), 'string_agg', '')) AS proof_sha256,
               list_reduce(list_prepend(shown, coalesce(steps, [])), lambda h, s:
                 CASE WHEN s[1] = '0' THEN sha256(h || substr(s, 2)) ELSE sha256(substr(s, 2) || h) END) AS folded_root
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
        LEFT JOIN steps p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i)
      SELECT *, folded_root = root AS verified FROM folded"""


def phrases_sql() -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    first = lambda k: f"array_to_string(string_split(phrase, ' ')[1:{k}], ' ')"
    last = lambda k: f"array_to_string(string_split(phrase, ' ')[{k}:], ' ')"
    longest = phrase_graph.MAX_WORDS
    sides = " UNION ALL ".join(f"SELECT lang, m - 1 AS m, {side} AS phrase, f FROM candidates WHERE m > 2" for side in (first("m - 1"), last("2")))
    return f"""
      WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
      words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
      phrases AS (
        SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, {longest + 1})) AS m)) GROUP BY ALL),
      candidates AS (SELECT * FROM phrases WHERE m > 1 AND f >= {phrase_graph.MIN_COUNT}),
      covers AS ({sides}),
      free AS (SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM covers v WHERE v.lang = c.lang AND v.phrase = c.phrase AND 100 * v.f >= {phrase_graph.COVERED} * c.f)),
      cuts AS (SELECT lang, phrase, f AS a, k, {first('k')} AS head, {last('k + 1')} AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM free)),
      scored AS (
        SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score, k FROM cuts c
        JOIN phrases x ON x.lang = c.lang AND x.phrase = head JOIN phrases y ON y.lang = c.lang AND y.phrase = rest),
      weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
      SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
      FROM ranked JOIN (SELECT lang, sum(f) AS n FROM phrases WHERE m = 1 GROUP BY lang) USING (lang) WHERE rank <= {phrase_graph.TOP}"""


def all_queries() -> dict[str, str]:
    return {
        "op2_secret_scan": secret_scan_sql(),
        "op3_poisson_mixing": mixing_sql(),
        "op5_divergence_rules": divergence_sql(),
        "op9_line_runs": line_runs_sql(),
        "op10_revisits": revisits_sql(),
        "op11_merkle_manifest": merkle_sql(),
        "op13_phrase_graph": phrases_sql(),
    }

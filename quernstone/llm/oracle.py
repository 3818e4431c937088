"""DuckDB SQL for the queries of this subpackage, written from the contracts."""

from __future__ import annotations

import math

from quernstone.llm import divergence as div
from quernstone.llm import license_scans as lic
from quernstone.llm import mixing as mix
from quernstone.llm import quality_rules as q
from quernstone.llm import url_filters as url

SPACE = r"[^\x20\x09-\x0D]"


def _quality() -> str:
    step = "CASE " + " ".join(f"WHEN v < {top!r} THEN floor(v / {size!r}) * {size!r}" for top, size in q.STEPS[:-1]) + f" ELSE floor(v / {q.STEPS[-1][1]!r}) * {q.STEPS[-1][1]!r} END"
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {float(v)!r}" for r, v in q.RATIOS.items()) + " END"
    values = " UNION ALL ".join(f"SELECT l, s, '{r}' AS ratio, {r} AS v FROM m" for r in q.RATIOS)

    def level(name: str, keys: str) -> str:
        at = "quantile_disc(step, {})"
        low, high = at.format(0.25), at.format(0.75)
        return f"{name} AS (SELECT {keys}ratio, count(*) AS docs, {high} + {q.FENCE} * greatest({high} - {low}, CAST({least} AS DOUBLE)) AS fence FROM sk GROUP BY {keys}ratio)"

    drawn = lambda own, n, wider: f"({n} * {own} + {q.SHRINK} * {wider}) / ({n} + {q.SHRINK})"
    over = " OR ".join(f"m.{r} > (SELECT x FROM lim WHERE lim.l = m.l AND lim.s = m.s AND ratio = '{r}')" for r in q.RATIOS)
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{SPACE}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACE}')) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + {q.WINDOW - 1}) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {q.WINDOW - 1})) AS i FROM w WHERE len(w) > {q.WINDOW})),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS r FROM rep, (SELECT unnest(generate_series(0, {q.WINDOW - 1})) AS o) GROUP BY doc_id),
b AS (SELECT doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks
  FROM w LEFT JOIN cov USING (doc_id)),
m AS (SELECT doc_id, l, s, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
  CASE WHEN word_chars > 0 THEN up / word_chars ELSE 0.0 END AS upper_ratio,
  CASE WHEN n_words > 0 THEN marks / n_words ELSE 0.0 END AS mark_ratio,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS word_length FROM b),
v AS ({values}), sk AS (SELECT l, s, ratio, {step} AS step FROM v),
{level("g0", "l, s, ")}, {level("g1", "l, ")}, {level("g3", "")},
lim AS (SELECT g0.l, g0.s, g0.ratio, {drawn("g0.fence", "g0.docs", "(" + drawn("g1.fence", "g1.docs", "g3.fence") + ")")} AS x FROM g0 JOIN g1 ON g0.l = g1.l AND g0.ratio = g1.ratio JOIN g3 ON g0.ratio = g3.ratio)
SELECT m.* EXCLUDE (l, s), NOT base_failed AND NOT ({over}) AS kept FROM m
"""


def _license() -> str:
    kinds = lic.templates()
    words = ", ".join(f"({t}, {j}, '{x}', {k['key'][0] <= j < k['key'][1]})" for t, k in enumerate(kinds) for j, x in enumerate(k["words"]))
    heads = ", ".join(f"({t}, '{k['label']}', {len(k['words'])}, {len(k['words']) - k['wrong']}, {k['key'][1] - k['key'][0]}, {k['base']})" for t, k in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k(t, j, x, must) AS (VALUES {words}), h(t, label, size, need, keys, base) AS (VALUES {heads}),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
c AS (SELECT doc_id, t, i - j AS pos, count(*) AS same, count(*) FILTER (must) AS must FROM p JOIN k USING (x) GROUP BY ALL),
f AS (SELECT doc_id, label, base, pos, same / size AS score FROM c JOIN h USING (t) WHERE same >= need AND must = keys),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""


def _rank(name: str, a: str, b: str, verdict: str) -> str:
    """CTEs of one propagation over e(a, b, links) from p(host, own, n): the seeds' mass after k steps, summed over k."""
    steps = math.ceil(math.log(url.TOLERANCE) / math.log(url.DAMPING)) + url.STRIDE
    return f"""{name}e AS (SELECT {a} AS a, {b} AS b, links / sum(links) OVER (PARTITION BY {a}) AS share FROM e),
{name}k(k, host, mass) AS (SELECT 0, host, n / sum(n) OVER () FROM (SELECT host, sum(n) AS n FROM p WHERE own = '{verdict}' GROUP BY host)
  UNION ALL SELECT k + 1, b, sum({url.DAMPING} * share * mass) FROM {name}k JOIN {name}e ON a = host WHERE k < {steps} GROUP BY k, b),
{name} AS (SELECT host, round(sum({1 - url.DAMPING} * mass), {url.PLACES}) AS mass FROM {name}k GROUP BY host)"""


VERDICT = f"CASE WHEN distrust > {url.THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END"


def _url() -> str:
    fits = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(url.RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[2]} THEN '{x[k]}'" for x in fits) + " END"
    return f"""
WITH RECURSIVE l AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, 1 AS n, {case(0)} AS rule, {case(1)} AS own FROM l),
e AS (SELECT a, b, count(*) AS links FROM (SELECT host AS a, translate(unnest(regexp_extract_all(coalesce(html, ''), '{url.LINK.replace("'", "''")}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM l WHERE host <> '') WHERE a <> b GROUP BY ALL),
{_rank("t", "a", "b", "allow")}, {_rank("x", "b", "a", "block")},
v AS (SELECT p.*, coalesce(t.mass, 0) AS trust, coalesce(x.mass, 0) AS distrust FROM p LEFT JOIN t ON p.host = t.host LEFT JOIN x ON p.host = x.host)
SELECT page_id, host, path, rule, coalesce(own, {VERDICT}) AS verdict, trust, distrust FROM v
"""


TRADE = f"""
WITH RECURSIVE s AS (SELECT 'nation' || c_nationkey AS a, 'nation' || s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
e AS (SELECT a, b, count(*) AS links FROM s WHERE a <> b GROUP BY ALL),
p AS (SELECT 'nation' || c_nationkey AS host, 'allow' AS own, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
  UNION ALL SELECT 'nation' || s_nationkey, 'block', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1),
{_rank("t", "a", "b", "allow")}, {_rank("x", "b", "a", "block")},
v AS (SELECT host, coalesce(t.mass, 0.0) AS trust, coalesce(x.mass, 0.0) AS distrust FROM t FULL JOIN x USING (host))
SELECT host, trust, distrust, {VERDICT} AS verdict FROM v
"""


CHAT = """
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY place) AS turns FROM p GROUP BY conv_id),
pre AS (SELECT DISTINCT k, turns[1:k] AS start FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, n, turns FROM c GROUP BY n, turns),
m AS (SELECT kept.* FROM kept LEFT JOIN pre ON n = k AND turns = start WHERE k IS NULL),
o AS (SELECT conv_id, n, array_to_string(list_transform(turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.x || '<|end|>' || chr(10)), '') AS chat FROM m)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(length(chat) AS BIGINT) AS n_chars, chat FROM o
"""


def _mixing() -> str:
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    weight = f"[{', '.join(map(str, mix.WEIGHTS))}][rank % {len(mix.WEIGHTS)} + 1]"

    def inverse(schedule: tuple[float, ...]) -> str:
        own = mix.stretches(schedule)
        area = f"(part * {d(own[-1][1])})"
        root = lambda a, t, m, s: f"{d(t)} + CASE WHEN {area} > {d(a)} THEN 2.0::DOUBLE * ({area} - {d(a)}) / ({d(m)} + sqrt({d(m)} * {d(m)} + 2.0::DOUBLE * {d(s)} * ({area} - {d(a)}))) ELSE 0.0 END"
        when = " ".join(f"WHEN {area} < {d(b)} THEN {root(a, *rest)}" for a, b, *rest in own[:-1])
        return f"CASE {when} ELSE {root(own[-1][0], *own[-1][2:])} END"

    time = f"CASE rank % {len(mix.SCHEDULES)} " + " ".join(f"WHEN {k} THEN {inverse(x)}" for k, x in enumerate(mix.SCHEDULES)) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE}+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight, {mix.MAX_REPEATS} * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER x, 0) AS cap_before, coalesce(sum(weight) OVER x, 0) AS weight_before, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM w WINDOW x AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * (words - cap_before) > cap * (weights - weight_before) AS held FROM c),
t AS (SELECT *, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (words - coalesce(sum(cap) FILTER (held) OVER (), 0)) AS DOUBLE) / greatest(coalesce(sum(weight) FILTER (NOT held) OVER (), 0), 1) END AS target FROM f),
o AS (SELECT d.row, doc_id, d.source, size, source_size, rank, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT o.*, k * source_size + before AS begins, least(size, CAST(floor(target) AS BIGINT) - (k * source_size + before)) AS taken FROM o, range({mix.MAX_REPEATS}) AS r(k)),
p AS (SELECT *, CAST(begins AS DOUBLE) / target AS part FROM e WHERE taken > 0),
g AS (SELECT row, taken, coalesce(sum(taken) OVER (ORDER BY {time}, rank, begins ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
a AS (SELECT row, sum(taken) AS taken, min(start) AS start FROM g GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(a.taken, 0) AS BIGINT) AS taken, CAST(start AS BIGINT) AS first_start FROM o LEFT JOIN a USING (row)
"""


def _divergence() -> str:
    share = lambda n, total: f"1 + {div.SCALE} * (CAST({n} AS HUGEINT) + 2) // ({total} + 2 * v)"
    apart = "(p - q) * (p - q) // (p + q)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {div.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.*, coalesce(v, 0) AS v, coalesce(total, 0) AS total, coalesce(sum(total) OVER (PARTITION BY lang), 0) AS lang_total FROM g LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY 1) USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
f AS (SELECT lang, x.source, term, coalesce(n, 0) AS n, CASE WHEN v > 0 THEN {share("coalesce(n, 0)", "total")} END AS p, CASE WHEN v > 0 THEN {share("sum(coalesce(n, 0)) OVER (PARTITION BY lang, term)", "lang_total")} END AS q FROM x JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
y AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {apart} FROM f WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= {div.TOP}
"""


SQL: dict[str, str] = {"op1_license_scans": _license(), "op4_quality_rules": _quality(), "op6_chat_formatting": CHAT, "op10_url_filters": _url(), "op11_source_mixing": _mixing(), "op12_source_divergence": _divergence(), "host_rank_over_trade": TRADE}

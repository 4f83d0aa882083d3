"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import quality, sharding, urlfilter


def crc32_table() -> list[int]:
    """Remainders of all bytes, least significant bit first."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC32 = (
    "CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), "
    f"lambda c, b: xor(c >> 8, list_extract(CAST([{', '.join(map(str, crc32_table()))}] AS BIGINT[]), CAST(xor(c, b) & 255 AS INTEGER) + 1))), 4294967295) AS BIGINT)"
)


def shards(n: int = 24, seed: str = "interleave") -> str:
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 8 AS size, {_CRC32} AS text_crc32 FROM documents),
d AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', '{seed}', doc_id, text_crc32)), 1, 15) AS BIGINT) AS h FROM t),
r AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1 AS DOUBLE) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, h, doc_id, text_crc32, size) - 1 AS position, count(*) OVER () AS total FROM r),
s AS (SELECT *, position * {n} // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
    CAST(position - (shard * total + {n - 1}) // {n} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""


def rules() -> str:
    def listed(values) -> str:
        return ", ".join("'" + v + "'" for v in values)

    gone = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "white": "[\\x20\\x09-\\x0D]", "stop": "[.,;:!?''\"()-]", "symbol": "[#*$%&|<>]"}
    shown = ", ".join(f"('{f}', '{w}')" for w in quality.WORDS for f in dict.fromkeys((w, w.capitalize(), w.upper())))
    common = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in quality.COMMON.items() for i, w in enumerate(words))
    (c0, c1), (w0, w1) = quality.MAX_CHARACTER_DISTANCE, quality.MAX_WORD_DISTANCE
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
n AS (SELECT id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY id),
g AS (SELECT id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
q AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS k FROM g WHERE gram IS NOT NULL) WHERE k > 1),
rep AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM q, range(3) AS r(k) GROUP BY id),
l AS (SELECT id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY id),
c AS (SELECT id, length(t) AS size, {", ".join(f"{gone(p)} AS c_{k}" for k, p in classes.items())} FROM d),
m AS (SELECT d.id, doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, c_symbol AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN n USING (id) LEFT JOIN rep USING (id) LEFT JOIN l USING (id) JOIN c USING (id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM m),
ch AS (SELECT id, bin, k FROM (SELECT id, unnest([{", ".join(f"{{'bin': {i}, 'k': c_{k}}}" for i, k in enumerate(classes))},
    {{'bin': {len(classes)}, 'k': size - {" - ".join(f"c_{k}" for k in classes)}}}], recursive := true) FROM c)),
shown(form, word) AS (VALUES {shown}), common(ref, bin, word) AS (VALUES {common}),
cw AS (SELECT id, shown.word, count(*) AS k FROM w JOIN shown ON w.word = shown.form GROUP BY ALL),
own AS (SELECT id, ref, bin, k FROM cw JOIN common USING (word)),
lw AS (SELECT b.id, common.ref, common.bin, coalesce(own.k, 0) AS k FROM b CROSS JOIN common LEFT JOIN own ON own.id = b.id AND own.ref = common.ref AND own.bin = common.bin
    UNION ALL SELECT b.id, x.ref, 16, b.n_words - coalesce(s.k, 0) FROM b CROSS JOIN (SELECT DISTINCT ref FROM common) AS x LEFT JOIN (SELECT id, ref, sum(k) AS k FROM own GROUP BY ALL) AS s ON s.id = b.id AND s.ref = x.ref),
good AS (SELECT id, lang FROM b WHERE NOT base_failed AND lang IN ({listed(quality.COMMON)})),
rc AS (SELECT lang AS ref, bin, CAST(sum(k) AS DOUBLE) / sum(sum(k)) OVER (PARTITION BY lang) AS q FROM ch JOIN good USING (id) GROUP BY lang, bin),
rw AS (SELECT ref, bin, CAST(sum(k) AS DOUBLE) / sum(sum(k)) OVER (PARTITION BY ref) AS q FROM lw JOIN good ON good.id = lw.id AND good.lang = lw.ref GROUP BY ref, bin),
pc AS (SELECT id, ref, k / nullif(sum(k) OVER (PARTITION BY id, ref), 0) AS p, q FROM ch JOIN rc USING (bin)),
pw AS (SELECT id, ref, k / nullif(sum(k) OVER (PARTITION BY id, ref), 0) AS p, q FROM lw JOIN rw USING (ref, bin)),
jc AS (SELECT id, ref, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS far FROM pc GROUP BY ALL),
jw AS (SELECT id, ref, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS far FROM pw GROUP BY ALL),
v AS (SELECT b.id, bool_or((b.word_chars < {quality.MIN_CHARACTERS} OR jc.far <= {c0} + {c1} / sqrt(b.word_chars)) AND (b.n_words < {quality.MIN_WORDS_COMPARED} OR jw.far <= {w0} + {w1} / sqrt(b.n_words))) AS near
    FROM b JOIN jc USING (id) JOIN jw ON jw.id = b.id AND jw.ref = jc.ref WHERE NOT b.base_failed GROUP BY b.id)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (coalesce(near, NOT EXISTS (SELECT 1 FROM good)) OR (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM good))) AS kept
FROM b LEFT JOIN v USING (id)"""


def urls() -> str:
    u = urlfilter
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in u.RULES)
    words = ", ".join(f"'{w}'" for w in u.UNWANTED)
    crc = _CRC32.replace("coalesce(text, '')", "host")
    steps, known = [], []
    for n in range(1, u.ORDER + 2):
        low = f"JOIN t{n - 1} AS s ON s.fold = k.fold AND s.gram = substr(k.gram, 2)" if n > 1 else ""
        pa, pr = ("s.p_a", "s.p_r") if n > 1 else (f"{1.0 / u.ALPHABET}", f"{1.0 / u.ALPHABET}")
        steps.append(f"""p{n} AS (SELECT k.fold, k.gram, {pa} AS low_a, {pr} AS low_r,
    coalesce((k.a + c.a_kinds * {pa}) / nullif(CAST(c.a_n + c.a_kinds AS DOUBLE), 0), {pa}) AS p_a, coalesce((k.r + c.r_kinds * {pr}) / nullif(CAST(c.r_n + c.r_kinds AS DOUBLE), 0), {pr}) AS p_r
    FROM kept AS k JOIN sums AS c ON c.fold = k.fold AND c.context = substr(k.gram, 1, {n - 1}) {low} WHERE length(k.gram) = {n}),
t{n} AS (SELECT *, CAST(round((ln(p_a / p_r) - ln(low_a / low_r)) * {u.UNIT}) AS BIGINT) AS known FROM p{n}),""")
        known.append(f"SELECT fold, gram, known FROM t{n}")
    weight = lambda c: f"coalesce(CAST({c}_kinds AS DOUBLE) / nullif({c}_n + {c}_kinds, 0), 1.0)"
    return rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {rules}),
x AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS found, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
y AS (SELECT *, translate(found, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h),
f AS (SELECT id, arg_max(action, length(rule_host || rule_path)) AS action, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule
    FROM y JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY id),
z AS (SELECT y.*, action, rule, host || substr(rest, length(found) + 1) AS text FROM y LEFT JOIN f USING (id)),
e AS (SELECT DISTINCT text, host, CAST(regexp_matches(host, '(^|[.-])({"|".join(u.UNWANTED)})([.-]|$)') OR coalesce(action = 'block', false) AS INTEGER) AS r FROM z WHERE text <> ''),
texts AS (SELECT text, r, 1 - r AS a, {crc} % 2 AS fold FROM e),
learned AS (SELECT text, 1 - fold AS fold, a, r FROM texts UNION ALL SELECT unnest([{words}]), f.f, 0, {u.WORD_COUNT} FROM range(2) AS f(f)),
cut AS (SELECT *, chr(2) || text AS t FROM learned),
learned_grams AS (SELECT fold, a, r, substr(t, i - n + 1, n) AS gram FROM (SELECT *, unnest(range(1, least(i, {u.ORDER + 1}) + 1)) AS n FROM (SELECT *, unnest(range(2, length(t) + 1)) AS i FROM cut))),
kept AS (SELECT fold, gram, sum(a) AS a, sum(r) AS r FROM learned_grams GROUP BY ALL HAVING sum(a + r) >= {u.MIN_COUNT}),
sums AS (SELECT fold, substr(gram, 1, length(gram) - 1) AS context, sum(a) AS a_n, sum(CAST(a > 0 AS INTEGER)) AS a_kinds, sum(r) AS r_n, sum(CAST(r > 0 AS INTEGER)) AS r_kinds FROM kept GROUP BY ALL),
{"".join(steps)}
known AS ({" UNION ALL ".join(known)}),
lost AS (SELECT fold, context, CAST(round(ln({weight("a")} / {weight("r")}) * {u.UNIT}) AS BIGINT) AS unknown FROM sums),
grams AS (SELECT text, a, fold, substr(t, i - n + 1, n) AS gram FROM (SELECT *, unnest(range(1, least(i, {u.ORDER + 1}) + 1)) AS n FROM (SELECT *, unnest(range(2, length(t) + 1)) AS i FROM (SELECT *, chr(2) || text AS t FROM texts)))),
scores AS (SELECT text, any_value(g.a) AS a, CAST(floor(CAST(sum(coalesce(known, unknown, 0)) AS DOUBLE) / length(text)) AS BIGINT) AS score
    FROM grams AS g LEFT JOIN known ON known.fold = g.fold AND known.gram = g.gram LEFT JOIN lost ON lost.fold = g.fold AND lost.context = substr(g.gram, 1, length(g.gram) - 1) GROUP BY text),
hist AS (SELECT CAST(floor(score / {u.UNIT // 1000}.0) AS BIGINT) AS cell, count(*) AS n FROM scores WHERE a > 0 GROUP BY 1),
lim AS (SELECT min(cell) * {u.UNIT // 1000} AS least FROM (SELECT cell, sum(n) OVER (ORDER BY cell) AS upto, sum(n) OVER () AS total FROM hist) WHERE upto > {u.MAX_FALSE_REJECTS} * total)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN score < (SELECT least FROM lim) THEN 'block' END, 'allow') AS verdict FROM z LEFT JOIN scores USING (text)"""


SQL = {"op1_quality": rules(), "op4_urls": urls(), "op10_sharding": shards()}

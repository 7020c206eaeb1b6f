"""DuckDB SQL of the queries that SQL can express: other formulas than the operators' where there are any."""

from __future__ import annotations

from .secretscan import ALPHABET, KINDS, LEAST

#: Patterns for RE2: letters in either case are spelled out, as its folding knows more than ASCII; leftmost matches of runs begin where runs do.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""({_WORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_REPEATED = "|".join(("[" + c + c.upper() + "]" if c.isalpha() else "[" + c + "]") + "{8,256}" for c in ALPHABET if not c.isupper())
_CUT = f"(?i).{{0,40}}example.{{0,40}}|abcdefgh|01234567|{_REPEATED}"
_BEFORE = """(?i)(sha-?(1|224|256|384|512)|md5|blake2b?|checksum|digest|integrity|commit|etag|uuid|https?://[^\\s]*)[\\s:="''(\\[#@-]*$"""


def _part(rank: int, kind: str, pattern: str, group: int = 0) -> str:
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d WHERE regexp_matches(t, '{pattern}')"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({_part(0, 'assign', _ASSIGN, 2)} UNION ALL {_part(1, 'access', 'AKIA[A-Z0-9]+')} UNION ALL {_part(2, 'hex', '[0-9a-f]+')} UNION ALL {_part(3, 'run', '[A-Za-z0-9+/_=-]{20,}')}),
u AS (SELECT doc_id, rank, kind, unnest(range(1, len(m) + 1)) AS i, unnest(p[:len(m)]) AS part, unnest(m) AS m, unnest(g) AS g FROM p),
s AS (SELECT *, sum(length(part) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM u),
base AS (SELECT doc_id, rank, kind, e - length(m) AS s, e FROM s WHERE CASE rank WHEN 0 THEN length(g) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 2 THEN length(m) >= 24 ELSE false END),
cand AS (SELECT doc_id, m, e - length(m) AS s, e FROM s WHERE rank = 3 AND NOT regexp_full_match(m, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AND NOT regexp_matches(right(part, 40), '{_BEFORE}')),
free AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s <= c.s AND b.e >= c.e)),
cut AS (SELECT doc_id, s, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS p, unnest(list_concat(m, [''])) AS m FROM (SELECT doc_id, s, string_split_regex(m, '{_CUT}') AS p, regexp_extract_all(m, '{_CUT}', 0) AS m FROM free)),
own AS (SELECT doc_id, s + sum(length(p) + length(m)) OVER (PARTITION BY doc_id, s ORDER BY i) - length(p) - length(m) AS s, p FROM cut),
pc AS (SELECT doc_id, s, length(p) AS n, b, substr(p, b * 64 + 1, 83) AS x FROM (SELECT *, unnest(range(0, (length(p) - 20) // 64 + 1)) AS b FROM own WHERE length(p) >= 20)),
cl AS (SELECT *, CASE WHEN NOT regexp_matches(x, '[0-9]') OR NOT regexp_matches(x, '[A-Za-z]') THEN NULL WHEN regexp_full_match(x, '[0-9a-f]+|[0-9A-F]+') THEN 3 WHEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') THEN 4 WHEN regexp_full_match(x, '[a-z0-9=]+') THEN 5 WHEN regexp_full_match(x, '[A-Z0-9=]+') THEN 6 END AS rank FROM pc),
best AS (SELECT doc_id, s, n, b, rank, max(list_entropy(string_split(w, ''))) AS h FROM (SELECT *, substr(x, unnest(range(1, length(x) - 18)), 20) AS w FROM cl WHERE rank IS NOT NULL) GROUP BY ALL),
hit AS (SELECT *, b - row_number() OVER (PARTITION BY doc_id, s, rank ORDER BY b) AS island FROM best WHERE h >= [{', '.join(repr(LEAST[k]) for k in KINDS[3:])}][rank - 2]),
span AS (SELECT doc_id, rank, s + min(b) * 64 AS s, least(s + max(b) * 64 + 83, s + n) AS e FROM hit GROUP BY doc_id, hit.s, n, rank, island),
al AS (SELECT doc_id, rank, kind, s, e FROM base UNION ALL SELECT doc_id, rank, [{', '.join(f"'{k}'" for k in KINDS[3:])}][rank - 2], s, e FROM span c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s <= c.s AND b.e >= c.e)),
g AS (SELECT doc_id, count_if(rank = 0) AS n_assign, count_if(rank = 1) AS n_access, count_if(rank = 2) AS n_hex, string_agg(CASE WHEN rank < 3 THEN concat(kind, ':', s, ':', e) END, ',' ORDER BY s, rank) AS b, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) AS a FROM al GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, nr, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT nr) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM x JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM s WHERE part = 'pair' OR rank <= 10
"""


def _merkle(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves, level by level, by self joins of each level's runs."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    step = "CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END"
    bits = "x"
    for _ in range(8):
        bits = step.replace("crc", f"({bits})") if bits == "x" else f"list_transform([{bits}], lambda crc: {step})[1]"
    table = f"(SELECT list({bits} ORDER BY x) AS t FROM (SELECT unnest(range(256)) AS x))"
    digit = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1]))"
    out = [
        f"crc AS MATERIALIZED {table}",
        f"d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN xor({digit}, 4294967295) % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS own FROM documents, crc)",
        "i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "a0 AS MATERIALIZED (SELECT tree, idx, leaf AS h, n FROM i)",
    ]
    up = lambda k, x: out.append(f"{x}{k + 1} AS MATERIALIZED (SELECT tree, idx // 8 AS idx, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY {x}{k}.idx)) END AS h, (n + 7) // 8 AS n FROM {x}{k} GROUP BY tree, {x}{k}.idx // 8, n)")
    for k in range(levels):
        up(k, "a")
    out.append(f"b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, h, count(*) OVER () AS n FROM a{levels})")
    for k in range(levels):
        up(k, "b")
    out.append("f0 AS MATERIALIZED (SELECT doc_id, tree AS lang_tree, tree, idx, leaf, own AS v, '' AS proof FROM i)")
    at = 0
    for x in "ab":
        for k in range(levels):
            beside = f"SELECT s.tree, s.idx, s.n, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < s.idx), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > s.idx), '') AS r FROM {x}{k} s JOIN {x}{k} o ON s.tree = o.tree AND s.idx // 8 = o.idx // 8 GROUP BY s.tree, s.idx, s.n"
            out.append(f"f{at + 1} AS MATERIALIZED (SELECT f.doc_id, f.lang_tree, f.tree, f.idx // 8 AS idx, f.leaf, CASE WHEN n = 1 THEN v ELSE sha256(l || v || r) END AS v, proof || l || r AS proof FROM f{at} f JOIN ({beside}) USING (tree, idx))")
            at += 1
        if x == "a":
            out.append(f"f{at + 1} AS MATERIALIZED (SELECT doc_id, lang_tree, 0 AS tree, lang_tree AS idx, leaf, v, proof FROM f{at})")
            at += 1
    return "WITH " + ",\n".join(out) + f"\nSELECT f.doc_id, f.leaf, a.h AS subroot, b.h AS root, sha256(f.proof) AS proof_sha256, f.v AS folded_root, f.v = b.h AS verified FROM f{at} f JOIN a{levels} a ON a.tree = f.lang_tree, b{levels} b"


MERKLE = _merkle()

"""DuckDB SQL giving the same rows as the named queries that SQL can express, by direct computation.

None for shards (their order inside a subdivided group is a hash SQL has not), passages, licenses
and the tokenizer queries; tests compare those with plain Python and the tokenizer library.
"""

from __future__ import annotations

from vecsnap.llm.quality import ACCURACY, PRIOR, ROUNDS, THRESHOLD
from vecsnap.llm.secrets import BASE, OWNERS, REPOSITORIES, WIDE

DOCS = r"""d AS (SELECT doc_id, source, coalesce(text,'') t, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') w
  FROM documents)"""

MIX = f"""WITH {DOCS},
k AS (SELECT doc_id, source, len(w)::BIGINT size, md5(concat_ws(':', '7', doc_id, t)) h FROM d),
s AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 nr FROM k GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE*source_size cap, [5,2,1][nr%3+1]::DOUBLE weight, 1.5::DOUBLE*sum(source_size) OVER () total FROM s),
l AS (SELECT a.source, (any_value(a.total) - coalesce(sum(b.cap) FILTER (b.cap/b.weight < a.cap/a.weight), 0))
        / sum(b.weight) FILTER (b.cap/b.weight >= a.cap/a.weight) AS lev, any_value(a.cap/a.weight) ratio FROM c a, c b GROUP BY a.source),
f AS (SELECT max(lev) FILTER (lev <= ratio) fill FROM l),
g AS (SELECT source, source_size, nr, CASE WHEN fill IS NULL THEN cap ELSE least(cap, weight*fill) END target FROM c, f),
p AS (SELECT k.*, g.source_size, g.target, g.nr, sum(k.size) OVER (PARTITION BY k.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE
        - k.size/2.0::DOUBLE mid FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
a AS (SELECT *, size > 0 AND mid < target one, size > 0 AND mid + source_size < target two,
        mid/target s1, (mid + source_size)/target s2 FROM p)
SELECT doc_id, size, source_size, target, (size*(one::INT + two::INT))::BIGINT taken,
  CASE WHEN one THEN {{one}} WHEN two THEN {{two}} END first_position, CASE WHEN one AND two THEN {{two}} END next_position
FROM a"""


def _place(s: str) -> str:
    """Inverse of the falling, level and rising schedules' integrals."""
    rising = f"""CASE WHEN 0.99*{s} <= 0.48 THEN 2*0.99*{s}/(0.5+sqrt(0.25+2*0.99*{s}))
      ELSE 0.6 + 2*(0.99*{s}-0.48)/(1.1+sqrt(1.21+1.75*(0.99*{s}-0.48))) END"""
    return f"round(least(CASE nr%3 WHEN 0 THEN 2*{s}/(1.5+sqrt(2.25-2*{s})) WHEN 1 THEN {s} ELSE {rising} END, 1)::DOUBLE, 9)"


JACCARD = rf"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') w FROM documents),
t AS (SELECT doc_id, unnest(w) a, generate_subscripts(w, 1) i FROM d WHERE len(w) > 4),
f AS (SELECT doc_id, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) x, lead(a, 4) OVER o z
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM f WHERE z IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(x) s FROM d LEFT JOIN g USING (doc_id) GROUP BY doc_id),
h AS MATERIALIZED (SELECT * FROM g WHERE x IN (SELECT x FROM g GROUP BY x HAVING count(*) > 1)),
p AS MATERIALIZED (SELECT a.doc_id u, b.doc_id v, count(*) k FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100*k >= 80*(a.s+b.s-k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.root FROM r JOIN e ON r.doc_id = e.u)
SELECT doc_id, s n_shingles, component_id FROM n JOIN (SELECT doc_id, min(root) component_id FROM r GROUP BY 1) USING (doc_id)"""

EXACT = """WITH t AS (SELECT doc_id, coalesce(text,'') t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 kept, sha256(t) text_sha256 FROM t"""


def _secrets() -> str:
    """Every pattern's matches, placed by the lengths before them, then the rules on whole tables."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE + WIDE):
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""SELECT doc_id, source, {rank} AS rank, '{kind}' kind, hit, val, gap, i, {least} AS least FROM (SELECT doc_id, source,
  unnest(regexp_extract_all(t, {p})) hit, unnest(regexp_extract_all(t, {p}, {group})) val,
  unnest(string_split_regex(t, {p})[1:len(regexp_extract_all(t, {p}))]) gap,
  generate_subscripts(regexp_extract_all(t, {p}), 1) i FROM d WHERE regexp_matches(t, {p}))""")
    matches = "\nUNION ALL ".join(found)
    over = "a.doc_id = b.doc_id AND b.start < a.stop AND a.start < b.stop"
    looks = ("regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND "
             "(regexp_matches(val, '[A-Z]') OR regexp_matches(val, '^[0-9a-f]+$'))")  # fmt: skip
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k, *_ in BASE)
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text,'') t FROM documents),
m AS ({matches}),
x AS (SELECT *, start + len(hit) stop, {looks} random FROM (SELECT *, (sum(len(gap) + len(hit))
  OVER (PARTITION BY doc_id, rank ORDER BY i) - len(hit))::BIGINT AS start FROM m) WHERE len(val) >= least),
b AS (SELECT * FROM x WHERE rank < 3),
o AS (SELECT * FROM x a WHERE rank = 3 AND NOT EXISTS (FROM b WHERE {over})),
q AS (SELECT * FROM b UNION ALL SELECT * FROM o),
y AS (SELECT * FROM q UNION ALL SELECT * FROM x a WHERE rank = 4 AND random AND NOT EXISTS (FROM q b WHERE {over})),
w AS (SELECT val, count(DISTINCT owner) owners, count(*) places FROM
  (SELECT DISTINCT val, coalesce('s' || source, '') owner, doc_id FROM y) GROUP BY val),
z AS (SELECT y.*, owners, places, random AND owners <= {OWNERS} AND places <= {REPOSITORIES} * owners live FROM y JOIN w USING (val)),
r AS (SELECT doc_id, {counts}, {text} FILTER (rank < 3) base, {text} FILTER (rank < 3 OR live) spans,
  count(*) FILTER (live) n_live, count(*) FILTER (NOT live) n_example, max(owners) n_owners, max(places) n_repositories FROM z GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) n_{k}' for k, *_ in BASE)}, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example,
  coalesce(n_owners, 0) n_owners, coalesce(n_repositories, 0) n_repositories FROM d LEFT JOIN r USING (doc_id)"""


def _quality() -> str:
    """Features by unnesting, then the rounds of expectation-maximisation as a recursion."""
    def clamp(x: str, bounds) -> str:
        return f"least({bounds[1]}, greatest({bounds[0]}, {x}))::DOUBLE"

    score = " + ".join(f"v{i}*ln(a{i}/(1-a{i}))" for i in range(5))
    p = f"1/(1+exp(-(ln(prior/(1-prior)) + {score})))"
    votes = ", ".join(f"v{i}" for i in range(5))
    new = ", ".join(
        f"CASE WHEN sum(n) FILTER (v{i}<>0) > 0 THEN "
        + clamp(f"sum(n*CASE WHEN v{i}>0 THEN p ELSE 1-p END) FILTER (v{i}<>0)/sum(n) FILTER (v{i}<>0)", ACCURACY)
        + f" ELSE any_value(a{i}) END"
        for i in range(5)
    )

    def vote(x: str, bad: str, good: str) -> str:
        return f"CASE WHEN ({x}) IS NULL THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"

    return rf"""WITH RECURSIVE {DOCS},
i AS MATERIALIZED (SELECT row_number() OVER () row, doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines FROM d),
u AS (SELECT row, unnest(w) a, generate_subscripts(w, 1) j FROM i WHERE len(w) > 2),
g AS (SELECT row, j, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o) x, lead(a, 2) OVER o z FROM u
  WINDOW o AS (PARTITION BY row ORDER BY j)),
h AS (SELECT row, j FROM (SELECT *, count(*) OVER (PARTITION BY row, x) c FROM g WHERE z IS NOT NULL) WHERE c > 1),
k AS (SELECT row, count(DISTINCT j + o.o) n FROM h, range(3) o(o) GROUP BY row),
f AS (SELECT row, doc_id, len(w)::BIGINT n_words, length(array_to_string(w, '')) word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(lines) n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(n, 0) n_repeat_words FROM i LEFT JOIN k USING (row)),
e AS (SELECT *, word_chars::DOUBLE/nullif(n_words,0) x1, n_symbols::DOUBLE/nullif(n_words,0) x2,
  n_dup_lines::DOUBLE/nullif(n_lines,0) x3, n_repeat_words::DOUBLE/nullif(n_words,0) x4 FROM f),
v AS (SELECT *, {vote('n_words', 'n_words < 50', 'n_words >= 80')} v0, {vote('x1', 'x1 < 2.5 OR x1 > 12', 'x1 BETWEEN 3.5 AND 9')} v1,
  {vote('x2', 'x2 > 0.1', 'x2 < 0.03')} v2, {vote('x3', 'x3 > 0.3', 'x3 < 0.1')} v3, {vote('x4', 'x4 > 0.3', 'x4 < 0.15')} v4 FROM e),
c AS (SELECT {votes}, count(*)::DOUBLE n FROM v GROUP BY ALL),
em(k, prior, a0, a1, a2, a3, a4) AS (SELECT 0, 0.8::DOUBLE, 0.8::DOUBLE, 0.8::DOUBLE, 0.8::DOUBLE, 0.8::DOUBLE, 0.8::DOUBLE
  UNION ALL SELECT k+1, {clamp('sum(n*p)/sum(n)', PRIOR)}, {new} FROM (SELECT *, {p} p FROM em, c WHERE k < {ROUNDS}) GROUP BY k),
z AS (SELECT *, 100*n_repeat_words > 50*n_words OR n_words < 50 base_failed, round({p}, 9) p_good FROM v, em WHERE k = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good,
  NOT base_failed AND p_good >= {THRESHOLD} kept FROM z"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": MIX.format(one=_place("s1"), two=_place("s2")),
        "op2_jaccard": JACCARD,
        "op7_exact_dedup": EXACT,
        "op8_secrets": _secrets(),
        "op10_quality": _quality(),
    }

"""DuckDB SQL giving the same answers as the named queries, by direct computation."""

from __future__ import annotations

import math

import numpy as np

from vecsnap.codecs.direction import DirectionCodec
from vecsnap.codecs.graphcode import vertices
from vecsnap.codecs.scalar import orthogonal_matrix
from vecsnap.functions.bits import generator_words
from vecsnap.kernels.lattice import e8_codebook

LOG2_IDS = math.log2(240)


def _list(values) -> str:
    return "[" + ",".join(repr(float(v)) for v in values) + "]"


def _book(matrix) -> str:
    return "VALUES " + ",".join(f"({i},{_list(row)})" for i, row in enumerate(matrix))


CODEBOOK = f"cb(id, c) AS ({_book(e8_codebook())})"

RAW = "e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings)"


def chain(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def blocks_raw(factor: str = "1.0") -> str:
    """Plain 8-blocks times a factor: r0(vec_id, label, b, m, x)."""
    return f"""{RAW},
r0 AS (SELECT vec_id, label, t.b::INT b, 1.0 m, list_transform(v[t.b*8+1:t.b*8+8], lambda q: q*{factor}) x
       FROM e, range(8) t(b))"""


def blocks_block() -> str:
    """8-blocks centred and scaled by their own moments."""
    return f"""{RAW},
p AS (SELECT vec_id, label, t.b::INT b, v[t.b*8+1:t.b*8+8] y FROM e, range(8) t(b)),
pm AS (SELECT *, list_avg(y) mu, list_stddev_pop(y)+1e-12 sd FROM p),
r0 AS (SELECT vec_id, label, b, sd m, list_transform(y, lambda q: (q-mu)/sd) x FROM pm)"""


def blocks_gain(width: int) -> str:
    """Row-standardized blocks divided by the deviation of their ``width``-block."""
    per = width // 8
    return f"""{RAW},
g AS (SELECT *, list_avg(v) gm, list_stddev_pop(v)+1e-12 gs FROM e),
z AS (SELECT vec_id, label, gs, list_transform(v, lambda q: (q-gm)/gs) z FROM g),
w AS (SELECT vec_id, label, gs, t.i i, z[t.i*{width}+1:t.i*{width}+{width}] zz FROM z, range({64 // width}) t(i)),
wl AS (SELECT *, list_stddev_pop(zz)+1e-12 ls FROM w),
r0 AS (SELECT vec_id, label, (i*{per}+t.j)::INT b, gs*ls m,
              list_transform(zz[t.j*8+1:t.j*8+8], lambda q: q/ls) x
       FROM wl, range({per}) t(j))"""


def fitted_scale(i: int, where: str = "TRUE") -> str:
    return f"s{i} AS (SELECT 100.0/(sqrt(sum(list_dot_product(x,x))/(8*count(*)))+1e-15) s FROM r{i} WHERE {where})"


def given_scale(i: int, value: float) -> str:
    return f"s{i} AS (SELECT {value!r}::DOUBLE s)"


def stage(i: int) -> str:
    """r{i} at scale s{i} -> r{i+1} with the lattice point ``q`` and the next residual."""
    return f"""
t{i} AS (SELECT r{i}.vec_id, r{i}.label, r{i}.b, r{i}.m, r{i}.x, s, list_transform(r{i}.x, lambda q: q*s) t FROM r{i}, s{i}),
a{i} AS (SELECT *, list_transform(t, lambda q: round_even(q::DOUBLE,0)) y0,
                   list_transform(t, lambda q: round_even((q-0.5)::DOUBLE,0)) y1 FROM t{i}),
d{i} AS (SELECT *, list_transform(range(1,9), lambda k: abs(t[k]-y0[k])) g0,
                   list_transform(range(1,9), lambda k: abs((t[k]-0.5)-y1[k])) g1 FROM a{i}),
f{i} AS (SELECT *, list_position(g0, list_max(g0)) i0, list_position(g1, list_max(g1)) i1,
                (list_sum(y0)::BIGINT % 2) <> 0 o0, (list_sum(y1)::BIGINT % 2) <> 0 o1 FROM d{i}),
c{i} AS (SELECT *,
   list_transform(range(1,9), lambda k: y0[k] + CASE WHEN o0 AND k=i0 THEN CASE WHEN t[k]-y0[k]<0 THEN -1 ELSE 1 END ELSE 0 END) q0,
   list_transform(range(1,9), lambda k: y1[k] + 0.5 + CASE WHEN o1 AND k=i1 THEN CASE WHEN (t[k]-0.5)-y1[k]<0 THEN -1 ELSE 1 END ELSE 0 END) q1
   FROM f{i}),
n{i} AS (SELECT *, CASE WHEN list_sum(list_transform(range(1,9), lambda k: (t[k]-q1[k])*(t[k]-q1[k])))
                         < list_sum(list_transform(range(1,9), lambda k: (t[k]-q0[k])*(t[k]-q0[k])))
                   THEN q1 ELSE q0 END q FROM c{i}),
r{i + 1} AS (SELECT vec_id, label, b, m, q, x x_before, list_transform(range(1,9), lambda k: x[k]-q[k]/s) x FROM n{i})"""


def signal() -> str:
    return "sig AS (SELECT vec_id, list_dot_product(v,v) p FROM e)"


def code_entropy_of(i: int, out: str, where: str = "TRUE") -> str:
    return f"""{out} AS (SELECT log2(sum(c)) - sum(c*log2(c))/sum(c) h, sum(c) n, count(*) d
  FROM (SELECT q, count(*)::DOUBLE c FROM r{i} WHERE {where} GROUP BY q))"""


def by_label(rebuilt: str, floor: str = "greatest(noise/n, 1e-30)") -> str:
    """Fidelity per label from ``rebuilt(vec_id, r)`` and the vectors ``e``."""
    return f""",
fr AS (SELECT label, list_dot_product(v,v) p,
   list_sum(list_transform(range(1,65), lambda k: (v[k]-r[k])*(v[k]-r[k]))) noise,
   list_dot_product(v,r)/((sqrt(list_dot_product(v,v))+1e-12)*(sqrt(list_dot_product(r,r))+1e-12)) c
   FROM e JOIN {rebuilt} USING (vec_id)),
fs AS (SELECT label, count(*) n_vectors, sum(p) p, sum(noise) noise, 64*count(*) n, avg(c) c FROM fr GROUP BY label)
SELECT label, n_vectors, round(10*log10((p/n)/({floor})),6) snr_db, round(c,6) cosine FROM fs"""


def rebuild_from_residual(i: int) -> str:
    """Reconstruction = original - multiplier * residual, block by block in order."""
    return f"""
rb AS (SELECT vec_id, flatten(list(list_transform(x, lambda q: q*m) ORDER BY b)) d FROM r{i} GROUP BY vec_id),
rec AS (SELECT vec_id, list_transform(range(1,65), lambda k: v[k]-d[k]) r FROM e JOIN rb USING (vec_id))"""


SCALAR3 = f"""{RAW},
lg AS (SELECT vec_id, t.k::INT k, v[t.k] x FROM e, range(1,65) t(k)),
mm AS (SELECT k, min(x) lo, max(x)-min(x)+1e-9 w FROM lg GROUP BY k),
rec AS (SELECT vec_id, list(lo+(least(greatest(floor((x-lo)/w*8),0),7)+0.5)/8*w ORDER BY k) r
        FROM lg JOIN mm USING (k) GROUP BY vec_id)"""

LABEL_MEANS = """
ml AS (SELECT label, t.k::INT k, avg(v[t.k]) a FROM e, range(1,65) t(k) GROUP BY ALL),
probes AS (SELECT label::BIGINT q_id, list(a ORDER BY k) q FROM ml GROUP BY label)"""

CUSTOMERS = "m AS (SELECT DISTINCT o_custkey s, l_suppkey x FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"
MEMBERS = "m AS (SELECT DISTINCT l_orderkey s, l_partkey x FROM lineitem)"
GRAPH = """ed AS (SELECT DISTINCT least(l_partkey,(-l_suppkey-1)) a, greatest(l_partkey,(-l_suppkey-1)) b FROM lineitem WHERE l_partkey<>(-l_suppkey-1)),
lk AS (SELECT a v, b w FROM ed UNION ALL SELECT b, a FROM ed)"""


def _budget_rate(kind: str) -> str:
    """Two-stage sparse / dual codec at 3 bits per dimension: masked second stage."""
    meta = (32 + 8 * 4 + 8) / 64 if kind == "sparse" else (32 + 8 * 2 + 8) / 64
    if kind == "sparse":
        share = f"(3.0-{meta}-h0.h/8)/(h1.h/8)"
        density = f"least(1.0, {share})"
    else:
        density = f"greatest(0.1, (3.0-{meta}-h0.h/8)/(h1.h/8))"
    return (
        chain(
            blocks_gain(16 if kind == "sparse" else 32), fitted_scale(0), stage(0), fitted_scale(1), stage(1),
            code_entropy_of(1, "h0"), code_entropy_of(2, "h1"),
            f"den AS (SELECT {density} d FROM h0, h1)",
            "en AS (SELECT vec_id, b, list_dot_product(x,x)/8 en FROM r1)",
            """pl AS (SELECT list(en ORDER BY en) l, (count(*)-1)*(1-max(d)) h FROM en, den)""",
            """cut AS (SELECT l[floor(h)::INT+1]+(l[floor(h)::INT+2]-l[floor(h)::INT+1])*(h-floor(h)) c FROM pl)""",
            "r2m AS (SELECT r2.*, en >= c hot FROM r2 JOIN en USING (vec_id, b), cut)",
            """h1m AS (SELECT log2(sum(c)) - sum(c*log2(c))/sum(c) h, sum(c) n, count(*) d
               FROM (SELECT q, count(*)::DOUBLE c FROM r2m WHERE hot GROUP BY q))""",
            signal(),
            """err AS (SELECT sum(m*m*CASE WHEN hot THEN list_dot_product(x,x) ELSE list_dot_product(x_before,x_before) END) noise FROM r2m)""",
        )
        + f"""SELECT {meta}::DOUBLE metadata_bpd, round((h0.h*h0.n+h1m.h*h1m.n)/(h0.n*8),6) code_bpd,
  round({meta}+(h0.h*h0.n+h1m.h*h1m.n)/(h0.n*8),6) total_bpd, (h0.n+h1m.n)::BIGINT n_codes, (h0.d+h1m.d)::BIGINT n_distinct,
  (h0.d+h1m.d) > 0.5*(h0.n+h1m.n) sample_limited,
  round(10*log10((SELECT sum(p) FROM sig)/noise),4) snr_db FROM h0, h1m, err"""
    )


def _dual_deep() -> str:
    """Six-stage dual codec at 5 bits per dimension: stages 2..5 on the densest share."""
    meta = (32 + 8 * 2 + 8) / 64
    masked = [
        f"""e{i} AS (SELECT log2(sum(c)) - sum(c*log2(c))/sum(c) h, sum(c) n, count(*) d
            FROM (SELECT q, count(*)::DOUBLE c FROM r{i + 1} JOIN hb USING (vec_id, b) WHERE hot GROUP BY q))"""
        for i in range(2, 6)
    ]
    ctes = [blocks_gain(32)]
    for i in range(6):
        ctes += [fitted_scale(i), stage(i), code_entropy_of(i + 1, f"h{i}")]
    total = "h0.h*h0.n+h1.h*h1.n+e2.h*e2.n+e3.h*e3.n+e4.h*e4.n+e5.h*e5.n"
    count, distinct = "h0.n+h1.n+e2.n+e3.n+e4.n+e5.n", "h0.d+h1.d+e2.d+e3.d+e4.d+e5.d"
    return (
        chain(
            *ctes,
            f"den AS (SELECT least(1.0, (5.0-{meta}-h0.h/8-h1.h/8)/((h2.h+h3.h+h4.h+h5.h)/8)) d FROM h0,h1,h2,h3,h4,h5)",
            "en AS (SELECT vec_id, b, list_dot_product(x,x)/8 en FROM r2)",
            "pl AS (SELECT list(en ORDER BY en) l, (count(*)-1)*(1-max(d)) h FROM en, den)",
            "cut AS (SELECT l[floor(h)::INT+1]+(l[floor(h)::INT+2]-l[floor(h)::INT+1])*(h-floor(h)) c FROM pl)",
            "hb AS (SELECT vec_id, b, en >= c hot FROM en, cut)", *masked, signal(),
            """err AS (SELECT sum(r2.m*r2.m*CASE WHEN hot THEN list_dot_product(r6.x,r6.x) ELSE list_dot_product(r2.x,r2.x) END) noise
               FROM r2 JOIN r6 USING (vec_id, b) JOIN hb USING (vec_id, b))""",
        )
        + f"""SELECT {meta}::DOUBLE metadata_bpd, round(({total})/(h0.n*8),6) code_bpd, round({meta}+({total})/(h0.n*8),6) total_bpd,
  ({count})::BIGINT n_codes, ({distinct})::BIGINT n_distinct, ({distinct}) > 0.5*({count}) sample_limited,
  round(10*log10((SELECT sum(p) FROM sig)/noise),4) snr_db FROM h0,h1,e2,e3,e4,e5,err"""
    )


def _dense_rate(norm: str, meta: float) -> str:
    return (
        chain(
            norm, fitted_scale(0), stage(0), fitted_scale(1), stage(1),
            code_entropy_of(1, "h0"), code_entropy_of(2, "h1"), signal(),
            "err AS (SELECT sum(m*m*list_dot_product(x,x)) noise FROM r2)",
        )
        + f"""SELECT {meta}::DOUBLE metadata_bpd, round((h0.h+h1.h)/8,6) code_bpd, round({meta}+(h0.h+h1.h)/8,6) total_bpd,
  (h0.n+h1.n)::BIGINT n_codes, (h0.d+h1.d)::BIGINT n_distinct, (h0.d+h1.d) > 0.5*(h0.n+h1.n) sample_limited,
  round(10*log10((SELECT sum(p) FROM sig)/noise),4) snr_db FROM h0, h1, err"""
    )


def _sparse_batch() -> str:
    """Both halves as batches of their own."""
    return " UNION ALL ".join(f"SELECT {half}::INT half, * FROM ({_sparse_half(half)})" for half in (0, 1))


def _sparse_half(half: int) -> str:
    """Scales and density from the even ids, cut-off, rate and fidelity of one half."""
    meta, even, odd = (32 + 8 * 4 + 8) / 64, "vec_id%2=0", f"vec_id%2={half}"
    return (
        chain(
            blocks_gain(16), fitted_scale(0, even), stage(0), fitted_scale(1, even), stage(1),
            code_entropy_of(1, "h0", even), code_entropy_of(2, "h1", even), code_entropy_of(1, "g0", odd),
            f"den AS (SELECT least(1.0, (3.0-{meta}-h0.h/8)/(h1.h/8)) d FROM h0, h1)",
            f"en AS (SELECT vec_id, b, list_dot_product(x,x)/8 en FROM r1 WHERE {odd})",
            "pl AS (SELECT list(en ORDER BY en) l, (count(*)-1)*(1-max(d)) h FROM en, den)",
            "cut AS (SELECT l[floor(h)::INT+1]+(l[floor(h)::INT+2]-l[floor(h)::INT+1])*(h-floor(h)) c FROM pl)",
            "m2 AS (SELECT r2.*, en >= c hot FROM r2 JOIN en USING (vec_id, b), cut)",
            """g1 AS (SELECT log2(sum(c)) - sum(c*log2(c))/sum(c) h, sum(c) n, count(*) d
               FROM (SELECT q, count(*)::DOUBLE c FROM m2 WHERE hot GROUP BY q))""",
            f"sig AS (SELECT sum(list_dot_product(v,v)) p FROM e WHERE {odd})",
            "err AS (SELECT sum(m*m*CASE WHEN hot THEN list_dot_product(x,x) ELSE list_dot_product(x_before,x_before) END) noise FROM m2)",
        )
        + f"""SELECT {meta}::DOUBLE metadata_bpd, round((g0.h*g0.n+g1.h*g1.n)/(g0.n*8),6) code_bpd,
  round({meta}+(g0.h*g0.n+g1.h*g1.n)/(g0.n*8),6) total_bpd, (g0.n+g1.n)::BIGINT n_codes, (g0.d+g1.d)::BIGINT n_distinct,
  (g0.d+g1.d) > 0.5*(g0.n+g1.n) sample_limited, round(10*log10(p/noise),4) snr_db FROM g0, g1, sig, err"""
    )


def _dense_snr(kind: str, norm: str, n: int) -> str:
    """``version, stages, n_vectors, snr_db`` of ``n`` dense stages."""
    return chain(norm, *[c for i in range(n) for c in (fitted_scale(i), stage(i))], signal()) + f"""
SELECT '{kind}' AS version, {n} stages, (SELECT count(*) FROM e) n_vectors,
  10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r{n})) snr_db"""


def _deep(kind: str, norm: str, most: int) -> str:
    """As many of ``most`` stages as leave a mean square of 1e-15 before the next one."""
    ms = [f"SELECT {i} i, sum(list_dot_product(x,x))/(8*count(*)) ms, sum(m*m*list_dot_product(x,x)) z FROM r{i}" for i in range(1, most + 1)]
    return chain(
        norm, *[c for i in range(most) for c in (fitted_scale(i), stage(i))], signal(), "ms AS (" + " UNION ALL ".join(ms) + ")",
        f"st AS (SELECT coalesce(min(i) FILTER (ms < 1e-15), {most}) i FROM ms)",
    ) + f"""
SELECT '{kind}' AS version, i::INT stages, (SELECT count(*) FROM e) n_vectors, 10*log10((SELECT sum(p) FROM sig)/z) snr_db FROM ms JOIN st USING (i)"""


def _rate_switch() -> str:
    hot = chain(_robust(), CODEBOOK, HOT_START, *[_hot_stage(i, 0.95) for i in range(5)], signal(),
                "dv AS (SELECT list(dev ORDER BY k) dv FROM mad)")
    noise = "list_sum(list_transform(range(1,9), lambda k: (x[k]*dv[b*8+k])**2))"
    parts = [f"""SELECT 5.0::DOUBLE target_bpd, 'hotblock' AS version, (SELECT count(*) FROM e) n_vectors,
  10*log10((SELECT sum(p) FROM sig)/(SELECT sum({noise}) FROM hr5, dv)) snr_db"""]
    parts[0] = hot + parts[0]
    for target, n in ((5.5, 1), (7.0, 2)):
        parts.append(f"SELECT {target}::DOUBLE target_bpd, version, n_vectors, snr_db FROM ({_dense_snr('block', blocks_block(), n)})")
    every = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"SELECT target_bpd, version, n_vectors, round(snr_db,4) snr_db FROM ({every})"


def _one_stage(scale: float, by: str = "label") -> str:
    """Sums of errors of a gain16 stage: f(label, n_vectors, p, z, c, top)."""
    return chain(
        blocks_gain(16), given_scale(0, scale), stage(0), rebuild_from_residual(1).strip(),
        """gg AS (SELECT label, list_dot_product(v,v) p, list_sum(list_transform(range(1,65), lambda k: (v[k]-r[k])*(v[k]-r[k]))) z,
  list_dot_product(v,r)/((sqrt(list_dot_product(v,v))+1e-12)*(sqrt(list_dot_product(r,r))+1e-12)) c,
  list_max(list_transform(range(1,65), lambda k: abs(v[k]-r[k]))) top FROM e JOIN rec USING (vec_id))""",
        f"f AS (SELECT {by} AS label, count(*) n_vectors, sum(p) p, sum(z) z, avg(c) c, max(top) top FROM gg GROUP BY 1)",
    )


def _records() -> str:
    def one(tier: str, scale: float) -> str:
        return _one_stage(scale) + f"""SELECT 'label '||label AS "Model", 'gain16' AS "Version", '{tier}' AS "Tier",
  3.0::DOUBLE AS "BPD", 10*log10(p/z) snr FROM f"""

    return f"""SELECT "Model", "Version", "Tier", "BPD", round(snr,6) AS "SNR", CASE WHEN snr>100 THEN 'BIT EXACT' WHEN snr>20 THEN 'STABLE' ELSE 'N/A' END status,
  NULL::DOUBLE base_ppl FROM (SELECT * FROM ({one('coarse', 1.0)}) UNION ALL SELECT * FROM ({one('fine', 100.0)}))"""


def _e8_codes() -> str:
    return chain(blocks_raw("10.0"), given_scale(0, 1.0), stage(0)) + """
SELECT vec_id, b chunk_id, array_to_string(list_transform(q, lambda k: (k*2)::BIGINT), ',') code FROM r1"""


def _robust() -> str:
    return f"""{RAW},
lg AS (SELECT vec_id, label, (t.k-1)::INT k, v[t.k] x FROM e, range(1,65) t(k)),
med AS (SELECT k, quantile_cont(x,0.5) mid FROM lg GROUP BY k),
mad AS (SELECT k, quantile_cont(abs(x-mid),0.5)+1e-12 dev FROM lg JOIN med USING (k) GROUP BY k)"""


def _hot_stage(i: int, threshold: float) -> str:
    """Masked codeword stage on hr{i}(vec_id, label, b, x) -> hr{i+1} with id and level (NULL if cold)."""
    hot = "TRUE" if threshold >= 1 else f"list_dot_product(x,x)/8 > (SELECT quantile_cont(list_dot_product(x,x)/8,{threshold}) FROM hr{i})"
    return f"""
hh{i} AS (SELECT * FROM hr{i} WHERE {hot}),
hs{i} AS (SELECT vec_id, b, arg_max(cb.id, list_dot_product(x,c)) id, max(list_dot_product(x,c)) d FROM hh{i}, cb GROUP BY vec_id, b),
hq{i} AS (SELECT quantile_cont(d,0.001) lo, greatest(quantile_cont(d,0.999)-quantile_cont(d,0.001),1e-6) sp FROM hs{i}),
hl{i} AS (SELECT vec_id, b, id, floor(least(greatest((d-lo)/sp,0),0.9999)*15)+1 lev, lo, sp FROM hs{i}, hq{i}),
hr{i + 1} AS (SELECT o.vec_id, o.label, o.b, l.id, l.lev,
   CASE WHEN l.id IS NULL THEN o.x ELSE list_transform(range(1,9), lambda k: o.x[k]-cb.c[k]*(lo+(l.lev-0.5)/15*sp)) END x
   FROM hr{i} o LEFT JOIN hl{i} l USING (vec_id, b) LEFT JOIN cb ON cb.id = l.id)"""


HOT_START = "hr0 AS (SELECT vec_id, label, k//8 b, list((x-mid)/dev ORDER BY k) x FROM lg JOIN med USING (k) JOIN mad USING (k) GROUP BY ALL)"


def _direction() -> str:
    """One unrotated direction stage with 2.5 norm bits: dc(vec_id, label, b, id, code, x, left)."""
    return f"""{blocks_raw()}, {CODEBOOK},
dn AS (SELECT *, sqrt(list_dot_product(x,x)) nr FROM r0),
ds AS (SELECT vec_id, b, arg_max(id, list_dot_product(x,c)) id FROM dn, cb GROUP BY vec_id, b),
rg AS (SELECT quantile_cont(ln(nr),0.002) a, greatest(quantile_cont(ln(nr),0.998), quantile_cont(ln(nr),0.002)+1e-3) z FROM dn),
rr AS (SELECT a-(z-a)/(2*(2**2.5-1)) lo, greatest((z-a)*(1+1/(2**2.5-1)),1e-3) sp FROM rg),
dl AS (SELECT vec_id, label, b, x, ds.id, nr, CASE WHEN b%2=1 THEN 7 ELSE 3 END lv FROM dn JOIN ds USING (vec_id, b)),
dc AS (SELECT dl.*, floor(least(greatest((ln(nr)-lo)/sp,0),1-1e-12)*lv)+1 code, lo, sp FROM dl, rr),
dx AS (SELECT dc.*, list_transform(range(1,9), lambda k: x[k]-cb.c[k]*exp(lo+(code-0.5)/lv*sp)) lft FROM dc JOIN cb ON cb.id=dc.id)"""


def _graph_codec() -> str:
    body = chain(
        RAW, f"hv(id, c) AS ({_book(vertices())})",
        "gb AS (SELECT vec_id, t.b::INT b, list_concat(v, [0.0::DOUBLE, 0.0::DOUBLE])[t.b*22+1:t.b*22+22] x FROM e, range(3) t(b))",
        "gs AS (SELECT vec_id, b, arg_max(id, list_dot_product(x,c)) id FROM gb, hv GROUP BY vec_id, b)",
        "gl AS (SELECT vec_id, b, t.k::INT k, c[t.k] base, x[t.k]-c[t.k] d FROM gb JOIN gs USING (vec_id,b) JOIN hv USING (id), range(1,23) t(k))",
        "gr AS (SELECT k, min(d) lo, max(d)-min(d)+1e-9 w FROM gl GROUP BY k)",
        "rec AS (SELECT vec_id, list(base+lo+(least(greatest(floor((d-lo)/w*4),0),3)+0.5)/4*w ORDER BY b, k)[1:64] r FROM gl JOIN gr USING (k) GROUP BY vec_id)",
    )
    return body.rstrip() + by_label("rec")


def _knn(found: str, queries: str, items: str, k: int) -> str:
    """found(q_id, vec_id, score, rank): exact L2 neighbours, own id left out when equal."""
    return f"""{found} AS (SELECT * FROM (SELECT q_id, vec_id, dist score, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) rank
  FROM (SELECT q_id, vec_id, sqrt(list_sum(list_transform(range(1,65), lambda k: (q[k]-y[k])*(q[k]-y[k])))) dist
        FROM {queries}, {items} WHERE q_id <> vec_id)) WHERE rank <= {k})"""


def _matrix(name: str, matrix) -> str:
    """A fixed matrix as rows ``name(i, c)``."""
    return f"{name}(i, c) AS ({_book(matrix)})"


def _rotated() -> str:
    """Rotated min-max rows with 4 bits and a sign bit; the rotation is a literal."""
    turn = orthogonal_matrix(64)
    body = chain(
        RAW, _matrix("tc", turn.T), _matrix("tr", turn),
        "y AS (SELECT vec_id, list(list_dot_product(v,c) ORDER BY i) y FROM e, tc GROUP BY vec_id)",
        "w AS (SELECT *, list_min(y) lo, (list_max(y)-list_min(y))/15 st FROM y)",
        "q AS (SELECT *, list_transform(y, lambda t: round_even((t-lo)/st,0)) q FROM w)",
        "z AS (SELECT vec_id, list_transform(range(1,65), lambda k: lo+q[k]*st+sign(y[k]-lo-q[k]*st)*st/4) z FROM q)",
        "rec AS (SELECT vec_id, list(list_dot_product(z,c) ORDER BY i) r FROM z, tr GROUP BY vec_id)",
    )
    return body.rstrip() + by_label("rec")


def _direction_chain(i: int, stage_no: int) -> str:
    """Direction stage on u{i}(vec_id, b, x) with 2.5 norm bits -> u{i+1}."""
    odd = 1 if stage_no % 2 == 0 else 0
    return f"""
v{i} AS (SELECT *, sqrt(list_dot_product(x,x)) nr FROM u{i}),
k{i} AS (SELECT vec_id, b, arg_max(cb.id, list_dot_product(x,c)) id FROM v{i}, cb GROUP BY vec_id, b),
p{i} AS (SELECT quantile_cont(ln(nr),0.002) a, greatest(quantile_cont(ln(nr),0.998), quantile_cont(ln(nr),0.002)+1e-3) z FROM v{i}),
o{i} AS (SELECT a-(z-a)/(2*(2**2.5-1)) lo, greatest((z-a)*(1+1/(2**2.5-1)),1e-3) sp FROM p{i}),
h{i} AS (SELECT v{i}.vec_id, v{i}.b, x, k{i}.id, CASE WHEN v{i}.b%2={odd} THEN 7 ELSE 3 END lv, nr, lo, sp FROM v{i} JOIN k{i} USING (vec_id, b), o{i}),
j{i} AS (SELECT *, floor(least(greatest((ln(nr)-lo)/sp,0),1-1e-12)*lv)+1 cd FROM h{i}),
u{i + 1} AS (SELECT vec_id, b, list_transform(range(1,9), lambda k: x[k]-cb.c[k]*exp(lo+(cd-0.5)/lv*sp)) x FROM j{i} JOIN cb ON cb.id=j{i}.id)"""


def _direction_full() -> str:
    """Rotation and sketch as literals, block scales, four stages, sign sketch."""
    model = DirectionCodec(64, 4, 2.5, use_sketch=True, sketch_rank=4).blank()
    turn = model.rotate(np.eye(64))  # row vectors: y = v @ turn
    sketch = model._parts()[1]
    body = chain(
        RAW, CODEBOOK, _matrix("tc", turn.T), _matrix("tr", turn), _matrix("sk", sketch),
        "y AS (SELECT vec_id, list(list_dot_product(v,c) ORDER BY i) y FROM e, tc GROUP BY vec_id)",
        "yb AS (SELECT vec_id, t.b::INT b, y[t.b*8+1:t.b*8+8] x FROM y, range(8) t(b))",
        "tp AS (SELECT b, max(sqrt(list_dot_product(x,x))) top FROM yb GROUP BY b)",
        "md AS (SELECT median(top) md FROM tp)",
        "dv AS (SELECT md, greatest(median(abs(top-md)),1e-12)*1.4826 dv FROM tp, md GROUP BY md)",
        "bs AS (SELECT b, CASE WHEN abs(top-md)/dv>4 THEN greatest(top/greatest(md+4*dv,1e-12),1) ELSE 1 END bs FROM tp, dv)",
        "u0 AS (SELECT vec_id, b, list_transform(x, lambda t: t/bs) x FROM yb JOIN bs USING (b))",
        *[_direction_chain(i, i) for i in range(4)],
        "fl AS (SELECT vec_id, flatten(list(x ORDER BY b)) f FROM u4 GROUP BY vec_id)",
        "sg AS (SELECT vec_id, list(CASE WHEN list_dot_product(f,c)>=0 THEN 1.0 ELSE -1.0 END ORDER BY i) g FROM fl, sk GROUP BY vec_id)",
        "kl AS (SELECT list(c ORDER BY i) k FROM sk)",
        "bx AS (SELECT vec_id, list_transform(range(1,65), lambda j: (g[1]*k[1][j]+g[2]*k[2][j]+g[3]*k[3][j]+g[4]*k[4][j])/2) bx FROM sg, kl)",
        "gn AS (SELECT sum(list_dot_product(f,bx))/(sum(list_dot_product(bx,bx))+1e-12) gain FROM fl JOIN bx USING (vec_id))",
        "lf AS (SELECT vec_id, list_transform(range(1,65), lambda j: f[j]-gain*bx[j]) lf FROM fl JOIN bx USING (vec_id), gn)",
        "sl AS (SELECT list(bs ORDER BY b) sl FROM bs)",
        "ds AS (SELECT vec_id, list_transform(range(64), lambda j: lf[j+1]*sl[j//8+1]) d FROM lf, sl)",
        "dr AS (SELECT vec_id, list(list_dot_product(d,c) ORDER BY i) d FROM ds, tr GROUP BY vec_id)",
        "rec AS (SELECT vec_id, list_transform(range(1,65), lambda k: v[k]-d[k]) r FROM e JOIN dr USING (vec_id))",
    )
    return "SELECT *, TRUE AS closed FROM (" + body.rstrip() + by_label("rec") + ")"


def _crossover() -> str:
    hot = chain(_robust(), CODEBOOK, HOT_START, *[_hot_stage(i, 0.95) for i in range(10)], signal(),
                "dv AS (SELECT list(dev ORDER BY k) dv FROM mad)")
    noise = "list_sum(list_transform(range(1,9), lambda k: (x[k]*dv[b*8+k])**2))"
    parts = " UNION ALL ".join(
        f"SELECT {s} s, 10*log10((SELECT sum(p) FROM sig)/(SELECT sum({noise}) FROM hr{s}, dv)) snr" for s in range(4, 11)
    )
    block = chain(blocks_block(), *[c for i in range(3) for c in (fitted_scale(i), stage(i))], signal())
    dense = " UNION ALL ".join(
        f"SELECT {s} s, 10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r{s})) snr" for s in (1, 2, 3)
    )
    return f"""WITH hot AS ({hot}{parts}), blk AS ({block}{dense}), tg AS (SELECT i/2.0::DOUBLE t FROM range(8,21) u(i)),
pr AS (SELECT t, h.snr hs, CASE WHEN floor((t-4)/1.5)>0 THEN b.snr ELSE 0.5 END bsn FROM tg JOIN hot h ON h.s=floor(t) LEFT JOIN blk b ON b.s=least(floor((t-4)/1.5),3))
SELECT t::DOUBLE target_bpd, round(greatest(hs,bsn),4) snr_db, CASE WHEN hs>bsn THEN 'hotblock' ELSE 'block' END winner FROM pr"""


EVENT_STATE = """
lg AS (SELECT event_id seq, user_id, value, CASE event_type WHEN 'error' THEN 'forget' WHEN 'signup' THEN 'update' ELSE 'store' END op FROM events),
sl AS (SELECT *, CASE WHEN op='store' THEN (sum(CASE WHEN op='store' THEN 1 ELSE 0 END) OVER (ORDER BY seq) - 1) % 64 ELSE user_id % 64 END::BIGINT slot FROM lg),
st AS (SELECT slot, max(seq) stored FROM sl WHERE op='store' GROUP BY slot),
gn AS (SELECT slot, min(seq) gone FROM sl JOIN st USING (slot) WHERE op='forget' AND seq>stored GROUP BY slot),
up AS (SELECT slot, max(seq) updated FROM sl JOIN st USING (slot) LEFT JOIN gn USING (slot) WHERE op='update' AND seq>stored AND (gone IS NULL OR seq<gone) GROUP BY slot),
fin AS (SELECT slot, gone IS NOT NULL forgotten, greatest(stored, coalesce(updated,stored), coalesce(gone,stored)) seq, coalesce(updated,stored) val, stored FROM st LEFT JOIN gn USING (slot) LEFT JOIN up USING (slot))"""


def _event_memory() -> str:
    start = """r0 AS (SELECT slot vec_id, 0 label, 0 b, 1.0 m, list_transform(range(1,9), lambda i: ((stored*i)%17-8)/10.0::DOUBLE) x FROM fin)"""
    return chain(EVENT_STATE, start, given_scale(0, 10.0), stage(0)) + """
SELECT fin.slot, forgotten, fin.seq, round(value,6) v0, user_id::DOUBLE v1,
  round(list_sum(list_transform(range(1,9), lambda k: q[k]/10.0*k)),6) key_mark
FROM fin JOIN r1 ON r1.vec_id=fin.slot JOIN lg ON lg.seq=fin.val"""


def _vector_memory() -> str:
    return chain(
        blocks_raw(), given_scale(0, 10.0), stage(0),
        "an AS (SELECT vec_id, label, flatten(list(list_transform(q, lambda k: k/10.0) ORDER BY b)) a FROM r1 GROUP BY ALL)",
        "sl AS (SELECT *, (row_number() OVER (ORDER BY vec_id)-1)%64 slot FROM an)",
        "ls AS (SELECT slot, max(vec_id) vid FROM sl GROUP BY slot)",
        "fg AS (SELECT DISTINCT ls.slot FROM ls JOIN embeddings f ON f.vec_id%64=ls.slot WHERE f.label=0 AND f.vec_id>=vid)",
        "live AS (SELECT ls.slot, a k, label FROM ls JOIN sl ON sl.vec_id=vid AND sl.slot=ls.slot WHERE ls.slot NOT IN (SELECT slot FROM fg))",
        "sc AS (SELECT an.vec_id q_id, live.slot, live.label, list_dot_product(a,k) s FROM an, live)",
    ) + """
SELECT q_id, slot, round(s,6) similarity, label::DOUBLE v0 FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, slot) rn FROM sc) WHERE rn=1"""


def _grid_sql() -> str:
    from vecsnap.plans.experiments import KEY_SKETCH, VALUE_SKETCH

    return chain(
        "need AS (SELECT DISTINCT CASE WHEN label<5 THEN 'key' ELSE 'value' END AS role, len(embedding) dim FROM embeddings)",
        "g AS (SELECT role, dim::INT dim, target_bpd, stages, rotation, f FROM need, (VALUES (2.75::DOUBLE),(3.0),(4.0),(6.0)) t(target_bpd), "
        "(VALUES (2),(3),(4)) s(stages), (VALUES (TRUE),(FALSE)) r(rotation), "
        f"(SELECT 'key' r2, unnest({_list(KEY_SKETCH)}) f UNION ALL SELECT 'value', unnest({_list(VALUE_SKETCH)})) k "
        "WHERE role=r2 AND (role='key' OR (rotation AND stages<=3)))",
        "h AS (SELECT *, round_even(f*dim,0)::INT sketch_rank, ceil(dim/8) nb FROM g)",
        f"n AS (SELECT *, (target_bpd*dim-sketch_rank-nb*stages*{LOG2_IDS!r})/(nb*stages) norm_bits FROM h)",
    ) + "SELECT role, dim, target_bpd, stages, rotation, sketch_rank, round(norm_bits,6) norm_bits FROM n WHERE norm_bits BETWEEN 0 AND 24"


def _ablation() -> str:
    return chain(
        blocks_block(), fitted_scale(0), stage(0), fitted_scale(1), stage(1),
        code_entropy_of(1, "h0"), code_entropy_of(2, "h1"), signal(),
        "al AS (SELECT unnest(v) x FROM e)",
        "st AS (SELECT avg(x) mu, stddev_pop(x) sd FROM al)",
    ) .rstrip() + "," + """
u0 AS (SELECT vec_id, label, t.b::INT b, sd m, list_transform(v[t.b*8+1:t.b*8+8], lambda q: (q-mu)/sd) x FROM e, st, range(8) t(b)),
""" + _renamed_stage() + """
SELECT 'block 2-stage' AS method, round(10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r2)),4) snr_db, round(4+(h0.h+h1.h)/8,4) bpd FROM h0,h1
UNION ALL SELECT 'block 1-stage', round(10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r1)),4), round(4+h0.h/8,4) FROM h0
UNION ALL SELECT 'global scale', round(10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r10)),4), 4.0"""


def _renamed_stage() -> str:
    return "r9 AS (SELECT * FROM u0), s9 AS (SELECT 1.0::DOUBLE s)," + stage(9).lstrip()


def _trials() -> str:
    def one(kind: str, norm: str, meta: float) -> str:
        ctes = chain(
            norm, "sa AS (SELECT vec_id%3 tr, 100.0/(sqrt(sum(list_dot_product(x,x))/(8*count(*)))+1e-15) sc FROM r0 WHERE vec_id%5<3 GROUP BY 1)",
            "s0 AS (SELECT 1.0::DOUBLE s)",
        )
        scaled = "r7 AS (SELECT vec_id, label, b, m/sc m, list_transform(x, lambda q: q*sc) x FROM r0 JOIN sa ON vec_id%3=tr WHERE vec_id%5>=3), s7 AS (SELECT 1.0::DOUBLE s),"
        return ctes.rstrip() + ", " + scaled + stage(7) + f""",
sig AS (SELECT vec_id%3 tr, sum(list_dot_product(v,v)) p FROM e WHERE vec_id%5>=3 GROUP BY 1),
nz AS (SELECT vec_id%3 tr, sum(m*m*list_dot_product(x,x)) z FROM r8 GROUP BY 1),
ent AS (SELECT tr, log2(sum(c))-sum(c*log2(c))/sum(c) h FROM (SELECT vec_id%3 tr, q, count(*)::DOUBLE c FROM r8 GROUP BY ALL) GROUP BY tr)
SELECT '{kind}' AS version, 10*log10(p/z) snr, {meta}+h/8 bpd FROM sig JOIN nz USING (tr) JOIN ent USING (tr)"""

    return f"""SELECT version, round(avg(snr),4) snr_mean, round(stddev_samp(snr),4) snr_std, round(avg(bpd),4) bpd_mean, round(stddev_samp(bpd),4) bpd_std
FROM (({one("block", blocks_block(), 4.0)}) UNION ALL ({one("gain16", blocks_gain(16), 1.0)})) GROUP BY version"""


def _tiers() -> str:
    def one(kind: str, norm: str) -> str:
        return chain(norm, fitted_scale(0), stage(0), fitted_scale(1), stage(1), signal()) + f"""
SELECT '{kind}' AS version, round(10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r1)),4) extreme,
 round(10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r2)),4) medium,
 round(10*log10((SELECT sum(p) FROM sig)/(SELECT sum(m*m*list_dot_product(x,x)) FROM r2)),4) loose"""

    return f"SELECT * FROM ({one('block', blocks_block())}) UNION ALL SELECT * FROM ({one('gain16', blocks_gain(16))})"


def _lattice_products() -> str:
    return chain(
        RAW, LABEL_MEANS, "sd AS (SELECT stddev_samp(a)+1e-12 sd FROM ml)",
        "r0 AS (SELECT q_id vec_id, 0 label, t.b::INT b, 1.0 m, list_transform(q[t.b*8+1:t.b*8+8], lambda z: z/sd) x FROM probes, sd, range(8) t(b))",
        given_scale(0, 100.0), stage(0),
        "wt AS (SELECT vec_id, flatten(list(list_transform(q, lambda z: z/100.0*sd) ORDER BY b)) w FROM r1, sd GROUP BY vec_id)",
        "ix AS (SELECT w, (row_number() OVER (ORDER BY vec_id)-1)::INT out_id FROM wt)",
    ) + "SELECT label, out_id, round(sum(list_dot_product(v,w)),6) y_sum FROM e, ix GROUP BY ALL"


def _words() -> str:
    xor = "0"
    for i, row in enumerate(generator_words()):
        xor = f"xor({xor}, CASE WHEN ((o_orderkey % 4096) >> {i}) & 1 = 1 THEN {row} ELSE 0 END)"
    return f"""SELECT bit_count(w)::INT weight, count(*) n, sum(w)::BIGINT word_sum,
  count(*) FILTER (w & 3 = 3) n_holding, coalesce(sum(bit_count(w)-2) FILTER (w & 3 = 3),0)::BIGINT rest_points
FROM (SELECT ({xor})::BIGINT w FROM orders) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "e8_snr_by_label": chain(blocks_gain(16), given_scale(0, 100.0), stage(0), rebuild_from_residual(1)).rstrip()
        + by_label("rec"),
        "encode_stream": chain(blocks_gain(16), given_scale(0, 100.0), stage(0), rebuild_from_residual(1)).rstrip()
        + by_label("rec"),
        "word_vectors": """WITH l AS (
 SELECT 'vector' AS kind, 'w'||vec_id||' '||array_to_string(list_transform(embedding, lambda v: round_even(v::DOUBLE*1000000,0)::BIGINT),' ') t FROM embeddings
 UNION ALL SELECT 'prose', text FROM documents),
s AS (SELECT kind, string_split_regex(trim(t),'\\s+') k FROM l),
p AS (SELECT kind, k[1] w, list_transform(k[2:65], lambda q: TRY_CAST(q AS DOUBLE)) v FROM s),
g AS (SELECT kind, w, v, len(v)=64 AND len(list_filter(v, lambda q: q IS NULL))=0 ok FROM p)
SELECT kind, count(*) n_lines, count(*) FILTER (ok) n_parsed, coalesce(sum(list_sum(v)) FILTER (ok),0)::BIGINT value_sum, count(DISTINCT CASE WHEN ok THEN w END) n_words FROM g GROUP BY kind""",
        "valid_vectors": """SELECT label, count(*) FILTER (CASE WHEN label IN (0,2) THEN FALSE WHEN label=1 THEN len(list_filter(embedding, lambda v: NOT v>0))=0 ELSE TRUE END) n_valid,
 count(*) FILTER (NOT CASE WHEN label IN (0,2) THEN FALSE WHEN label=1 THEN len(list_filter(embedding, lambda v: NOT v>0))=0 ELSE TRUE END) n_rejected FROM embeddings GROUP BY label""",
        "kv_cache_layout": """WITH c AS (SELECT label AS layer, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 pos FROM embeddings),
l AS (SELECT layer, count(*)//2 + layer seq_len FROM c GROUP BY layer)
SELECT CASE WHEN layer<5 THEN 'key' ELSE 'value' END AS role, layer, count(*) n_tokens, max(pos) last_pos, sum(vec_id)::BIGINT id_sum,
 round(sum(embedding[1]::DOUBLE*(pos+1)),6) weighted FROM c JOIN l USING (layer) WHERE pos<seq_len GROUP BY ALL""",
        "cache_flatten": """SELECT 0 AS layer, 0 AS batch, 0 AS head, t.p::INT AS pos, count(*) n_vectors, round(sum(list_sum(embedding[t.p*16+1:t.p*16+16]::DOUBLE[])),6) value_sum FROM embeddings, range(4) t(p) GROUP BY t.p""",
        "chunk_blocks": """SELECT t.b::INT chunk_id, count(*) n, count(*)::BIGINT n_same, (22*count(*))::BIGINT n_values, round(sum(list_sum(embedding[t.b*22+1:t.b*22+22]::DOUBLE[])*(t.b+1)),6) block_sum FROM embeddings, range(3) t(b) GROUP BY t.b""",
        "dim_median_mad": chain(_robust()) + "SELECT k pos, round(mid,9) center, round(dev,9) spread FROM med JOIN mad USING (k)",
        "refit_median_mad": chain(_robust()) + "SELECT k pos, round(mid,9) center, round(dev,9) spread FROM med JOIN mad USING (k)",
        "refit_price_quantiles": """SELECT l_returnflag, round(quantile_cont(l_extendedprice,0.001),4) q001, round(quantile_cont(l_extendedprice,0.5),4) q500, round(quantile_cont(l_extendedprice,0.999),4) q999, true read_few, count(*) n, round(avg(l_extendedprice),4) mean FROM lineitem GROUP BY 1""",
        "order_price_quantiles": """SELECT o_orderpriority, round(quantile_cont(o_totalprice,0.001),4) q001, round(quantile_cont(o_totalprice,0.25),4) q250, round(quantile_cont(o_totalprice,0.5),4) q500, round(quantile_cont(o_totalprice,0.999),4) q999 FROM orders GROUP BY 1""",
        "dim_extremes": """SELECT (t.k-1)::INT pos, round(min(embedding[t.k])::DOUBLE,9) lo, round(max(embedding[t.k])::DOUBLE,9) hi, round(avg(embedding[t.k]::DOUBLE),9) mean, round(stddev_pop(embedding[t.k]::DOUBLE),9) dev FROM embeddings, range(1,65) t(k) GROUP BY t.k""",
        "block_moments": """SELECT t.b::INT chunk_id, round(sum(list_avg(embedding[t.b*8+1:t.b*8+8]::DOUBLE[])),6) mean_sum, round(sum(list_stddev_pop(embedding[t.b*8+1:t.b*8+8]::DOUBLE[])),6) dev_sum, round(max(list_stddev_pop(embedding[t.b*8+1:t.b*8+8]::DOUBLE[])),6) dev_max FROM embeddings, range(8) t(b) GROUP BY t.b""",
        "gain_moments": f"""WITH {RAW},
g AS (SELECT *, list_avg(v) gm, list_stddev_pop(v)+1e-12 gs FROM e),
z AS (SELECT label, gm, gs, list_transform(v, lambda q: (q-gm)/gs) z FROM g),
s AS (SELECT label, gm, gs, list_sum(list_transform(range(4), lambda i: list_stddev_pop(z[i*16+1:i*16+16])+1e-12)) g16,
 list_sum(list_transform(range(2), lambda i: list_stddev_pop(z[i*32+1:i*32+32])+1e-12)) g32 FROM z)
SELECT label, round(sum(gm),6) mean_sum, round(sum(gs),6) dev_sum, round(sum(g16),6) gain16_sum, round(sum(g32),6) gain32_sum FROM s GROUP BY label""",
        "outlier_block_scales": f"""WITH {RAW},
b AS (SELECT t.b::INT chunk_id, max(sqrt(list_dot_product(v[t.b*8+1:t.b*8+8],v[t.b*8+1:t.b*8+8]))*CASE WHEN label=3 AND t.b=0 THEN 5 ELSE 1 END) top FROM e, range(8) t(b) GROUP BY 1),
m AS (SELECT median(top) md FROM b), d AS (SELECT md, greatest(median(abs(top-md)),1e-12)*1.4826 dv FROM b, m GROUP BY md)
SELECT chunk_id, round(CASE WHEN abs(top-md)/dv>4 THEN greatest(top/greatest(md+4*dv,1e-12),1) ELSE 1 END,6) scale FROM b, d""",
        "e8_codes": _e8_codes(),
        "e8_codes_builtin": _e8_codes(),
        "nearest_codeword": chain(blocks_raw(), CODEBOOK) + "SELECT vec_id, b chunk_id, arg_max(id, list_dot_product(x,c))::INT codeword, round(max(list_dot_product(x,c)),9) score FROM r0, cb GROUP BY vec_id, b",
        "codeword_decode": chain(
            blocks_raw(), CODEBOOK,
            "bw AS (SELECT vec_id, b, arg_max(id, list_dot_product(x,c)) id, max(list_dot_product(x,c)) s FROM r0, cb GROUP BY vec_id, b)",
            "rec AS (SELECT vec_id, flatten(list(list_transform(c, lambda k: k*s) ORDER BY b)) r FROM bw JOIN cb USING (id) GROUP BY vec_id)",
        ).rstrip() + by_label("rec"),
        "row_standard_snr": chain(
            RAW, "st AS (SELECT vec_id, label, v, list_avg(v) mu, list_stddev_samp(v)+1e-12 sd FROM e)",
            "r0 AS (SELECT vec_id, label, t.b::INT b, sd m, list_transform(v[t.b*8+1:t.b*8+8], lambda q: (q-mu)/sd) x FROM st, range(8) t(b))",
            given_scale(0, 100.0), stage(0), rebuild_from_residual(1),
        ).rstrip() + by_label("rec"),
        "block_mean_snr": chain(
            RAW, "rec AS (SELECT vec_id, list_transform(range(64), lambda k: list_avg(v[(k//8)*8+1:(k//8)*8+8])) r FROM e)"
        ).rstrip() + by_label("rec"),
        "scalar_codec": chain(SCALAR3).rstrip() + by_label("rec", "noise/n + 1e-12"),
        "graph_codec": _graph_codec(),
        "rotated_codec": _rotated(),
        "direction_codec": _direction_full(),
        "rate_crossover": _crossover(),
        "direction_codes": chain(_direction()) + "SELECT b chunk_id, code::INT code, count(*) n, sum(id)::BIGINT id_sum FROM dc GROUP BY b, code",
        "direction_tail_snr": chain(
            _direction(),
            "tl AS (SELECT unnest(list_transform(lft, lambda q: abs(q))) a FROM dx)",
            "ts AS (SELECT greatest(quantile_cont(a,0.995)*2,1e-9) ts FROM tl)",
            """rec0 AS (SELECT vec_id, b, list_transform(range(1,9), lambda k: x[k]-lft[k]
               + ((floor((least(greatest(lft[k]/ts,-0.5),0.25)+0.5)*4)+0.5)/4-0.5)*ts) y FROM dx, ts)""",
            "rec AS (SELECT vec_id, flatten(list(y ORDER BY b)) r FROM rec0 GROUP BY vec_id)",
        ).rstrip() + by_label("rec"),
        "block_codec": _dense_rate(blocks_block(), 4.0),
        "gain16_codec": _dense_rate(blocks_gain(16), 1.0),
        "sparse_codec": _budget_rate("sparse"),
        "dual_codec": _budget_rate("dual"),
        "dual_codec_deep": _dual_deep(),
        "code_entropy": chain(blocks_gain(16), given_scale(0, 1.0), stage(0), code_entropy_of(1, "h0"))
        + "SELECT 0 AS stage, n::BIGINT n_codes, d n_distinct, round(h,6) entropy_bits FROM h0",
        "quick_entropy": """WITH c AS (SELECT count(*) c FROM events GROUP BY user_id, event_type, floor(value))
SELECT sum(c)::BIGINT n_codes, round(log2(sum(c))-sum(c*log2(c))/sum(c),6) exact_bits, true inside, true useful FROM c""",
        "stage_residuals": chain(blocks_gain(16), fitted_scale(0), stage(0), fitted_scale(1), stage(1)) + " UNION ALL ".join(
            f"SELECT {i} AS stage, round(10*log10(sum(list_dot_product(x,x))/(8*count(*))),6) residual_db FROM r{i}" for i in range(3)
        ),
        "payload_sums": chain(blocks_gain(16), given_scale(0, 100.0), stage(0), given_scale(1, 30000.0), stage(1)) + """
SELECT b chunk_id, round(sum(list_dot_product(y,y)),6) energy, round(sum(list_sum(y)),6) value_sum FROM
(SELECT r1.b, list_transform(range(1,9), lambda k: r1.q[k]/100.0+r2.q[k]/30000.0) y FROM r1 JOIN r2 USING (vec_id, b)) GROUP BY b""",
        "hot_chunks": chain(blocks_raw(), "n AS (SELECT b, list_dot_product(x,x)/8 en FROM r0)", "c AS (SELECT quantile_cont(en,0.95) h, quantile_cont(en,0.75) d FROM n)")
        + "SELECT b chunk_id, count(*) FILTER (en>h) n_hot, count(*) FILTER (en>=d) n_dense FROM n, c GROUP BY b",
        "hotblock_codes": chain(_robust(), CODEBOOK, HOT_START, _hot_stage(0, 0.95))
        + "SELECT b::INT chunk_id, lev::INT AS level, count(*) n, sum(id)::BIGINT id_sum FROM hl0 GROUP BY ALL",
        "hotblock_codec": chain(
            _robust(), CODEBOOK, HOT_START, _hot_stage(0, 1.0), _hot_stage(1, 1.0),
            "rx AS (SELECT vec_id, flatten(list(x ORDER BY b)) x FROM hr2 GROUP BY vec_id)",
            "dv AS (SELECT list(dev ORDER BY k) dv FROM mad)",
            "rec AS (SELECT vec_id, list_transform(range(1,65), lambda k: v[k]-x[k]*dv[k]) r FROM e JOIN rx USING (vec_id), dv)",
            "fr AS (SELECT list_dot_product(v,v) p, list_sum(list_transform(range(1,65), lambda k: (v[k]-r[k])*(v[k]-r[k]))) z, list_dot_product(v,r)/((sqrt(list_dot_product(v,v))+1e-12)*(sqrt(list_dot_product(r,r))+1e-12)) c FROM e JOIN rec USING (vec_id))",
        ) + "SELECT count(*) n_vectors, (count(*)*16)::BIGINT n_hot, round((64.0+16+12.0*16)/64,6) total_bpd, round(10*log10(sum(p)/sum(z)),6) snr_db, round(avg(c),6) cosine FROM fr",
        "knn_of_label_means": chain(RAW, LABEL_MEANS, "it AS (SELECT vec_id, v y FROM e)", """f AS (SELECT q_id, vec_id, dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) rk FROM
 (SELECT q_id, vec_id, sqrt(list_sum(list_transform(range(1,65), lambda k: (q[k]-y[k])*(q[k]-y[k])))) dist FROM probes, it))""")
        + "SELECT q_id, vec_id, round(dist,6) score, rk::INT AS rank FROM f WHERE rk<=10",
        "recall_at_10": chain(
            SCALAR3, "sm AS (SELECT vec_id FROM e ORDER BY md5('1:'||vec_id), vec_id LIMIT 50)",
            "qt AS (SELECT vec_id q_id, v q FROM e JOIN sm USING (vec_id))", "it AS (SELECT vec_id, v y FROM e)",
            "qh AS (SELECT vec_id q_id, r q FROM rec JOIN sm USING (vec_id))", "ih AS (SELECT vec_id, r y FROM rec)",
            _knn("tr", "qt", "it", 1), _knn("hat", "qh", "ih", 10),
        ) + "SELECT count(*) n_queries, avg(CASE WHEN hat.vec_id IS NULL THEN 0.0 ELSE 1.0 END) recall FROM tr LEFT JOIN hat ON tr.q_id=hat.q_id AND tr.vec_id=hat.vec_id",
        "needle_lookup": chain(
            SCALAR3, """f AS (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) rk FROM
 (SELECT a.vec_id q_id, b.vec_id, list_sum(list_transform(range(1,65), lambda k: (a.v[k]-b.r[k])*(a.v[k]-b.r[k]))) dist FROM e a, rec b))""",
        ) + "SELECT label, count(*) n, count(*) FILTER (q_id=f.vec_id) n_hits FROM f JOIN embeddings x ON x.vec_id=q_id WHERE rk=1 GROUP BY label",
        "knn_of_rebuilt": chain(
            SCALAR3, """f AS (SELECT q_id, vec_id, dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) rk FROM
 (SELECT a.vec_id q_id, b.vec_id, sqrt(list_sum(list_transform(range(1,65), lambda k: (a.v[k]-b.r[k])*(a.v[k]-b.r[k])))) dist FROM e a, rec b))""",
        ) + "SELECT q_id, vec_id, round(dist,6) score, rk::INT AS rank FROM f WHERE rk<=3",
        "cell_search_work": "SELECT count(*) n_queries, count(*) n_items, count(*)*count(*) all_pairs, true fewer FROM embeddings",
        "qk_fidelity": chain(
            SCALAR3, LABEL_MEANS,
            "kk AS (SELECT unnest(list_transform(range(1,65), lambda k: {'v': v[k], 'd': v[k]-r[k]})) u FROM e JOIN rec USING (vec_id))",
            "ks AS (SELECT avg(u.d*u.d) mse, var_pop(u.v) vk FROM kk)",
            "qq AS (SELECT list_dot_product(q,v) a, list_dot_product(q,r) b FROM e JOIN rec USING (vec_id), probes)",
            "qs AS (SELECT avg((a-b)*(a-b)) qm, var_pop(a) vq FROM qq)",
        ) + """SELECT round(mse,9) mse, round(qm,9) qk_mse, round(mse/(vk+1e-12),9) mse_norm, round(qm/(vq+1e-12),9) qk_mse_norm,
 round(0.5*mse/(vk+1e-12)+0.5*qm/(vq+1e-12),9) combined FROM ks, qs""",
        "memory_latest_state": _event_memory(),
        "memory_stream": _event_memory(),
        "memory_retrieve": _vector_memory(),
        "basket_disjoint_partners": chain(MEMBERS, "p AS (SELECT DISTINCT a.s, b.s t FROM m a JOIN m b ON a.x=b.x AND a.s<>b.s)", "k AS (SELECT s, count(*) c FROM p GROUP BY s)", "z AS (SELECT s, count(*) n FROM m GROUP BY s)")
        + "SELECT s l_orderkey, n n_items, coalesce(c,0) n_overlapping, (SELECT count(*) FROM z)-1-coalesce(c,0) n_disjoint FROM z LEFT JOIN k USING (s)",
        "basket_overlap_histogram": chain(MEMBERS, "p AS (SELECT a.s, b.s t, count(*) shared FROM m a JOIN m b ON a.x=b.x AND a.s<b.s GROUP BY ALL)", "n AS (SELECT count(DISTINCT s) n FROM m)")
        + "SELECT shared::INT shared, count(*) n_pairs FROM p GROUP BY shared UNION ALL SELECT 0, max(n)*(max(n)-1)//2-(SELECT count(*) FROM p) FROM n",
        "basket_cover_check": chain(MEMBERS, "z AS (SELECT s, count(*) k FROM m GROUP BY s)", "p AS (SELECT a.s, b.s t, count(*) c FROM m a JOIN m b ON a.x=b.x AND a.s<b.s GROUP BY ALL)", "i AS (SELECT count(DISTINCT x) v FROM m)")
        + """SELECT count(*) n_sets, max(v) n_items, min(k) min_size, max(k) max_size, sum(k*(k-1)*(k-2)//6)::BIGINT n_covered, max(v*(v-1)*(v-2)//6)::BIGINT n_possible,
 (SELECT count(*) FROM p WHERE c>=3) n_pairs_sharing, (SELECT count(*) FROM p WHERE c>=3)=0 AND sum(k*(k-1)*(k-2)//6)=max(v*(v-1)*(v-2)//6) exactly_once FROM z, i""",
        "customer_overlaps": chain(CUSTOMERS, "p AS (SELECT DISTINCT a.s, b.s t FROM m a JOIN m b ON a.x=b.x AND a.s<>b.s)", "k AS (SELECT s, count(*) c FROM p GROUP BY s)", "z AS (SELECT s, count(*) n FROM m GROUP BY s)")
        + "SELECT s o_custkey, n n_items, coalesce(c,0) n_overlapping, (SELECT count(*) FROM z)-1-coalesce(c,0) n_disjoint FROM z LEFT JOIN k USING (s)",
        "customer_overlap_histogram": chain(CUSTOMERS, "p AS (SELECT a.s, b.s t, count(*) shared FROM m a JOIN m b ON a.x=b.x AND a.s<b.s GROUP BY ALL)", "n AS (SELECT count(DISTINCT s) n FROM m)")
        + "SELECT * FROM (SELECT shared::INT shared, count(*) n_pairs FROM p GROUP BY shared UNION ALL SELECT 0, max(n)*(max(n)-1)//2-(SELECT count(*) FROM p) FROM n) WHERE n_pairs>0",
        "basket_cover_ranges": chain(
            MEMBERS, "nm AS (SELECT x, row_number() OVER (ORDER BY x)-1 c FROM (SELECT DISTINCT x FROM m))", "v AS (SELECT count(*) v FROM nm)", "mc AS (SELECT s, c FROM m JOIN nm USING (x))",
            "t AS (SELECT a.c + b.c*(b.c-1)//2 + d.c*(d.c-1)*(d.c-2)//6 r, count(*) times FROM mc a JOIN mc b ON a.s=b.s AND a.c<b.c JOIN mc d ON d.s=b.s AND b.c<d.c GROUP BY 1)",
            "i AS (SELECT r, times, r-row_number() OVER (PARTITION BY times ORDER BY r) g FROM t)", "cv AS (SELECT times, min(r) f, max(r) l FROM i GROUP BY times, g)",
            "o AS (SELECT r, lag(r, 1, -1) OVER (ORDER BY r) q FROM (SELECT r FROM t UNION ALL SELECT v*(v-1)*(v-2)//6 FROM v))",
            "al AS (SELECT * FROM cv UNION ALL SELECT 0, q+1, r-1 FROM o WHERE r>q+1)",
        ) + "SELECT times, count(*) n_ranges, sum(l-f+1)::BIGINT n_triples, max(l-f+1) longest, min(f) lowest, max(l) highest FROM al GROUP BY times",
        "incidence_counts": chain(MEMBERS) + "SELECT 'item' per, n, count(*) times FROM (SELECT count(*) n FROM m GROUP BY x) GROUP BY n UNION ALL SELECT 'set', n, count(*) FROM (SELECT count(*) n FROM m GROUP BY s) GROUP BY n",
        "order_codewords": _words(),
        "common_neighbours": chain(GRAPH, "nd AS (SELECT DISTINCT v a, v+1 b FROM lk)", "h AS (SELECT nd.a, nd.b, count(*) n FROM nd JOIN lk p ON p.v=nd.a JOIN lk q ON q.v=nd.b AND q.w=p.w GROUP BY ALL)")
        + "SELECT nd.a, nd.b, coalesce(n,0) n_common FROM nd LEFT JOIN h USING (a,b)",
        "graph_degrees": chain(GRAPH) + "SELECT degree, count(*) n_vertices FROM (SELECT v, count(*) degree FROM lk GROUP BY v) GROUP BY degree",
        "graph_regularity": chain(
            GRAPH, "dg AS (SELECT v, count(*) d FROM lk GROUP BY v)",
            "w2 AS (SELECT p.w a, q.w b, count(*) c FROM lk p JOIN lk q ON p.v=q.v AND p.w<q.w GROUP BY ALL)",
            "la AS (SELECT ed.a, ed.b, coalesce(c,0) c FROM ed LEFT JOIN w2 USING (a,b))",
            "mu AS (SELECT c FROM w2 ANTI JOIN ed USING (a,b))",
            "k AS (SELECT count(*) n FROM dg)", "mm AS (SELECT max(n)*(max(n)-1)/2-(SELECT count(*) FROM ed) m FROM k)",
            "ms AS (SELECT sum(c)/max(m) mean, sum(c*c)/max(m)-(sum(c)/max(m))**2 var FROM mu, mm)",
        ) + """SELECT (SELECT n FROM k) n_vertices, (SELECT count(*) FROM ed) n_edges, (SELECT min(d) FROM dg) degree_min, (SELECT max(d) FROM dg) degree_max,
 (SELECT min(c) FROM la) lambda_min, (SELECT max(c) FROM la) lambda_max, round(mean,6) mu_mean, round(var,6) mu_variance,
 (SELECT min(d)=max(d) FROM dg) AND (SELECT min(c)=max(c) FROM la) AND var<1e-9 strongly_regular FROM ms""",
        "neighbour_counts": chain(
            GRAPH, "w2 AS (SELECT p.w a, q.w b, count(*) c FROM lk p JOIN lk q ON p.v=q.v AND p.w<q.w GROUP BY ALL)",
            "ct AS (SELECT ed.a IS NOT NULL adjacent, c shared, count(*) n_pairs FROM w2 LEFT JOIN ed USING (a,b) GROUP BY ALL)",
            "k AS (SELECT count(DISTINCT v) n FROM lk)", "al AS (SELECT true adjacent, count(*) m FROM ed UNION ALL SELECT false, max(n)*(max(n)-1)//2-(SELECT count(*) FROM ed) FROM k)",
        ) + """SELECT adjacent, shared, n_pairs FROM ct UNION ALL
SELECT adjacent, 0, m-coalesce((SELECT sum(n_pairs) FROM ct WHERE ct.adjacent=al.adjacent),0)::BIGINT FROM al WHERE m>coalesce((SELECT sum(n_pairs) FROM ct WHERE ct.adjacent=al.adjacent),0)""",
        "product_values": chain(RAW, "p AS (SELECT b.vec_id-a.vec_id=1 adj, list_dot_product(a.v,b.v) ip FROM e a JOIN e b ON a.vec_id<b.vec_id)")
        + "SELECT adj adjacent, round(ip,2)+0.0 product, count(*) n_pairs FROM p GROUP BY ALL",
        "graph_spectrum": """WITH g AS (SELECT vec_id//10 k, count(*) m FROM embeddings GROUP BY 1)
SELECT round(sqrt(m),6) eigenvalue, count(*) multiplicity FROM g GROUP BY m UNION ALL SELECT -round(sqrt(m),6), count(*) FROM g GROUP BY m
UNION ALL SELECT 0.0::DOUBLE, sum(m-1)::BIGINT FROM g HAVING sum(m-1)>0""",
        "product_statistics": chain(RAW, "p AS (SELECT b.vec_id-a.vec_id=1 adj, list_dot_product(a.v,b.v) ip FROM e a JOIN e b ON a.vec_id<b.vec_id)")
        + "SELECT adj adjacent, count(*) n_pairs, round(avg(ip),6) mean, round(stddev_pop(ip),6) deviation FROM p GROUP BY adj",
        "energy_rank": chain("d AS (SELECT (t.k-1)::INT pos, sum(embedding[t.k]::DOUBLE*embedding[t.k]::DOUBLE) en FROM embeddings, range(1,65) t(k) GROUP BY t.k)",
            "c AS (SELECT pos, row_number() OVER w rk, sum(en) OVER w/(SELECT sum(en) FROM d) sh FROM d WINDOW w AS (ORDER BY en DESC, pos))")
        + "SELECT pos, rk::INT AS rank, round(sh,9) AS share, (SELECT min(rk) FROM c WHERE sh>=0.9)::INT AS cutoff FROM c",
        "running_drift": "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),4) drift FROM events",
        "drift_by_segment": chain(
            blocks_gain(16), given_scale(0, 100.0), stage(0), signal(),
            "nz AS (SELECT vec_id, sum(m*m*list_dot_product(x,x)) z FROM r1 GROUP BY vec_id)",
            "sg AS (SELECT vec_id//100 segment, count(*) n_vectors, 10*log10(sum(p)/sum(z)) s FROM sig JOIN nz USING (vec_id) GROUP BY 1)",
        ) + "SELECT segment, n_vectors, round(s,6) snr_db, round(s-(SELECT s FROM sg ORDER BY segment LIMIT 1),6) drift_db FROM sg",
        "drift_stream": chain(
            blocks_gain(16), given_scale(0, 100.0), stage(0), signal(),
            "nz AS (SELECT vec_id, sum(m*m*list_dot_product(x,x)) z FROM r1 GROUP BY vec_id)",
            "sg AS (SELECT vec_id//100 segment, count(*) n_vectors, 10*log10(sum(p)/sum(z)) s FROM sig JOIN nz USING (vec_id) GROUP BY 1)",
        ) + "SELECT segment, n_vectors, round(s,6) snr_db, round(s-(SELECT s FROM sg ORDER BY segment LIMIT 1),6) drift_db, true median_near FROM sg",
        "sampled_rows": "SELECT vec_id, label FROM embeddings ORDER BY md5('7:'||vec_id), vec_id LIMIT 100",
        "shuffled_rows": "SELECT vec_id, row_number() OVER (ORDER BY md5('42:'||vec_id)) AS position FROM embeddings",
        "position_split": """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) k, count(*) OVER () n FROM embeddings)
SELECT CASE WHEN k<=greatest(200,n//5) THEN 'train' WHEN k<=greatest(200,n//5)+256 THEN 'cal' ELSE 'test' END AS part, count(*) n, min(vec_id) first_id, max(vec_id) last_id FROM r GROUP BY 1""",
        "lattice_products": _lattice_products(),
        "storage_footprint": """SELECT CASE WHEN label<5 THEN 'key' ELSE 'value' END AS role, label, count(*) n_vectors, sum(len(embedding))::BIGINT n_values, sum(len(embedding))*2.0::DOUBLE fp16_bytes, sum(len(embedding))::DOUBLE int8_bytes,
 sum(len(embedding))*0.5::DOUBLE int4_bytes, round(sum(len(embedding))*(2.2::DOUBLE/8),6) coded_bytes, round((1-(2.2::DOUBLE/8)/2)*100,6) saving_pct FROM embeddings GROUP BY ALL""",
        "cache_sizes": """SELECT lang, sum(n_chars)::BIGINT n_tokens, round(sum(n_chars)*65536::DOUBLE/1073741824*2,6) fp16_gb, round(sum(n_chars)*65536::DOUBLE/1073741824,6) int8_gb,
 round(sum(n_chars)*65536::DOUBLE/1073741824*0.5,6) int4_gb, round(sum(n_chars)*65536::DOUBLE/1073741824*(2.2::DOUBLE/8),6) coded_gb, round((1-(2.2::DOUBLE/8)/2)*100,6) saving_pct FROM documents GROUP BY lang""",
        "graph_codec_rates": """SELECT dim::INT AS dim, rb::INT residual_bits, (ceil(dim/22)*(7+22*rb))::BIGINT bits, round(32*dim/(ceil(dim/22)*(7+22*rb)),6) ratio, (n*ceil(dim/22)*(7+22*rb))::BIGINT table_bits
FROM (SELECT len(embedding) dim, count(*) n FROM embeddings GROUP BY 1), (VALUES (1),(2),(3),(4)) t(rb)""",
        "rate_grid": _grid_sql(),
        "ablation": _ablation(),
        "trial_summary": _trials(),
        "tier_pivot": _tiers(),
        "stored_payload": chain(blocks_gain(16), given_scale(0, 100.0), stage(0), rebuild_from_residual(1)).rstrip()
        + by_label("rec"),
        "stored_codes": chain(blocks_gain(16), given_scale(0, 100.0), stage(0)) + """
SELECT b chunk_id, round(sum(list_dot_product(y,y)),6) energy, round(sum(list_sum(y)),6) value_sum FROM
(SELECT b, list_transform(q, lambda k: k/100.0) y FROM r1) GROUP BY b""",
        "stored_cache": """SELECT label::INT AS layer, count(*) n_tokens, round(sum(embedding[1]::DOUBLE*pos),6) weighted,
 (SELECT count(DISTINCT label) FROM embeddings WHERE label<5) num_layers, 'float32' dtype, 64::BIGINT dim
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) pos FROM embeddings WHERE label<5) GROUP BY label""",
        "result_records": _records(),
        "fidelity_report": _one_stage(100.0) + """SELECT label, n_vectors, round(z/(64*n_vectors),9) mse, round(10*log10(p/z),9) snr_db,
 round(20*log10(sqrt(p)/sqrt(z)),9) norm_ratio_db, round(c,9) cosine, round(top,9) max_abs FROM f""",
        "largest_difference": _one_stage(100.0, "0") + "SELECT round(top,9) max_abs FROM f",
        "rate_switch": _rate_switch(),
        "direction_rates": f"""SELECT label, round(64*count(*)*((8*(4*{LOG2_IDS!r}+10)+4)/64),3) effective_bits, round(64*count(*)*((8*(4*8+4*3)+4)/64),3) raw_bits,
 round(64*count(*)*6.0::DOUBLE,3) rotated_bits FROM embeddings GROUP BY label""",
        "first_words": """SELECT count(*) n_words, max(vec_id) last_id, round(sum(list_sum(embedding::DOUBLE[])),5) value_sum FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 300)""",
        "sparse_codec_batch": _sparse_batch(),
        "deep_codecs": f"""SELECT version, stages, n_vectors, round(snr_db,2) snr_db FROM
 (SELECT * FROM ({_deep('block', blocks_block(), 4)}) UNION ALL SELECT * FROM ({_deep('gain16', blocks_gain(16), 8)}))""",
        "perplexity_delta": """WITH l AS (SELECT event_type AS model, CASE WHEN user_id%2=0 THEN 'base' ELSE 'coded' END variant, exp(avg(value/100)) ppl FROM events GROUP BY ALL)
SELECT a.model, a.variant, round(a.ppl,6) ppl, round(b.ppl,6) base_ppl, round(a.ppl-b.ppl,6) ppl_delta FROM l a JOIN l b ON a.model=b.model AND b.variant='base'""",
    }

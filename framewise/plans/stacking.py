"""Queries and oracles of the stacking family."""

from __future__ import annotations

from ..operators import stack as st
from ..operators import stats
from .fixtures import F0, F0N, f0, f0_gaps, f0_plain, r6, rounded, sql_mid, sr
from pyspark.sql import functions as F

K = ["k"]
OPT = {"weight": "frame_weight"}

#: Prepared samples: x = value or NULL, w = weight, cw, fw.
PREP = """SELECT *, CASE WHEN value IS NOT NULL AND coverage > 1e-6 AND frame_weight > 0 THEN value END AS v,
  CASE WHEN value IS NOT NULL AND coverage > 1e-6 AND frame_weight > 0 THEN coverage * frame_weight END AS w,
  CASE WHEN value IS NOT NULL THEN coverage * frame_weight ELSE 0 END AS cw, frame_weight AS fw FROM ({src})"""


def prep(src=F0):
    return PREP.format(src=src)


#: CTE text per method giving table b (keys, lo, hi, mid).
def bounds_sql(method: str, keys: str = "k", rows: str = "s", low: float = 3.0, high: float = 3.0) -> str:
    if method == "median":
        return f"""b AS (SELECT {keys}, mid, CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi
          FROM ({sql_mid(rows, keys, 'v', 'w', {'mid': 0.5})}))"""
    if method == "sigma":
        return f"""b0 AS (SELECT {keys}, sum(v*w)/sum(w) AS mid FROM {rows} GROUP BY {keys}),
        b AS (SELECT {keys}, any_value(mid) AS mid, any_value(mid) - {low}*sqrt(sum((v-mid)*(v-mid)*w)/sum(w)) AS lo,
          any_value(mid) + {high}*sqrt(sum((v-mid)*(v-mid)*w)/sum(w)) AS hi FROM {rows} JOIN b0 USING ({keys}) GROUP BY {keys})"""
    if method == "winsorized":
        return f"""b0 AS ({sql_mid(rows, keys, 'v', 'w', {'mid': 0.5})}),
        bd AS (SELECT {keys}, abs(v - mid) AS d, w FROM {rows} JOIN b0 USING ({keys})),
        b1 AS ({sql_mid('bd', keys, 'd', 'w', {'mad': 0.5})}),
        b AS (SELECT {keys}, mid, mid - {low}*greatest(1e-6, mad*1.4826) AS lo, mid + {high}*greatest(1e-6, mad*1.4826) AS hi
          FROM b0 JOIN b1 USING ({keys}))"""
    if method == "percentile":
        return "b AS (" + sql_mid(rows, keys, "v", "w", {"lo": low, "hi": high, "mid": 0.5}) + ")"
    text = f"""c0 AS ({sql_mid(rows, keys, 'v', 'w', {'mid': 0.5})}),
      cd AS (SELECT {keys}, abs(v - mid) AS d, w FROM {rows} JOIN c0 USING ({keys})),
      cm AS ({sql_mid('cd', keys, 'd', 'w', {'mad': 0.5})}),
      t0 AS (SELECT {keys}, greatest(mad*1.4826022185, abs(mid)*2.384185791015625e-07, 1e-6) AS scale,
        CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, false AS stop,
        (SELECT count(v) FROM {rows} r WHERE r.k = c0.k) AS remaining FROM c0 JOIN cm USING ({keys}))"""
    for i in range(3):
        text += f""",
      r{i} AS (SELECT {keys}, v, w FROM {rows} JOIN t{i} USING ({keys}) WHERE v BETWEEN lo AND hi),
      q{i} AS ({sql_mid(f'r{i}', keys, 'v', 'w', {'mid': 0.5})}),
      n{i} AS (SELECT {keys}, scale, lo, hi, stop, remaining, greatest(lo, mid - {low}*scale) AS lc, least(hi, mid + {high}*scale) AS hc
        FROM t{i} JOIN q{i} USING ({keys})),
      k{i} AS (SELECT {keys}, any_value(n{i}) AS s, count(*) FILTER (v BETWEEN lc AND hc) AS kept
        FROM {rows} JOIN n{i} USING ({keys}) GROUP BY {keys}),
      t{i + 1} AS (SELECT {keys}, s.scale AS scale,
        CASE WHEN go THEN s.lc ELSE s.lo END AS lo, CASE WHEN go THEN s.hc ELSE s.hi END AS hi,
        (NOT go OR kept = s.remaining) AS stop, CASE WHEN go THEN kept ELSE s.remaining END AS remaining
        FROM (SELECT *, (NOT s.stop AND s.remaining >= 5 AND kept >= 3) AS go FROM k{i}))"""
    return text + f", b AS (SELECT {keys}, lo, hi, CAST(NULL AS DOUBLE) AS mid FROM t3)"


def value_sql(method: str) -> str:
    kept = "sum(v*w) FILTER (v BETWEEN lo AND hi) / sum(w) FILTER (v BETWEEN lo AND hi)"
    return {
        "median": "any_value(mid)",
        "winsorized": "sum(greatest(lo, least(hi, v))*w)/sum(w)",
        "percentile": f"coalesce({kept}, any_value(mid))",
    }.get(method, f"coalesce({kept}, sum(v*w)/sum(w))")


def stack_sql(method: str, low: float = 3.0, high: float = 3.0, src: str = F0) -> str:
    return f"""WITH s AS ({prep(src)}), {bounds_sql(method, low=low, high=high)}
    SELECT k, {sr(value_sql(method), 'value')}, {sr('sum(cw)/sum(fw)', 'coverage')}, count(v) AS samples,
      {sr('count(*) FILTER (v < lo) / count(v)', 'rejected_low')}, {sr('count(*) FILTER (v > hi) / count(v)', 'rejected_high')},
      {sr('coalesce(sum(w) FILTER (v BETWEEN lo AND hi), sum(w))', 'accepted_weight')}
    FROM s LEFT JOIN b USING (k) GROUP BY k"""


def d2(spark, sf):
    df = f0_plain(spark, sf)
    scores = df.groupBy("frame_id").agg((F.max("value") / 5000).alias("score"))
    return rounded(st.stack_weighted(df, K, scores, **OPT))


def d9_frames(spark, sf):
    return st.rejection_report(f0_plain(spark, sf), K, "sigma", low=1.5, high=1.5, **OPT)[1]


def d11(spark, sf):
    df = f0(spark, sf).withColumn("label", F.col("seq") % 2)
    return rounded(st.accepted_groups(df, K, "label", "winsorized", low=1.5, high=1.5, **OPT))


def d12(spark, sf):
    df = f0(spark, sf).withColumn("variance", 1 + F.col("frame_id") % 5)
    return rounded(st.noise_diagnostic(df, K, "seq", "variance", "sigma", low=2.0, high=2.0, **OPT))


def i4(spark, sf):
    df = f0(spark, sf)
    parts = [st.accumulate(df.where(F.col("seq") % 2 == h), K, **OPT) for h in (0, 1)]
    return rounded(st.render_accumulator(st.merge_accumulators(*parts, keys=K), K))


def moments():
    """Weighted spread as a caller's own combination: weight, mean and squares around it, joined pairwise."""
    def part(v, w):
        mass = float(w.sum())
        mean = float((v * w).sum() / mass)
        return mass, mean, float((w * (v - mean) ** 2).sum())

    def join(a, b):
        mass, gap = a[0] + b[0], b[1] - a[1]
        return mass, a[1] + gap * b[0] / mass, a[2] + b[2] + gap * gap * a[0] * b[0] / mass

    return part, join, lambda s: (s[2] / s[0]) ** 0.5


QUERIES = {
    "D1_stack_average": lambda s, sf: rounded(st.stack_average(f0_gaps(s, sf), K, **OPT)),
    "D2_stack_weighted": d2,
    "D3_stack_median": lambda s, sf: rounded(st.stack_median(f0_plain(s, sf), K, **OPT)),
    "D4_stack_sigma": lambda s, sf: rounded(st.stack_sigma(f0_plain(s, sf), K, low=1.5, high=1.5, **OPT)),
    "D5_stack_sigma_mad": lambda s, sf: rounded(st.stack_sigma_mad(f0_plain(s, sf), K, low=1.5, high=1.5, **OPT)),
    "D6_stack_winsorized": lambda s, sf: rounded(st.stack_winsorized(f0_gaps(s, sf), K, low=2.0, high=2.0, **OPT)),
    "D7_stack_percentile": lambda s, sf: rounded(st.stack_percentile(f0_plain(s, sf), K, low=0.1234567, high=0.8765432, **OPT)),
    "D8_stack_max": lambda s, sf: rounded(st.stack_extreme(f0_plain(s, sf), K, "max")),
    "D8_stack_min": lambda s, sf: rounded(st.stack_extreme(f0_plain(s, sf), K, "min")),
    "D9_rejection_frames": d9_frames,
    "D10_weighted_quantile": lambda s, sf: rounded(stats.weighted_quantile(
        f0_plain(s, sf), K, "value", "coverage", 0.9)),
    "D11_accepted_groups": d11,
    "D12_noise_diagnostic": d12,
    "G5_distinct_inputs": lambda s, sf: st.require_distinct_inputs(f0_plain(s, sf), K),
    "I4_merge_accumulators": i4,
    "J4_stack_with": lambda s, sf: rounded(st.stack_with(
        f0_plain(s, sf), K, lambda v, w: float((v * w).sum() / w.sum()), **OPT)),
    "J4_stack_merged": lambda s, sf: rounded(st.stack_merged(f0_plain(s, sf), K, *moments(), **OPT)),
}

ORACLES = {
    "D1_stack_average": f"""WITH s AS ({prep(F0N)}) SELECT k, {sr('sum(v*w)/sum(w)', 'value')},
      {sr('sum(cw)/sum(fw)', 'coverage')}, count(v) AS samples FROM s GROUP BY k""",
    "D2_stack_weighted": f"""WITH f AS ({F0}), q AS (SELECT frame_id, greatest(0.01, max(value)/5000) AS score FROM f GROUP BY 1),
      s AS (SELECT k, value AS v, coverage, frame_weight*score AS fw FROM f JOIN q USING (frame_id))
      SELECT k, {sr('sum(v*coverage*fw)/sum(coverage*fw)', 'value')}, {sr('sum(coverage*fw)/sum(fw)', 'coverage')},
      count(v) AS samples FROM s GROUP BY k""",
    "D3_stack_median": stack_sql("median"),
    "D4_stack_sigma": stack_sql("sigma", 1.5, 1.5),
    "D5_stack_sigma_mad": stack_sql("sigma_mad", 1.5, 1.5),
    "D6_stack_winsorized": stack_sql("winsorized", 2.0, 2.0, F0N),
    "D7_stack_percentile": stack_sql("percentile", 0.1234567, 0.8765432),
    **{f"D8_stack_{w}": f"""SELECT k, {sr(w + '(value)', 'value')}, {sr('sum(coverage)/count(*)', 'coverage')},
      count(value) AS samples FROM ({F0}) GROUP BY k""" for w in ("max", "min")},
    "D9_rejection_frames": f"""WITH s AS ({prep()}), {bounds_sql('sigma', low=1.5, high=1.5)}
      SELECT frame_id, count(v) AS compared, count(*) FILTER (v < lo) AS low, count(*) FILTER (v > hi) AS high
      FROM s JOIN b USING (k) GROUP BY frame_id""",
    "D10_weighted_quantile": f"""SELECT k, {sr('quantile')} FROM ({sql_mid(f'({F0})', 'k', 'value', 'coverage', {'quantile': 0.9})})""",
    "D11_accepted_groups": f"""WITH s AS ({prep()}), {bounds_sql('winsorized', low=1.5, high=1.5)},
      a AS (SELECT *, v BETWEEN lo AND hi OR max(CAST(v BETWEEN lo AND hi AS INT)) OVER (PARTITION BY k) = 0 AS ok FROM s JOIN b USING (k))
      SELECT k, {','.join(f"{sr(f'sum(v*w) FILTER (ok AND seq % 2 = {g}) / sum(w) FILTER (ok AND seq % 2 = {g})', f'mean_{g}')}, {sr(f'coalesce(sum(w) FILTER (ok AND seq % 2 = {g}), 0)', f'weight_{g}')}" for g in (0, 1))}
      FROM a GROUP BY k""",
    "D12_noise_diagnostic": f"""WITH s0 AS ({prep()}), z AS (SELECT *, 1 + frame_id % 5 AS nv, seq % 2 AS h FROM s0),
      g AS (SELECT k, CAST(2 AS BIGINT) AS h, v, w, nv FROM z UNION ALL SELECT k, h, v, w, nv FROM z),
      b0 AS (SELECT k, h, sum(v*w)/sum(w) AS mid FROM g GROUP BY k, h),
      b AS (SELECT k, h, any_value(mid) - 2.0*sqrt(sum((v-mid)*(v-mid)*w)/sum(w)) AS lo,
          any_value(mid) + 2.0*sqrt(sum((v-mid)*(v-mid)*w)/sum(w)) AS hi FROM g JOIN b0 USING (k, h) GROUP BY k, h),
      a AS (SELECT *, v BETWEEN lo AND hi OR max(CAST(v BETWEEN lo AND hi AS INT)) OVER (PARTITION BY k, h) = 0 AS ok FROM g JOIN b USING (k, h)),
      m AS (SELECT k, h, sum(v*w) FILTER (ok)/sum(w) FILTER (ok) AS mean, sum(w*w*nv) FILTER (ok)/(sum(w) FILTER (ok)*sum(w) FILTER (ok)) AS var,
          count(*) FILTER (ok) AS n FROM a GROUP BY k, h),
      p AS (SELECT k, max(mean) FILTER (h=0) - max(mean) FILTER (h=1) AS diff, max(var) FILTER (h=2) AS vf,
          max(var) FILTER (h=0) + max(var) FILTER (h=1) AS vd, coalesce(max(n) FILTER (h=0), 0) >= 3 AND coalesce(max(n) FILTER (h=1), 0) >= 3 AS valid FROM m GROUP BY k)
      SELECT k, CASE WHEN valid THEN round(diff*sqrt(vf/vd) + CAST(1e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE) END AS noise, valid FROM p""",
    "G5_distinct_inputs": f"SELECT k, frame_id, count(*) AS copies FROM ({F0}) GROUP BY 1, 2 HAVING count(*) > 1",
    "I4_merge_accumulators": f"""WITH s AS ({prep()}) SELECT k, {sr('sum(v*w)/sum(w)', 'value')}, count(v) AS samples FROM s GROUP BY k""",
    "J4_stack_with": f"""WITH s AS ({prep()}) SELECT k, {sr('sum(v*w)/sum(w)', 'value')} FROM s GROUP BY k""",
    "J4_stack_merged": f"""WITH s AS ({prep()}), m AS (SELECT k, sum(v*w)/sum(w) AS mid FROM s GROUP BY k)
      SELECT k, {sr('sqrt(sum(w*(v-mid)*(v-mid))/sum(w))', 'value')} FROM s JOIN m USING (k) WHERE v IS NOT NULL GROUP BY k""",
}

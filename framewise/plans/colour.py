"""Queries and oracles of the projection and colour operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import color as c
from .fixtures import F1, F1C, F1C_WIDE, f1, f1c, rounded, sr

L = "(0.2126*r + 0.7152*g + CAST(0.0722 AS DOUBLE)*b)"
ELLIPSES = [{"x": 2.0, "y": 3.0, "a": 2.5, "b": 1.2, "angle": 30.0}, {"x": 6.0, "y": 6.0, "a": 1.5, "b": 1.5, "angle": 0.0}]


def long_sql(r: str, g: str, b: str, source: str = F1C_WIDE, pre: str = "") -> str:
    """Long rows of three wide expressions."""
    cols = "*" + (f", {pre}" if pre else "")
    return f"""WITH w AS (SELECT {cols} FROM ({source})) """ + " UNION ALL ".join(
        f"SELECT frame_id, x, y, CAST({i} AS INT) AS channel, {sr(e, 'value')}, CAST(1 AS DOUBLE) AS coverage FROM w"
        for i, e in enumerate((r, g, b)))


def cl(e: str) -> str:
    return f"greatest(0, least(1, {e}))"


def ghs_sql(x: str) -> str:
    """D=1.5, b=-0.6, SP=.4, LP=.1, HP=.9 written out with its own arithmetic."""
    d = "(exp(1.5)-1)"
    # Integral of the slope d*(1 + 0.6*d*t)^(-1/0.6) from 0 to t.
    base = lambda t: f"((pow(1 + 0.6*{d}*({t}), 1 - 1/0.6) - 1) / (0.6*(1 - 1/0.6)))"
    slope = lambda t: f"({d}*pow(1 + 0.6*{d}*({t}), -1/0.6))"
    ql, qh = f"(-{base('0.3')})", base("0.5")
    q0 = f"({ql} - 0.1*{slope('0.3')})"
    span = f"({qh} + 0.1*{slope('0.5')} - {q0})"
    q = (f"CASE WHEN {x} < 0.1 THEN {ql} + ({x}-0.1)*{slope('0.3')} WHEN {x} > 0.9 THEN {qh} + ({x}-0.9)*{slope('0.5')} "
         f"WHEN {x} < 0.4 THEN -{base(f'greatest(0, 0.4-{x})')} ELSE {base(f'greatest(0, {x}-0.4)')} END")
    return f"CASE WHEN {x} = 0 OR {x} = 1 THEN {x} ELSE {cl(f'(({q}) - {q0})/{span}')} END"


GHS = dict(log_stretch=1.5, intensity=-0.6, symmetry=0.4, low=0.1, high=0.9)
STR = lambda x: f"(asinh(pow({cl(f'({x}-0.2)/(0.7)')}, ln(0.5)/ln(0.3))*5)/asinh(5))"
CURVE = [(0.0, 0.05), (0.3, 0.2), (0.6, 0.75), (1.0, 0.95)]


def curve_sql(x: str) -> str:
    s = [0.5, (0.75 - 0.2) / 0.3, 0.2 / 0.4]
    tan = [s[0], min((s[0] + s[1]) / 2, 3 * min(s[0], s[1])), min((s[1] + s[2]) / 2, 3 * min(s[1], s[2])), s[2]]
    text = "CASE WHEN v <= 0 THEN 0.05"
    for i in range(3):
        (a, ya), (b, yb) = CURVE[i], CURVE[i + 1]
        t, h = f"((v-{a})/{b - a!r})", b - a
        text += (f" WHEN v <= {b} THEN (2*{t}*{t}*{t}-3*{t}*{t}+1)*{ya} + ({t}*{t}*{t}-2*{t}*{t}+{t})*{h * tan[i]!r}"
                 f" + (3*{t}*{t}-2*{t}*{t}*{t})*{yb} + ({t}*{t}*{t}-{t}*{t})*{h * tan[i + 1]!r}")
    return cl(text + " ELSE 0.95 END").replace("v-", f"{cl(x)}-").replace("v <=", f"{cl(x)} <=")


def b9(s, sf):
    df = c.suppress_green(f1c(s, sf), 0.8, limit=0.6, threshold=0.01)
    return rounded(df).drop("coverage")


def f1c_gaps(s, sf):
    return f1c(s, sf).withColumn("value", F.when((F.col("frame_id") + F.col("x") + F.col("channel")) % 9 != 0, F.col("value")))


F1C_GAPS = f"SELECT * REPLACE (CASE WHEN (frame_id + x + channel) % 9 <> 0 THEN value END AS value) FROM ({F1C})"

QUERIES = {
    "B1_luminance": lambda s, sf: rounded(c.luminance(f1c(s, sf))),
    "B2_with_coverage": lambda s, sf: rounded(c.with_coverage(f1c_gaps(s, sf))),
    "B3_crop": lambda s, sf: rounded(c.crop(f1(s, sf), 2, 1, 4, 5)),
    "B4_exclude_ellipses": lambda s, sf: rounded(c.exclude_ellipses(f1(s, sf), ELLIPSES)),
    "B5_stretch": lambda s, sf: rounded(c.stretch(f1c(s, sf), 0.2, 0.3, 0.9, 5.0)),
    "B5_stretch_color": lambda s, sf: rounded(c.stretch_color(f1c(s, sf), 0.2, 0.3, 0.9, 5.0)),
    "B6_generalized_stretch": lambda s, sf: rounded(c.generalized_stretch(f1c(s, sf), **GHS, black=0.1, white=0.9)),
    "B6_generalized_stretch_color": lambda s, sf: rounded(c.generalized_stretch_color(f1c(s, sf), **GHS)),
    "B6_stretch_totals": lambda s, sf: c.stretch_report(c.generalized_stretch(f1c(s, sf), **GHS, black=0.1, white=0.9))[0],
    "B6_stretch_histogram": lambda s, sf: c.stretch_report(c.generalized_stretch(f1c(s, sf), **GHS, black=0.1, white=0.9))[1],
    "B7_tone_curve": lambda s, sf: rounded(c.tone_curve(f1c(s, sf), CURVE)),
    "B8_saturation": lambda s, sf: rounded(c.saturation(f1c(s, sf), 0.5)),
    "B9_suppress_green": b9,
    "B10_neutralize_background": lambda s, sf: rounded(c.neutralize_background(f1c(s, sf), 0.7)),
    "B11_compose_channels": lambda s, sf: rounded(c.compose_channels(
        f1c_gaps(s, sf), {"R": "A + 0.5*max(B, C)", "G": "max(sqrt(B - 0.45), 0.1) / C", "B": "min(abs(C) - pow(A, 2), 1 / (A - A + C))"})),
    "B12_compose_two_line": lambda s, sf: rounded(c.compose_two_line(f1c_gaps(s, sf), 0.3)),
    "B13_apply_gains": lambda s, sf: rounded(c.apply_gains(f1c(s, sf), (1.2, 1.0, 0.8))),
    "D23_histogram": lambda s, sf: rounded(c.histogram(f1(s, sf), 64)),
    "D23_histogram_summary": lambda s, sf: rounded(c.histogram_summary(f1(s, sf))),
    "D24_auto_stretch": lambda s, sf: rounded(c.auto_stretch_params(f1(s, sf))),
}

N = cl("(value-0.1)/(CAST(0.9 AS DOUBLE)-0.1)")
GHS_ROWS = f"SELECT *, {N} AS normalized, value < 0.1 AS below, value > 0.9 AS above FROM ({F1C})"
GREEN_BLEND = f"""CASE WHEN g - (r+b)/2 > 0.01 THEN {cl(f"0.8*(1 - (ss*ss*(3-2*ss)))*{cl(f'(g-(r+b)/2)/greatest(0.03, {L}*0.35)')}")} ELSE 0 END"""
IN_ELLIPSE = " OR ".join(
    f"pow(((x-{e['x']})*cos(radians({e['angle']}))+(y-{e['y']})*sin(radians({e['angle']})))/{e['a']},2)"
    f"+pow(((y-{e['y']})*cos(radians({e['angle']}))-(x-{e['x']})*sin(radians({e['angle']})))/{e['b']},2) <= 1" for e in ELLIPSES)

ORACLES = {
    "B1_luminance": f"SELECT frame_id, x, y, {sr(L, 'value')}, CAST(1 AS DOUBLE) AS coverage FROM ({F1C_WIDE})",
    "B2_with_coverage": f"""SELECT frame_id, x, y, channel, {sr('value')},
      CASE WHEN count(value) OVER (PARTITION BY frame_id, x, y) < 3 THEN CAST(0 AS DOUBLE) ELSE coverage END AS coverage FROM ({F1C_GAPS})""",
    "B3_crop": f"""SELECT frame_id, x - 2 AS x, y - 1 AS y, channel, {sr('value')}, coverage FROM ({F1})
      WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5""",
    "B4_exclude_ellipses": f"SELECT frame_id, x, y, channel, {sr('value')}, coverage FROM ({F1}) WHERE NOT ({IN_ELLIPSE})",
    "B5_stretch": f"SELECT frame_id, x, y, channel, {sr(STR('value'), 'value')}, coverage FROM ({F1C})",
    "B5_stretch_color": long_sql(*[f"CASE WHEN {L}-0.2 <= 1e-6 THEN m ELSE {cl(f'({k}-0.2)*m/({L}-0.2)')} END" for k in "rgb"], pre=f"{STR(L)} AS m"),
    "B6_generalized_stretch": f"""SELECT frame_id, x, y, channel, coverage, {sr('normalized')}, below, above,
      {sr(ghs_sql('normalized'), 'value')} FROM ({GHS_ROWS})""",
    "B6_generalized_stretch_color": f"""WITH n AS (SELECT frame_id, x, y, {cl('r')} AS r, {cl('g')} AS g, {cl('b')} AS b FROM ({F1C_WIDE})),
      m AS (SELECT *, CASE WHEN {L} > 0 THEN ({ghs_sql(L)})/{L} END AS f, {ghs_sql('r')} AS mr, {ghs_sql('g')} AS mg, {ghs_sql('b')} AS mb FROM n),
      t AS (SELECT *, least(1, CASE WHEN r*f > 1 THEN (1-mr)/(r*f-mr) ELSE 1 END, CASE WHEN g*f > 1 THEN (1-mg)/(g*f-mg) ELSE 1 END,
        CASE WHEN b*f > 1 THEN (1-mb)/(b*f-mb) ELSE 1 END) AS t FROM m)
      """ + " UNION ALL ".join(f"""SELECT frame_id, x, y, CAST({i} AS INT) AS channel,
        {sr(f'CASE WHEN f IS NULL THEN m{k} ELSE {cl(f"t*{k}*f + (1-t)*m{k}")} END', 'value')}, CAST(1 AS DOUBLE) AS coverage FROM t"""
                               for i, k in enumerate("rgb")),
    "B6_stretch_totals": f"SELECT count(value) AS covered, count(*) FILTER (below) AS below, count(*) FILTER (above) AS above FROM ({GHS_ROWS})",
    "B6_stretch_histogram": f"""WITH g AS (SELECT normalized, {ghs_sql('normalized')} AS v FROM ({GHS_ROWS}))
      SELECT 'before' AS stage, CAST(least(255, floor(normalized*256)) AS INT) AS bin, count(*) AS samples FROM g GROUP BY 1, 2 UNION ALL
      SELECT 'after', CAST(least(255, floor(v*256)) AS INT), count(*) FROM g GROUP BY 1, 2""",
    "B7_tone_curve": f"SELECT frame_id, x, y, channel, {sr(curve_sql('value'), 'value')}, coverage FROM ({F1C})",
    "B8_saturation": long_sql(*[cl(f"{L} + ({k}-{L})*1.5") for k in "rgb"]),
    "B9_suppress_green": f"""WITH w0 AS (SELECT *, {cl(f'({L} - 0.6*0.65)/(CAST(0.6 AS DOUBLE) - 0.6*0.65)')} AS ss FROM ({F1C_WIDE})),
      w AS (SELECT *, {GREEN_BLEND} AS bl FROM w0) """ + " UNION ALL ".join(
        f"SELECT frame_id, x, y, CAST({i} AS INT) AS channel, {sr(e, 'value')}, bl > 0 AS affected FROM w"
        for i, e in enumerate(("r", f"CASE WHEN bl > 0 THEN {cl('g + ((r+b)/2 - g)*bl')} ELSE g END", "b"))),
    "B10_neutralize_background": f"""WITH s AS ({F1C}), m AS (SELECT frame_id, channel, quantile_cont(value, 0.5) AS med FROM s GROUP BY 1, 2),
      t AS (SELECT frame_id, avg(med) AS target FROM m GROUP BY 1)
      SELECT frame_id, x, y, channel, {sr(cl('value*(1 + (target/greatest(1e-6, med) - 1)*0.7)'), 'value')}, coverage
      FROM s JOIN m USING (frame_id, channel) JOIN t USING (frame_id)""",
    "B11_compose_channels": f"""WITH w AS (SELECT frame_id, x, y, max(value) FILTER (channel=0) AS a, max(value) FILTER (channel=1) AS b,
        max(value) FILTER (channel=2) AS c FROM ({F1C_GAPS}) GROUP BY ALL),
      e AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND b >= 0.45 AND c <> 0 AS ok FROM w)
      SELECT frame_id, x, y, {sr('CASE WHEN ok THEN a + 0.5*greatest(b, c) ELSE 0 END', 'r')},
      {sr('CASE WHEN ok THEN greatest(sqrt(greatest(0, b - 0.45)), 0.1)/c ELSE 0 END', 'g')}, {sr('CASE WHEN ok THEN least(abs(c) - a*a, 1/c) ELSE 0 END', 'b')},
      CAST(ok AS INT) AS validity FROM e""",
    "B12_compose_two_line": f"""WITH w AS (SELECT frame_id, x, y, max(value) FILTER (channel=0) AS h, max(value) FILTER (channel=1) AS o FROM ({F1C_GAPS}) GROUP BY ALL)
      SELECT frame_id, x, y, {sr('CASE WHEN h IS NULL OR o IS NULL THEN 0 ELSE h END', 'r')},
      {sr('CASE WHEN h IS NULL OR o IS NULL THEN 0 ELSE 0.3*h + 0.7*o END', 'g')},
      {sr('CASE WHEN h IS NULL OR o IS NULL THEN 0 ELSE o END', 'b')}, CAST(h IS NOT NULL AND o IS NOT NULL AS INT) AS validity FROM w""",
    "B13_apply_gains": f"SELECT frame_id, x, y, channel, {sr('value * CASE channel WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 ELSE 0.8 END', 'value')}, coverage FROM ({F1C})",
    "D23_histogram": f"""SELECT frame_id, CAST(least(63, floor({cl('value')}*64)) AS INT) AS bin, {sr('sum(coverage)', 'weight')}
      FROM ({F1}) WHERE coverage > 1e-6 GROUP BY 1, 2""",
    "D23_histogram_summary": f"""SELECT frame_id, {sr(f"min({cl('value')})", 'minimum')}, {sr(f"max({cl('value')})", 'maximum')},
      {sr(f"sum({cl('value')}*coverage)/sum(coverage)", 'mean')} FROM ({F1}) WHERE coverage > 1e-6 GROUP BY 1""",
    "D24_auto_stretch": f"""WITH s AS (SELECT * FROM ({F1}) WHERE coverage > 1e-6),
      m AS (SELECT frame_id, quantile_cont(value, 0.5) AS bg, list_sort(list(value))[CAST(floor(0.998*(count(*)-1)) AS BIGINT)+1] AS wh,
        min(value) AS lo, max(value) AS hi FROM s GROUP BY 1),
      d AS (SELECT frame_id, 1.4826*quantile_cont(abs(value-bg), 0.5) AS sc FROM s JOIN m USING (frame_id) GROUP BY 1),
      p AS (SELECT *, greatest(lo, bg - 2.8*sc) AS bl FROM m JOIN d USING (frame_id)),
      q AS (SELECT frame_id, bg, sc, CASE WHEN wh-bl <= greatest(1, abs(bg), abs(lo), abs(hi))*1e-6 THEN bg - greatest(1, abs(bg), abs(lo), abs(hi))*1e-6 ELSE bl END AS bl,
        CASE WHEN wh-bl <= greatest(1, abs(bg), abs(lo), abs(hi))*1e-6 THEN bg + greatest(1, abs(bg), abs(lo), abs(hi))*1e-6 ELSE wh END AS wh FROM p)
      SELECT frame_id, {sr('bg', 'background')}, {sr('sc', 'scatter')}, {sr('bl', 'black')},
      {sr('greatest(0.001, least(0.999, pow(0.5, 1/(ln(0.25)/ln(greatest(0.001, least(0.999, (bg-bl)/(wh-bl))))))))', 'mid')}, {sr('wh', 'white')} FROM q""",
}

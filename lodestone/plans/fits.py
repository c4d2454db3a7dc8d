"""Calibrated and stacked scores, and lap starts, with the same fits in SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import calibration as cal
from lodestone.operators import temporal
from lodestone.plans.models import _SCORED, _scored
from lodestone.plans.registry import query
from lodestone.sources import load


def _determinant(m: list[list[str]]) -> str:
    """A determinant written out."""
    terms = []
    for p in permutations(range(len(m))):
        odd = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2
        terms.append(("-" if odd else "+") + "*".join(m[i][j] for i, j in enumerate(p)))
    return "(" + "".join(terms) + ")"


def _fit_sql(rows: str, by: list[str], x: int, steps: int = cal.STEPS, ridge: float = cal.RIDGE) -> str:
    """Newton steps as statements: ``rows`` has by, x1 to xn and y; the last one is ``w{steps}`` with w0 to wn."""
    n, names = x + 1, ", ".join(by)
    xs = ["1.0::DOUBLE", *[f"x{i}" for i in range(1, n)]]
    ws = [f"w{i}" for i in range(n)]
    cell = lambda i, j: f"(h{min(i, j)}{max(i, j)}{f' + {ridge}::DOUBLE' if i == j else ''})"
    matrix = [[cell(i, j) for j in range(n)] for i in range(n)]
    right = [f"(g{i} + {ridge}::DOUBLE * w{i})" for i in range(n)]
    out = [f"w_0 AS (SELECT {names}, {', '.join(f'0.0::DOUBLE AS {w}' for w in ws)} FROM {rows} GROUP BY {names})"]
    for s in range(steps):
        z = " + ".join(f"{w} * {v}" for w, v in zip(ws, xs, strict=True))
        sums = [f"sum((p - y) * {xs[i]}) AS g{i}" for i in range(n)] + [f"sum(p * (1 - p) * {xs[i]} * {xs[j]}) AS h{i}{j}" for i in range(n) for j in range(i, n)]
        solved = [f"w{k} - {_determinant([[right[i] if j == k else matrix[i][j] for j in range(n)] for i in range(n)])} / {_determinant(matrix)} AS w{k}" for k in range(n)]
        out.append(f"s_{s} AS (SELECT {names}, {', '.join(ws)}, {', '.join(sums)} FROM (SELECT r.*, {', '.join(ws)}, 1 / (1 + exp(-({z}))) AS p FROM {rows} r JOIN w_{s} USING ({names})) GROUP BY {names}, {', '.join(ws)})")
        out.append(f"w_{s + 1} AS (SELECT {names}, {', '.join(solved)} FROM s_{s})")
    return ",\n".join(out)


@query("calibrated_scores", f"""
WITH {_SCORED}, t AS (SELECT lang, prob AS x1, quality FROM s WHERE doc_id % 3 <> 0),
c AS (SELECT lang, count(*) AS n, sum(quality) AS n1, sum(1 - quality) AS n0 FROM t GROUP BY 1),
r AS (SELECT lang, x1, CASE WHEN quality = 1 THEN (n1 + 1)::DOUBLE / (n1 + 2) ELSE 1.0::DOUBLE / (n0 + 2) END AS y FROM t JOIN c USING (lang)),
{_fit_sql('r', ['lang'], 1)}
SELECT doc_id, round(CASE WHEN n >= 50 THEN 1 / (1 + exp(-(w0 + w1 * prob))) ELSE prob END, 6) AS calibrated FROM s LEFT JOIN w_{cal.STEPS} USING (lang) LEFT JOIN c USING (lang)
""")  # fmt: skip
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all labelled documents, calibrated for each language on two thirds of them; languages with few rows stay."""
    s = _scored(spark, sf_dir)
    out = cal.sigmoid_calibration(s.where("doc_id % 3 <> 0"), s, "prob", "quality", ["lang"])
    return out.select("doc_id", F.round("calibrated", 6).alias("calibrated"))


_CLASSES = ("click", "error", "purchase", "signup", "view")
_MODELS = """
k AS (SELECT event_id, day(ts)::INTEGER // 7 AS week, event_type, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS class FROM events),
u AS (SELECT *, (event_type = class)::INTEGER::DOUBLE AS y, (('0x' || left(md5(event_id || ':a:' || class), 6))::BIGINT % 1000) / 1000.0::DOUBLE AS ua, (('0x' || left(md5(event_id || ':b:' || class), 6))::BIGINT % 1000) / 1000.0::DOUBLE AS ub FROM k),
m AS (SELECT event_id, week, class, y, 0.8::DOUBLE * ua + 0.2::DOUBLE * y AS x1, 0.6::DOUBLE * ub + 0.1::DOUBLE * y AS x2 FROM u)
"""


@query("stacked_scores", f"""
WITH {_MODELS}, b AS (SELECT DISTINCT week AS upto FROM m), r AS (SELECT class, upto, x1, x2, y FROM m JOIN b ON week < upto), c AS (SELECT class, upto, count(*) AS n FROM r GROUP BY ALL),
{_fit_sql('r', ['class', 'upto'], 2)},
p AS (SELECT event_id, m.class, week, CASE WHEN n >= 50 THEN 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) ELSE (x1 + x2) / 2 END AS p
    FROM m LEFT JOIN w_{cal.STEPS} w ON w.class = m.class AND w.upto = week LEFT JOIN c ON c.class = m.class AND c.upto = week)
SELECT event_id, class, week, round(p / sum(p) OVER (PARTITION BY event_id), 6) AS stacked FROM p
""")  # fmt: skip
def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores for five classes as one distribution, each week fitted on the weeks before."""
    e = load(spark, sf_dir, "events").select("event_id", F.expr("day(ts) div 7").cast("int").alias("week"), "event_type", F.explode(F.array(*[F.lit(c) for c in _CLASSES])).alias("class"))
    noise = lambda m: (F.conv(F.left(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(f":{m}:"), F.col("class"))), F.lit(6)), 16, 10).cast("bigint") % 1000) / F.lit(1000.0)
    y = (F.col("event_type") == F.col("class")).cast("double")
    rows = e.select("event_id", "week", "class", (0.8 * noise("a") + 0.2 * y).alias("a"), (0.6 * noise("b") + 0.1 * y).alias("b"), y.alias("hit"))
    out = cal.stacked_scores(rows, "event_id", "week", "class", ["a", "b"], "hit")
    return out.select("event_id", "class", "week", F.round("stacked", 6).alias("stacked"))


@query("lap_starts", """
WITH o AS (SELECT user_id, ts, event_type, event_id, event_id % 7919 * 137 + event_id % 3 AS ms FROM events),
z AS (SELECT user_id, max(epoch_us(ts) - ms * 1000) AS us FROM o WHERE event_type IN ('click', 'view') GROUP BY 1),
r AS (SELECT user_id, us // 1000 + CASE WHEN us % 1000 > 500 OR (us % 1000 = 500 AND us // 1000 % 2 = 1) THEN 1 ELSE 0 END AS ms FROM z)
SELECT event_id, o.ms AS offset_ms, epoch_ms(r.ms)::TIMESTAMP AS origin, epoch_ms(r.ms + o.ms)::TIMESTAMP AS started FROM o LEFT JOIN r USING (user_id) WHERE event_type = 'purchase'
""")  # fmt: skip
def lap_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When laps began, from offsets (given as time spans) of two streams of each session."""
    k = F.col("event_id")
    ms = k % 7919 * 137 + k % 3
    clock = F.format_string("%d:%02d:%02d.%03d", F.expr("0") + F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", temporal.span_millis(clock).alias("offset_ms"))
    out = temporal.lap_starts(e.where(F.col("event_type").isin("click", "view")), e.where("event_type = 'purchase'").drop("ts"), "user_id", "ts", "offset_ms", "offset_ms")
    return out.select("event_id", "offset_ms", "origin", "started")

"""The same results as SQL, where SQL can express them on whole tables."""

_RANKING = """
WITH means AS (SELECT run_id, avg(aggregate) AS aggregate FROM (SELECT run_id, id, max(aggregate) AS aggregate FROM rubric_scores GROUP BY 1, 2) GROUP BY 1),
judged AS (SELECT run_id, max(overall) AS overall, max(groundedness) AS groundedness FROM llm_judge_summary GROUP BY 1),
grids AS (SELECT run_id, max(grid_id) AS grid_id FROM runs GROUP BY 1),
s AS (SELECT grid_id, run_id, aggregate, overall, groundedness FROM grids JOIN means USING (run_id) JOIN judged USING (run_id)
      WHERE aggregate IS NOT NULL AND overall IS NOT NULL AND groundedness IS NOT NULL),
m AS (SELECT grid_id, quantile_disc(aggregate, 0.5) AS m1, quantile_disc(overall, 0.5) AS m2, quantile_disc(groundedness, 0.5) AS m3 FROM s GROUP BY 1),
d AS (SELECT grid_id, quantile_disc(abs(aggregate - m1), 0.5) AS d1, quantile_disc(abs(overall - m2), 0.5) AS d2, quantile_disc(abs(groundedness - m3), 0.5) AS d3,
             avg(abs(aggregate - m1)) AS a1, avg(abs(overall - m2)) AS a2, avg(abs(groundedness - m3)) AS a3 FROM s JOIN m USING (grid_id) GROUP BY 1),
z AS (SELECT grid_id, run_id, aggregate, overall, groundedness,
             coalesce((aggregate - m1) / CASE WHEN d1 > 0 THEN d1 * 1.4826 WHEN a1 > 0 THEN a1 END, 0) AS z1,
             coalesce((overall - m2) / CASE WHEN d2 > 0 THEN d2 * 1.4826 WHEN a2 > 0 THEN a2 END, 0) AS z2,
             coalesce((groundedness - m3) / CASE WHEN d3 > 0 THEN d3 * 1.4826 WHEN a3 > 0 THEN a3 END, 0) AS z3
      FROM s JOIN m USING (grid_id) JOIN d USING (grid_id)),
c AS (SELECT *, exp(-(ln(1 + exp(-abs(z1))) + greatest(-z1, 0)) / 3 - (ln(1 + exp(-abs(z2))) + greatest(-z2, 0)) / 3 - (ln(1 + exp(-abs(z3))) + greatest(-z3, 0)) / 3) AS combined FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY round(combined, 10) DESC, run_id) AS place FROM c)
"""


def sql() -> dict[str, str]:
    return {
        "p3_found": _RANKING + "SELECT grid_id, run_id FROM r WHERE place = 1",
        "p3_ranking": _RANKING + "SELECT grid_id, run_id, round(aggregate, 10) AS aggregate, overall, groundedness, round(combined, 10) AS combined, CAST(place AS INTEGER) AS place FROM r",
    }

"""Windows over dense series: the same as counting row by row, with running sums only."""
import random

from weblens.operators import windows


def test_spread_files_counts_every_window_by_running_sums(spark):
    rng = random.Random(5)
    rows = [(f"/f{rng.randint(0, 3)}", rng.randint(0, 60000)) for _ in range(900)] + [("/f0", 21600 * 2 - 1), ("/f0", 21600 * 3 - 1), ("/mail", 50), ("/mail", 50), (None, 70), ("/f1", None)]
    out = windows.spread_files(spark.createDataFrame(rows, "base string, ts long"))
    want = {}
    for base, t in rows:
        if t is not None:
            want.setdefault(base, []).append(t)
    dense = {base: max(sum(a <= t <= a + 21600 for t in times) for a in times) for base, times in want.items()}
    assert {tuple(r) for r in out.collect()} == {(base, dense[base], len(t), dense[base] < 0.5 * len(t)) for base, t in want.items()}
    assert "RangeFrame" not in out._jdf.queryExecution().optimizedPlan().toString()  # a frame that slides is summed anew for every row

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced through a full execution with the no-op sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))



def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ["BENCH_CPUS"] = str(cpus)
    from panelcast.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)

    from panelcast.operators.bootstrap import bootstrap_granger, bootstrap_irf
    from panelcast.operators.diagnostics import diagnostics_report
    from panelcast.operators.forecast import forecast
    from panelcast.operators.granger import granger_matrix
    from panelcast.operators.interp import interpolate_linear
    from panelcast.operators.irf import irf
    from panelcast.operators.quality import null_count_ranking
    from panelcast.operators.var import fit_var
    from panelcast.plans import derived as D
    from panelcast.plans import pipelines as PL
    from panelcast.spec import Det, VarSpec

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    state = {}

    def fit():
        panel = PL.flag_panel(spark, sf_dir)
        state["panel"] = panel
        state["model"] = fit_var(panel, PL.FLAG_VARS, VarSpec(6, Det.CONST))
        state["model"].fits.count()

    def fit_wide():
        """One series of 14 variables and 990 days, 6 lags: the size of the published job."""
        state["days"] = D.daily_panel(spark, sf_dir, days=990)
        state["wide"] = fit_var(state["days"], D.DAILY_VARS, VarSpec(6, Det.CONST))
        state["wide"].fits.count()

    plan = [
        ("weekly_rollup", lambda: run(D.lineitem_weekly(spark, sf_dir))),
        ("hourly_grid_interpolate", lambda: run(interpolate_linear(D.events_hourly(spark, sf_dir), ["event_type"], ["ts"], ["value"], position="t"))),
        ("null_ranking", lambda: run(null_count_ranking(D.nation_weekly(spark, sf_dir), ["n_name"], D.NW_MEASURES))),
        ("training_table", lambda: run(PL.training_table(spark, sf_dir))),
        ("var_fit_p6", fit),
        ("forecast_10", lambda: run(forecast(state["model"], state["panel"], 10))),
        ("granger_matrix", lambda: run(granger_matrix(state["model"]))),
        ("irf_12", lambda: run(irf(state["model"], 12))),
        ("diagnostics_report", lambda: run(diagnostics_report(
            D.lineitem_weekly(spark, sf_dir).withColumnRenamed("l_returnflag", "series_id"),
            ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]))),
        ("bootstrap_irf_100", lambda: run(bootstrap_irf(state["model"], state["panel"], reps=100, horizon=12, seed=1))),
        ("bootstrap_irf_500", lambda: run(bootstrap_irf(state["model"], state["panel"], reps=500, horizon=12, seed=1))),
        ("bootstrap_granger_500", lambda: run(bootstrap_granger(state["model"], state["panel"], reps=500, seed=1))),
        ("panel_granger_all_series", lambda: run(granger_matrix(fit_var(
            PL.training_panel(spark, sf_dir), ["target", *PL.SHARED_COVARIATES], VarSpec(2, Det.CONST))))),
        ("var_fit_k14_p6", fit_wide),
        ("bootstrap_irf_500_k14_p6", lambda: run(bootstrap_irf(state["wide"], state["days"], reps=500, horizon=12, seed=1))),
        ("bootstrap_granger_500_k14_p6", lambda: run(bootstrap_granger(state["wide"], state["days"], reps=500, seed=1))),
    ]
    # JVM JIT / codegen and Python-worker start-up: the flagship pipeline on the smallest tables,
    # not timed (reported separately as warmup_sec)
    t0 = time.perf_counter()
    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm_dir):
        from panelcast.plans.pipelines import flagship_forecast
        run(flagship_forecast(spark, warm_dir))
    else:
        spark.range(100_000).selectExpr("sum(id)").collect()
    warmup = round(time.perf_counter() - t0, 3)
    times = {}
    for name, fn in plan:
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_wall_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus, "shuffle_partitions": cpus, "warmup_sec": warmup}))
    spark.stop()


if __name__ == "__main__":
    main()

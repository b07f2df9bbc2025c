"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once unmeasured (class generation, file cache) and is then timed to a full
result.  The bars are built outside the timing where a query is about features, as the published
timings of the reference also start from stored files.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidepanel.catalog import trading_queries as q
from tidepanel.catalog import views as v
from tidepanel.catalog.model_queries import FEATURES
from tidepanel.functions.tables import materialise
from tidepanel.operators import assemble, clean, ic, indicators, metrics, pnl, returns
from tidepanel.plans import portfolio as pf
from tidepanel.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    spark = local_session("bench")
    bars5 = materialise(v.bars(spark, SF_DIR), "bars5")
    bars50 = materialise(v.bars(spark, SF_DIR, "bars50"), "bars50")
    macro = materialise(v.macro(spark, SF_DIR), "macro")
    market = materialise(q.market(spark, SF_DIR), "market")
    scored = materialise(indicators.rsi(q.scored(bars5)), "scored")
    scored50 = materialise(indicators.rsi(q.scored(bars50)), "scored50")
    one = scored.filter("ticker = '5-LOW'")
    # Fixed value: the five strategies of the published single-series timing
    five = {**q.STRATEGIES, "label": lambda x: q.signals.ml_signal_label(x, "S"), "hold": pf.hold}

    def single_series(df):
        panel = pf.strategy_panel(pnl.asset_returns(df), five)
        held = pnl.positions_from_signals(panel, s=pf.PANEL)
        return metrics.performance_report(pnl.net_returns_flat(held, s=pf.PANEL), pf.PANEL)

    queries = {
        "bars_from_orders": lambda: v.bars(spark, SF_DIR, "bars50"),
        "clean": lambda: clean.clean(bars50),
        "technical": lambda: indicators.technical_all(bars50),
        "returns": lambda: returns.returns_all(bars50),
        "build_features_5": lambda: assemble.build_features(bars5, macro, v.LABELS),
        "build_features_50": lambda: assemble.build_features(bars50, macro, v.LABELS),
        "ic_matrix": lambda: ic.ic_matrix(scored50, [c for c in FEATURES if c in scored50.columns]),
        "single_series_5_strategies": lambda: single_series(one),
        "universe_5_strategies": lambda: single_series(scored50),
        "report": lambda: metrics.performance_report(pnl.net_returns_flat(q.held(bars50))),
        "portfolio_run_5": lambda: pf.portfolio_run(scored, market, q.STRATEGIES),
        "portfolio_run_50": lambda: pf.portfolio_run(scored50, market, q.STRATEGIES),
    }
    seconds = {}
    for name, query in queries.items():
        for _ in range(2):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            print(f"{name} {took:.2f}", file=sys.stderr, flush=True)
        seconds[name] = round(took, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cores": spark.sparkContext.defaultParallelism,
                "rows": {"bars5": bars5.count(), "bars50": bars50.count()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

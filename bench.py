"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Entities are suppliers here (a thousand at sf0.1). Each query runs twice and
the second time counts, so class loading is left out. Panel, features and books
are rebuilt from the given tables in the queries that name them; the others
read the staged tables of those, as a pipeline does.
"""

from __future__ import annotations

import json
import os
import time

from crosspanel.operators import alignment as A
from crosspanel.operators import breadth as BR
from crosspanel.operators import cross_section as X
from crosspanel.operators import diagnostics as D
from crosspanel.operators import evaluation as E
from crosspanel.operators import features as FE
from crosspanel.operators import linear as L
from crosspanel.operators import portfolio as PF
from crosspanel.operators import quality as Q
from crosspanel.operators import variants as V
from crosspanel.plans import tables as T
from crosspanel.plans.catalogue import QUERIES
from crosspanel.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ENTITY = "supplier"


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, int(CPUS))

    def fresh(build):
        T.forget_staged()
        return build()

    prices = lambda: T.prices_daily(spark, SF, ENTITY)                       # noqa: E731
    panel = lambda: T.panel(spark, SF, ENTITY)                               # noqa: E731
    preds = lambda: T.predictions(spark, SF, ENTITY)                         # noqa: E731
    ranked = lambda: T.ranked_features(spark, SF, ENTITY)                    # noqa: E731
    books = lambda: T.staged(spark, ("bench-weights", SF), lambda: PF.build_weights(preds(), "pred_b"))

    def costs():
        return PF.costs(PF.trades(books()), PF.average_dollar_volume(prices()), PF.annual_volatility(preds()))

    plan = {
        "daily_returns": lambda: run_all(A.daily_log_returns(prices())),
        "price_checks": lambda: run_all(Q.price_checks(prices())),
        "panel_build": lambda: fresh(panel),
        "winsorize_rank_neutralize": lambda: run_all(
            X.standardize(panel(), ["weekly_return", "trends_interest"])[0]),
        "features": lambda: run_all(FE.build_features(panel())),
        "feature_ranks": lambda: run_all(FE.rank_features(T.features(spark, SF, ENTITY))),
        "enet_walk_forward": lambda: run_all(L.walk_forward_enet(ranked())[0]),
        "enet_nested": lambda: run_all(L.nested_enet(ranked())[0]),
        "rank_ic": lambda: run_all(E.rank_ic(preds(), "pred_a")),
        "sector_ic": lambda: run_all(E.sector_ic(preds(), "pred_a")),
        "coupling": lambda: run_all(E.coupling(panel(), E.weekly_dollar_volume(prices()))),
        "book_weights": lambda: run_all(PF.build_weights(preds(), "pred_b")),
        "book_costs": lambda: run_all(costs()),
        "book_performance": lambda: run_all(PF.performance(PF.returns(books(), costs()))),
        "weight_blend": lambda: run_all(V.build_variant(preds(), "pred_b", "weight_blend")),
        "residual_report": lambda: run_all(D.residual_report(preds(), "pred_a")),
        "effective_breadth": lambda: run_all(BR.effective_breadth(panel())),
        "news_timeline": lambda: run_all(QUERIES["s06_tone_volume_assembly"](spark, SF)),
        "anchor_rescale": lambda: run_all(QUERIES["c13_rescale_ffill"](spark, SF)),
    }
    seconds = {}
    for name, work in plan.items():
        work()
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)
    # The JSON line is the last thing printed.
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()

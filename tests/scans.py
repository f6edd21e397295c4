"""Rows that the file scans of a plan hand on, from the metrics of its run."""


def _nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    elif kind == "ReusedExchangeExec":
        return
    else:
        yield plan
        for inner in (plan.children(), plan.subqueries()):
            for i in range(inner.size()):
                yield from _nodes(inner.apply(i))


def scans(df):
    """(location, rows) of each file scan after a run of ``df``."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    found = []
    for node in _nodes(plan):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append((node.relation().location().rootPaths().mkString(","), node.metrics().apply("numOutputRows").value()))
    return found


def rows_scanned(df) -> int:
    return sum(n for _, n in scans(df))

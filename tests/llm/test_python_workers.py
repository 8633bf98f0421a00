"""No task of the pipeline holds two Python workers: they stay after it, with all that they have learned, beside the next task's."""

import re

import corpus_pipeline
from slantree.llm import line_dedup

PYTHON = re.compile("MapInArrow|ArrowEvalPython|BatchEvalPython|InArrow|InPandas")


def plans(spark, after: int) -> list[tuple[int, str]]:
    """The physical plans that ran after an execution's number, as they ended."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    all_ = [found.apply(k) for k in range(found.size())]
    return [(e.executionId(), e.physicalPlanDescription()) for e in all_ if e.executionId() > after]


def chained(plan: str) -> list[list[str]]:
    """Paths of operators, between exchanges, with more than one in Python."""
    tree = plan.split("== Initial Plan ==")[0].split("\n\n")[0]
    out, stack = [], []
    for line in tree.split("\n"):
        node = re.match(r"^([\s:+\-*]*)(\w+)", line)
        if not node or "==" in line:
            continue
        depth = len(re.match(r"^[\s:+\-]*", line)[0])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, node[2]))
        path = [name for _, name in stack]
        edge = max((k for k, name in enumerate(path) if "Exchange" in name), default=-1)
        within = [name for name in path[edge + 1 :] if PYTHON.search(name)]
        if len(within) > 1:
            out.append(path[edge + 1 :])
    return out


def ran(spark) -> int:
    return max((k for k, _ in plans(spark, -1)), default=-1)


def test_chains_are_seen():
    plan = "== Physical Plan ==\nAdaptiveSparkPlan (9)\n+- == Final Plan ==\n   * HashAggregate (5)\n   +- MapInArrow (4)\n      +- * Filter (3)\n         +- ArrowEvalPython (2)\n            +- Scan parquet  (1)\n"
    assert chained(plan)
    assert not chained(plan.replace("* Filter", "Exchange"))


def test_language_stage_has_one_worker_a_task(spark):
    docs, before = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ran(spark)
    assert corpus_pipeline.keep_known_language(spark, docs, "").count()
    own = plans(spark, before)
    assert any(PYTHON.search(p) for _, p in own)
    assert [c for _, p in own for c in chained(p)] == []


def test_line_links_have_one_worker_a_task(spark):
    docs, before = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ran(spark)
    rows = line_dedup.line_links(docs).collect()
    assert len(rows) == docs.count() and sum(r["n_links"] for r in rows)
    own = plans(spark, before)
    assert any(PYTHON.search(p) for _, p in own)
    assert [c for _, p in own for c in chained(p)] == []

"""Extracted files in the phase that lists them first."""

import random

from siltstone.operators import plan_rules as P


def test_listed_once_equals_first_listed(spark):
    rnd = random.Random(3)
    plan = [(rnd.randrange(3), rnd.choice("mn"), at, f"src/{rnd.choice('abcd')}.x.c") for at in range(20)] + [(0, "m", 99, None)]
    plan = spark.createDataFrame(plan, "phase int, module string, at int, path string")
    files = spark.createDataFrame([(f"src/{rnd.choice('abce')}.x-c/f{rnd.randrange(5)}{rnd.choice(['.c', '.c.spec.json'])}",) for _ in range(60)], "file string")
    want = sorted(map(tuple, P.first_listed(P.phase_functions(plan, files)).collect()))
    once = P.listed_once(plan, files)
    assert sorted(map(tuple, once.collect())) == want != []
    # What is reduced is the plan: the rows of all phases and files aren't made.
    assert "file" not in once._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [path")[1].split("\n")[0]

"""Batches of random scenarios against the loops of ``bruteforce``."""

from __future__ import annotations

from collections import defaultdict

import data
import pytest
from bruteforce import Company, report

from staffcast.plans.report import score_scenarios

MERGED = {"HW": "RH", "RX": "RH", "PV": "E4"}


def grouped(rows):
    """Head count added up by unit and project, missing if a part is missing."""
    groups = defaultdict(list)
    for h in rows:
        function = MERGED.get(h["sub_job_family"], h["sub_job_family"])
        groups[
            h["div"], h["deptid"], h["project_code"], h["project_name"], function
        ].append(h["HC"])
    return [
        {
            "div": k[0], "deptid": k[1], "project_name": k[3], "sub_job_family_2": k[4],
            "hc": None if None in v else sum(v),
        }
        for k, v in groups.items()
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_loops(spark, seed):
    fact = data.random_company(seed)
    asked, planned, staffed = data.random_plans(seed, 60)
    actual = defaultdict(dict)
    result = score_scenarios(
        data.fact(spark, fact),
        data.scenarios(spark, asked),
        data.projects(spark, planned),
        data.heads(spark, staffed),
    )
    for row in result.collect():
        key = row["Type"], row["Title"]
        assert key not in actual[row["scenario_id"]]
        actual[row["scenario_id"]][key] = [float(v) for v in row[4:]]
    company = Company(fact)
    refused = 0
    for s, division in asked:
        expected = report(
            company, division,
            [p for p in planned if p["scenario_id"] == s],
            grouped([h for h in staffed if h["scenario_id"] == s]),
        )
        refused += expected is None
        expected = expected or {}
        assert set(actual[s]) == set(expected), s
        for key, values in expected.items():
            assert actual[s][key] == pytest.approx(values, abs=1e-9), (s, key)
    assert refused > 0

"""Golden counts (FIXTURES.md §3.1) at sf0.01 for every layout and dialect,
and the layout agreement the reference checks across engines."""

import pytest

from logvault.layouts import LAYOUTS, get_layout
from logvault.operators.search import count_hits_many
from logvault.plans.standard import FIXTURE, searches
from logvault.sources.fixtures import event_log_lines
from tests.conftest import SF_ORACLE

# Hits of the six searches on the sf0.01 log fixture.
GOLDEN = {
    "sql": {"q1": 1960, "q2": 107, "q3": 3334, "q4": 1198, "q5": 705, "q6": 460},
    "kql": {"q1": 1960, "q2": 107, "q3": 1667, "q4": 1451, "q5": 705, "q6": 460},
    "pairwise": {"q1": 1960, "q2": 107, "q3": 3334, "q4": 1451, "q5": 705, "q6": 460},
    "es": {"q1": 1960, "q2": 107, "q3": 1667, "q4": 1451, "q5": 705, "q6": 460},
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_golden_counts_every_dialect(spark, layout):
    lay = get_layout(layout)
    df = lay.build(event_log_lines(spark, SF_ORACLE))
    preds = {f"{d}_{q}": p for d in GOLDEN for q, p in searches(d, FIXTURE).items()}
    got = count_hits_many(df, lay, preds).first().asDict()
    for d, counts in GOLDEN.items():
        assert {q: got[f"{d}_{q}"] for q in counts} == counts, (layout, d)

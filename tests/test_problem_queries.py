import pytest
from dirty import write_tables

from almagest.plans.problems import QUERIES

NAMES = ["stocks_daily", "corporate_actions", "index_daily", "fundamentals_actuals", "report_calendar_us", "decide_requests"]


@pytest.mark.parametrize("empty", [True, False])
def test_empty_and_dirty_tables(spark, tmp_path, empty):
    """No rows from no rows; nulls in any column and repeated rows break nothing."""
    write_tables(spark, str(tmp_path), NAMES, empty)
    for name, query in QUERIES.items():
        n = query(spark, str(tmp_path)).count()
        assert (n == 0) == empty, name

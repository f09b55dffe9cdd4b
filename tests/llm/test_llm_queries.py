"""The registered queries of the training-data operators: SQL twins, and full row counts."""

import oracle
import pytest

from loomwright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert not oracle.differences(QUERIES[name](spark, SF).toPandas(), oracle.connect(SF).sql(ORACLE_SQL[name]).df())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_llm_is_not_imported_elsewhere():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "loomwright"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]
    assert not users

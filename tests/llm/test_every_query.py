"""What all queries of the subpackage have in common."""

import pytest

from setweave.llm.queries import ORACLES, QUERIES

from ..oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ours, theirs = both(spark, SF, QUERIES[name], ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_give_one_row_each(spark, name, sf, odd):
    got = QUERIES[name](spark, sf)
    ids = lambda d: sorted((r["doc_id"] for r in d.select("doc_id").collect()), key=str)
    assert ids(got) == ids(odd)
    again = {r["doc_id"]: [] for r in got.collect()}
    for r in got.collect():
        again[r["doc_id"]].append(tuple(r))
    assert len(set(again[4])) == 1  # repeated rows get equal results


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, name, empty):
    assert QUERIES[name](spark, empty).count() == 0


def test_ten_operators():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]

"""Every query with SQL gives the rows that the SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__

SQL = __spark_entry__.oracle_sql()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: x if x is None or isinstance(x, (int, float, str, bool)) else str(x)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{small}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, con, name):
    got = __spark_entry__.queries()[name](spark, small)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def ranked(rows, by, most, score="score"):
    """Ranks from 1 on without gaps, scores that fall, at most so many a key."""
    held = {}
    for r in rows:
        held.setdefault(r[by], []).append((r["rank"], r[score]))
    for v in held.values():
        v.sort()
        assert [i for i, _ in v] == list(range(1, len(v) + 1)) and len(v) <= most
        assert all(x >= y for (_, x), (_, y) in zip(v, v[1:]))
    return held


def found(rows):
    held = ranked(rows, "query_id", 20)
    assert held and all(r["total_found"] >= len(held[r["query_id"]]) and r["has_more"] == (r["total_found"] > 20) for r in rows)
    assert all(r["semantic_score"] >= 0.55 or max(r["exact_phrase"], r["full_name_cover"], r["full_category_cover"], r["corrected_overlap"]) >= 0.52 or r["name_overlap"] > 0 for r in rows)


def dense(rows):
    found(rows)
    assert any(r["dense_similarity"] > 0 for r in rows) and all(r["dense_similarity"] <= 1.0001 for r in rows) and {r["bm25"] for r in rows} <= {0.0, 1.0}


def drawn(rows):
    held = {}
    for r in rows:
        held.setdefault(r["group_id"], []).append((r["item_id"], r["kind"]))
    for g, v in held.items():
        assert len({i for i, _ in v}) == len(v) <= 6 and int(g.split("-")[2]) not in {i for i, _ in v}
        assert sum(k == "same_category" for _, k in v) == 2 and sum(k == "similar_text" for _, k in v) <= 2


def unit(rows):
    assert rows and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-4 for r in rows)


def grouped(rows):
    held = {}
    for r in rows:
        held.setdefault(r["asked"], []).append(r["place"])
        assert r["kind"] in ("product", "category", "correction", "query") and r["text"]
    assert held and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in held.values())


def related(rows):
    assert all(r["token"] != r["neighbor"] and r["score"] > 0.05 for r in rows)


HOLDS = {"search_results": found, "dense_search": dense, "negative_samples": drawn, "graph_embedding": unit, "suggestion_groups": grouped, "semantic_expansion": related}


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.registry.QUERIES) - set(__spark_entry__.registry.ORACLE_SQL)))
def test_holds(spark, small, name):
    HOLDS[name](__spark_entry__.queries()[name](spark, small).collect())

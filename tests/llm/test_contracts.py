"""Registered queries on the small test tables: columns, types, rows, and recall of the search."""

import numpy as np
import pytest

from ledgerlark.llm import queries as Q
from tests.conftest import SF_SMALL

LONG, INT, TEXT, REAL, YES = "bigint", "int", "string", "double", "boolean"

#: Columns that a query returns, with their types.
COLUMNS = {
    "op1_cross_polytope_ann": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": REAL},
    "op2_best_fit_packing": {"doc_id": LONG, "piece": INT, "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op3_lm_scoring": {"doc_id": LONG, "held_out": YES, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": REAL, "score": REAL},
    "op4_suffix_array_dedup": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op5_language_id": {"doc_id": LONG, "held_out": YES, "lang_pred": TEXT, "score": REAL},
    "op6_embedding_near_dedup": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": YES},
    "op10_simhash_near_dedup": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
    "op11_url_filters": {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT},
    "op12_embedding_whitening": {"vec_id": LONG, "component": INT, "n": LONG, "deviation": LONG, "whitened": REAL, "explained": REAL, "identity_error": REAL},
    "op13_periodic_runs": {"doc_id": LONG, "n_runs": LONG, "start": LONG, "length": LONG, "period": LONG, "exponent_milli": LONG, "runs_sha256": TEXT, "collapsed_sha256": TEXT},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = Q.QUERIES[name](spark, SF_SMALL)
    assert {k: v for k, v in got.dtypes if k in COLUMNS[name]} == COLUMNS[name]
    table = {"op1": "embeddings", "op6": "embeddings", "op12": "embeddings", "op11": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
    rows = got.collect()
    if name.startswith("op1_"):
        assert len(rows) == 5 * -(-n // 50)
    elif name.startswith("op2_"):
        assert len({r["doc_id"] for r in rows}) == n
    else:
        assert len(rows) == n * (4 if name.startswith("op12_") else 1)


def test_search_recall_on_embeddings(spark):
    """At least nine tenths of the five nearest, as brute force finds them."""
    found = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in found], np.float64)
    ids = np.array([r["vec_id"] for r in found])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in Q.op1_cross_polytope_ann(spark, SF_SMALL).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        order = np.lexsort((ids, -(u @ u[k])))
        want = [ids[i] for i in order if i != k][:5]
        hits, total = hits + len(set(want) & got[ids[k]]), total + 5
    assert hits >= 0.9 * total

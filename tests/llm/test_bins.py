"""Similarities of links are totalled where they are found."""

import pyarrow as pa

from boxloom.llm import ngrams


def test_bins_of_links_are_one_row_a_batch_not_one_a_class():
    n = 40
    texts = [" ".join(f"w{i}" for i in range(200)) + f" end{j}" for j in range(n)]
    groups = [pa.RecordBatch.from_pydict({
        "pair": [g] * n, "key": pa.array([g] * n, pa.int64()), "block": pa.array([0] * n, pa.int32()), "apart": [False] * n, "node": [b"%03d" % (g * n + j) for j in range(n)],
        "copies": pa.array([1] * n, pa.int64()), "keys": pa.array([[g]] * n, pa.list_(pa.int64())), "earlier": pa.array([[]] * n, pa.list_(pa.int64())), "text": texts,
    }) for g in range(3)]
    rows = pa.Table.from_batches(list(ngrams._verify(iter(groups), 5, 0.8))).to_pylist()
    linked, bins = [x for x in rows if x["node"] is not None], [x["bins"] for x in rows if x["bins"] is not None]
    assert len(linked) == 3 * n and all(x["links"] == n - 1 for x in linked)
    assert len(bins) == 1 and sum(bins[0]) == 3 * n * (n - 1)

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import retrieval


def test_rows_are_taken_without_their_vectors():
    """Neighbours are taken from the pool k times a query, so its rows must not hold vectors."""
    rows = pa.table({"id": [1, 2, 3], "vector": pa.array([[3.0, 4.0], [0.0, 0.0], [0.0, 2.0]], pa.list_(pa.float64()))})
    kept, unit = retrieval._unit(rows)
    assert kept.column_names == ["id"] and kept["id"].to_pylist() == [1, 3]
    assert unit.tolist() == [pytest.approx([0.6, 0.8]), [0.0, 1.0]]
    kept, unit = retrieval._unit(rows.filter(pa.array([True, False, True])))
    assert kept["id"].to_pylist() == [1, 3] and np.allclose(np.linalg.norm(unit, axis=1), 1)

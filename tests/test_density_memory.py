"""What a task of the density clusters holds at once."""

import numpy as np
import pyarrow as pa

from simplexa.operators import density


def test_distances_are_held_in_lots(monkeypatch):
    """A block of queries into a crowded cell: no matrix of all their distances, and the same edges."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, (3000, 2)).astype(float), rng.integers(0, 40, (2500, 2)).astype(float)
    column = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
    asked = pa.table({"id": np.arange(3000), "v": column(x), "comp": np.arange(3000) % 7, "bound": np.full(3000, 9.0), "core": rng.random(3000)})
    there = pa.table({"id": np.arange(3000, 5500), "v": column(y), "comp": 5 + np.arange(2500) % 7, "core": rng.random(2500)})
    sizes, plain = [], density._distances

    def measured(a, b):
        sizes.append(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(density, "_distances", measured)
    got = density._foreign(asked, there)
    assert max(sizes) <= 1 << 20
    monkeypatch.setattr(density, "MATRIX", 1 << 40)
    assert density._foreign(asked, there).equals(got) and max(sizes) == 3000 * 2500

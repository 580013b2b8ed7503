"""Tasks that read files give back bounded pieces."""

import pandas as pd

from dipper.sources import fits


def test_rows_of_a_file_come_in_pieces():
    class Files:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return list(run(iter([pd.DataFrame({"path": ["a", "b", "c"], "content": [b"120001", b"0", b"50000"]})])))

    pieces = fits._decoded(Files(), lambda data, path: pd.DataFrame({"x": range(int(data))}), "x long")
    assert [len(p) for p in pieces] == [50_000, 50_000, 20_001, 0, 50_000]
    assert pieces[2]["x"].iloc[-1] == 120_000

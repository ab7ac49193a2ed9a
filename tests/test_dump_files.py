"""The dump that is written to be scanned."""

import gzip
from pathlib import Path

from orrery.plans import catalogue


def test_dump_is_dealt_over_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "DUMP_LINES", 20)
    files = sorted(Path(catalogue._dump_file(spark, "/root/testdata/sf0.001")).glob("*.gz"))
    lines = [sum(1 for line in gzip.open(f) if b'"id64"' in line) for f in files]
    assert len(files) >= 8 and max(lines) <= 20 * 3 and sum(lines) >= 150

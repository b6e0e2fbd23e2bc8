"""A large file's bytes are read by lines that tasks share out, and none is lost."""

import os

from lodestrata.sources.corpus import corpus_pieces, read_corpus, read_sizes


def test_large_files_are_read_by_pieces(spark, tmp_path):
    odd = bytes(range(256))
    held = {"ends.bin": b"ab\n" * 500, "open.bin": b"\n\r\n\xff" + odd * 9, "a %20 b.txt": b"x\n" * 700 + b"y", "a+b.txt": b"z\\n" * 600, "packed.txt.gz": odd * 10, "small.txt": b"one\ntwo", "breaks.txt": b"\n" * 1200, "x.parquet": odd * 8}
    for n, b in held.items():
        (tmp_path / n).write_bytes(b)
    pieces = corpus_pieces(spark, str(tmp_path), "s", most=1000)
    assert {os.path.basename(r.path): r.n_bytes for r in read_sizes(pieces).collect()} == {n: len(b) for n, b in held.items()}
    assert {r.path for r in pieces.select("path").distinct().collect()} == {r.path for r in read_corpus(spark, str(tmp_path), "s").collect()}
    rows = {}
    for r in pieces.collect():
        rows.setdefault(os.path.basename(r.path), []).append(bytes(r.content))
    assert rows["small.txt"] == [b"one\ntwo"] and len(rows["packed.txt.gz"]) == 1
    assert max(map(len, rows["open.bin"])) < 300 and sorted(rows["open.bin"]) == sorted(held["open.bin"].split(b"\n"))

import gzip
import random

import pytest

from foliant.sources import gzip_lines
from foliant.sources.raw import raw_books, read_json_lines


def members(lines, cuts, rnd, pad=b""):
    """One gzip file of several members; borders lie anywhere, within lines too."""
    whole = "\n".join(lines).encode()
    places = [0, *sorted(rnd.randrange(len(whole) + 1) for _ in range(cuts)), len(whole)]
    return pad.join(gzip.compress(whole[a:b], rnd.choice([1, 9])) for a, b in zip(places, places[1:], strict=False)) + pad


@pytest.mark.parametrize("cuts, step, pad", [(0, 500, b""), (30, 300, b""), (30, 7, b""), (5, 10**6, b""), (12, 200, b"\0" * 40)])
def test_lines_of_all_ranges_are_the_files(tmp_path, cuts, step, pad):
    rnd = random.Random(cuts + step)
    lines = [f"{i} é " + "".join(rnd.choice("abcdef\x1f\x8b") for _ in range(rnd.randint(0, 60))) for i in range(400)]
    path = tmp_path / "x.gz"
    path.write_bytes(members(lines, cuts, rnd, pad))
    reader = gzip_lines.LineReader(str(path), step)
    got = [v for p in reader.partitions() for b in reader.read(p) for v in b.column(0).to_pylist()]
    assert got == lines
    if cuts == 30 and step == 300:
        assert sum(any(True for _ in reader.read(p)) for p in reader.partitions()) > 5


def test_dumps_are_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(4)
    lines = [f'{{"book_id": "{i}", "title": "T{"x" * rnd.randint(0, 200)}"}}' for i in range(2000)] + ["", "not json"]
    (tmp_path / "b.json.gz").write_bytes(members(lines, 40, rnd))
    df = gzip_lines.read_lines(spark, f"{tmp_path}/b.json.gz", 2000)
    assert df.rdd.getNumPartitions() > 5 and sorted(r.value for r in df.collect()) == sorted(lines)
    books = raw_books(spark, f"{tmp_path}/b.json.gz")
    assert books.where("_bad").count() == 1 and books.where("not _bad").count() == 2000
    gzip_lines.reblock(spark, f"{tmp_path}/b.json.gz", f"{tmp_path}/parts", 6)
    again = read_json_lines(spark, f"{tmp_path}/parts", "book_id string")
    assert again.where("not _bad").count() == 2000 and again.rdd.getNumPartitions() > 1


def test_cut_files_raise(tmp_path):
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"line\n" * 9999)[:-20])
    reader = gzip_lines.LineReader(str(tmp_path / "c.gz"), 1 << 20)
    with pytest.raises(ValueError, match="within a member"):
        [b for p in reader.partitions() for b in reader.read(p)]

"""CSV records cut from byte ranges against the whole file read at once."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpometer.sources import readers, records

SIZES = ["97b", "1k", "64k", "128m"]


@pytest.fixture
def ranges(spark):
    """Set the size of the byte ranges; files are cut into more of them than there are cores."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def choose(size):
        # With a low cost to open a file, small ones are cut for every core; a high one leaves them whole.
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "128m" if size == "128m" else "1b")

    yield choose
    for name, value in before.items():
        spark.conf.set(name, value)


def awkward_rows(seed, n):
    rng = random.Random(seed)
    bits = ["plain", "a, b", 'say ""', '"', "\n", "\r\n", ",", "é", "\n\n", '",', ',"', "'", " ", "long word " * 30]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(8))), rng.choice(["x", "y\nz", "", 'q"q'])] for i in range(n)]


def spelled(rows, ending):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=ending).writerows([["id", "article", "more"], *rows])
    return out.getvalue()


def known(rows):
    """As the reader gives them: an empty cell that is not quoted is null."""
    return sorted((i, a or None, m or None) for i, a, m in rows)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_rows_do_not_follow_the_ranges(spark, tmp_path, ranges, size, ending):
    rows = awkward_rows(7, 300)
    (tmp_path / "a.csv").write_bytes(spelled(rows[:200], ending).encode())
    (tmp_path / "b.csv").write_bytes(spelled(rows[200:], ending).removesuffix(ending).encode())
    ranges(size)
    got = readers.read_csv(spark, str(tmp_path))
    assert got.columns == ["id", "article", "more"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == known(rows)


def test_many_tasks_read_one_file(spark, tmp_path, ranges):
    rows = awkward_rows(8, 400)
    (tmp_path / "one.csv").write_text(spelled(rows, "\n"), newline="")
    ranges("2k")
    found = records.records(spark, str(tmp_path / "one.csv"))
    assert len({r.begin for r in found.collect()}) > 10
    ranges("128m")
    assert len({r.begin for r in records.records(spark, str(tmp_path / "one.csv")).collect()}) == 1


@pytest.mark.parametrize("size", SIZES)
def test_a_cell_longer_than_many_ranges(spark, tmp_path, ranges, size):
    rows = [["1", 'one ""\n' * 3000, "x"], ["2", "two", "y"], ["3", "three\n" * 900, "z"]]
    (tmp_path / "a.csv").write_text(spelled(rows, "\n"), newline="")
    ranges(size)
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path)).collect())) == known(rows)


@pytest.mark.parametrize("size", SIZES)
def test_quotes_that_open_nothing(spark, tmp_path, ranges, size):
    lines = [f'{i},5" pipe,he said "no"' if i % 3 else f'{i},"two\nlines, ""q""",end' for i in range(200)]
    (tmp_path / "a.csv").write_text("id,article,more\n" + "\n\n".join(lines) + "\n", newline="")
    ranges(size)
    got = sorted(map(tuple, readers.read_csv(spark, str(tmp_path)).collect()), key=lambda r: int(r[0]))
    assert got == [(str(i), '5" pipe', 'he said "no"') if i % 3 else (str(i), 'two\nlines, "q"', "end") for i in range(200)]


@pytest.mark.parametrize("size", SIZES)
def test_tolerant_rows_do_not_follow_the_ranges(spark, tmp_path, ranges, size):
    lines = []
    for i in range(200):
        lines.append([f'{i},"caf\xe9\n{i}",z', f"{i},too,many,cells", f"{i}", f"{i},,,"][i % 4])
    (tmp_path / "a.csv").write_bytes(("n,text,end\r\n" + "\r\n".join(lines)).encode("latin-1"))
    ranges(size)
    got = readers.read_csv_tolerant(spark, str(tmp_path / "a.csv"), ["n", "text", "end"]).collect()
    want = [(str(i), f"café\n{i}", "z") for i in range(0, 200, 4)] + [(str(i), None, None) for i in range(2, 200, 4)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_schema_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,article\n1,"x\ny"\n', newline="")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path), "id int, article string").collect()] == [(1, "x\ny")]
    with pytest.raises(ValueError, match="the header names"):
        readers.read_csv(spark, str(tmp_path), "other int, article string")
    (tmp_path / "b.csv").write_text("id,article\n", newline="")
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).count() == 0


cell = st.text(alphabet='ab",\n ', max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(cell, min_size=2, max_size=4), min_size=1, max_size=5))
def test_states_and_cells(rows):
    text = "".join(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c for c in row) + "\n" for row in rows)
    found, pieces, inside = [], [], False
    for line in text.split("\n")[:-1]:
        inside = records.state_after(line, inside)
        pieces.append(line)
        if not inside:
            found.append("\n".join(pieces))
            pieces = []
    assert not inside and [next(csv.reader(io.StringIO(f, newline=""))) if f else [""] for f in found] == rows
    assert [records.cells_of(f) for f in found] == [len(r) for r in rows]

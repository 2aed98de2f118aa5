"""The first lines of files are found without reading the rest, and are those Spark's reader finds."""

import gzip
import io
import os

from millrace.sources import heads
from millrace.sources.csv import SAMPLE_CHARS, _heads, preview_csv_text, preview_tops
from millrace.sources.lines import text_lines

SIZE = 1 << 40


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_no_more_is_read_than_taken():
    file = Counting(b"\n".join(b"station %d,4.5" % i for i in range(200_000)))
    lines = heads.lines_in(file)
    assert [next(lines) for _ in range(3)] == [b"station 0,4.5", b"station 1,4.5", b"station 2,4.5"]
    assert file.taken == heads.BLOCK
    assert len(list(lines)) == 199_997


def test_lines_are_whole_at_block_ends():
    for rows in (["a" * n for n in range(400)], ["", "x", "", ""], ["ü" * 9000, "é", "y"]):
        text = "\n".join(rows).encode()
        want = text.split(b"\n")
        if not want[-1]:
            want.pop()
        assert list(heads.lines_in(io.BytesIO(text))) == want


def test_head_of_a_file_of_a_tebibyte(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_bytes(b"station;level\n" + b"".join(b"S%d;%d\n" % (i, i * i) for i in range(1000)))
    os.truncate(path, SIZE)  # the rest is a hole that takes no disk; to read it would take hours
    rows = preview_csv_text(spark, str(path), 5).collect()
    assert [r["cells"] for r in rows] == [["station", "level"], *[[f"S{i}", str(i * i)] for i in range(4)]]
    assert all(r["truncated"] for r in rows)
    tops = heads.of_files(spark, str(path), text_lines(spark, str(path)))
    (head,) = _heads(tops, None, None).collect()
    assert (head["sep"], head["n_cols"], head["has_header"], head["settled"]) == (";", 2, True, True)


def test_same_heads_as_the_text_reader(spark, tmp_path):
    wide = "|".join(f"column {i}" for i in range(900))
    files = {
        "plain.csv": b"a,b\n1,2\n3,4\n",
        "no end.csv": b"a,b\n1,2",
        "crlf #1.csv": b"a;b\r\n1;x\r\n2;y\r\n",
        "100%.csv": "name,größe\nz,1\n".encode("cp1252"),
        "quoted.csv": b'a,b\n"one\ntwo",2\n"three",4\n',
        "blank.csv": b"\n\n\n",
        "wide.csv": "\n".join([wide] + ["|".join("0" * 900)] * 60).encode(),
        "long.csv": b"".join(b"%d,%d\n" % (i, i) for i in range(5 * SAMPLE_CHARS)),
        "empty.csv": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    path = str(tmp_path)
    lines = text_lines(spark, path)
    by_file, by_line = heads.of_files(spark, path, lines), heads.of_lines(lines, True)
    assert by_file.frame.columns == ["path"]

    def shown(frame):
        return sorted(map(repr, frame.collect()))

    assert shown(preview_tops(by_file, 7)) == shown(preview_tops(by_line, 7))
    found = shown(_heads(by_file, None, None))
    assert found == shown(_heads(by_line, None, None)) and len(found) == len(files) - 1


def test_packed_files_are_left_to_the_text_reader(spark, tmp_path):
    (tmp_path / "rows.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    rows = preview_csv_text(spark, str(tmp_path)).collect()
    assert [r["cells"] for r in rows] == [["a", "b"], ["1", "2"]]


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    assert preview_csv_text(spark, str(tmp_path)).collect() == []

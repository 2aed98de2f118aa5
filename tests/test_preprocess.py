import os
import time

import psutil
import pytest

from millrace.plans import dag
from millrace.sources import preprocess as P
from millrace.sources.lines import text_lines
from millrace.sources.programs import Program, ProgramError, lines_of, output
from tests.test_csv import NOTED, put

SORTED = {"enabled": True, "runtime": "bash", "script": "(head -3 | tail -1; sort -r) < $INPUT_CSV | grep ,"}
DOUBLED = {
    "enabled": True,
    "runtime": "python",
    "script": "import sys\nfor line in open(sys.argv[1]):\n  if line.count(',') == 2: print(line.strip() + ',' + line.split(',')[0])",
}


def on(program, path):
    return {"file_path": path, "preprocessing": program}


def test_loads_only_what_was_made(spark, tmp_path):
    path = put(tmp_path, "gauges.csv", NOTED)
    with pytest.raises(RuntimeError, match="review"):
        P.read_csv_source(spark, on(SORTED, path))
    shown = P.preview_preprocessed(spark, path, SORTED).orderBy("pos").collect()
    assert shown[0]["cells"] == ["gauge", "town", "level"] and len(shown) == 3
    df = P.read_csv_source(spark, on(SORTED, path))
    assert df.dtypes == [("gauge", "bigint"), ("town", "string"), ("level", "double")]
    assert {tuple(r) for r in df.collect()} == {(31, "Ulm", 2.5), (47, "Linz", 8.0)}
    # Other text, other output; another time limit is still the same program.
    with pytest.raises(RuntimeError, match="review"):
        P.read_csv_source(spark, on(SORTED | {"script": SORTED["script"] + " "  + "| cat"}, path))
    assert P.read_csv_source(spark, on(SORTED | {"timeout_seconds": 7}, path)).count() == 2
    assert P.invalidate(spark, path, SORTED)
    assert not P.invalidate(spark, path, SORTED) and not P.invalidate(spark, path, None)


def test_every_file_of_a_folder(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"g{i}.csv", NOTED.replace("Ulm", f"Ulm-{i}"))
    P.prepare(spark, str(tmp_path), DOUBLED)
    df = P.read_csv_source(spark, on(DOUBLED, str(tmp_path)))
    assert df.columns == ["gauge", "town", "level", "gauge_1"] and df.count() == 10
    assert df.where("town like 'Ulm-%' and gauge = gauge_1").select("town").distinct().count() == 5


def test_streamed_input(spark, tmp_path):
    body = "n,half\n" + "".join(f"{i},{i / 2}\n" for i in range(200_000))
    put(tmp_path, "a.csv", body)
    put(tmp_path, "b.csv", "n,half\n5,2.5")
    lines = text_lines(spark, str(tmp_path))
    every = P.run_on_lines(lines, Program("bash", "tail -n +2"))
    counts = {os.path.basename(r["path"]): r["count"] for r in every.groupBy("path").count().collect()}
    assert counts == {"a.csv": 200_000, "b.csv": 1}
    assert every.where("pos = 199999").first()["value"] == b"199999,99999.5"
    # A program that stops reading leaves the other files alone.
    first = P.run_on_lines(lines, Program("python", "print(input())"))
    assert [bytes(r["value"]) for r in first.collect()] == [b"n,half"] * 2


def test_output_of_any_size_in_bounded_memory():
    me, size, most, count = psutil.Process(), 300_000_000, 0, 0
    start = me.memory_info().rss
    for lines in lines_of(output(Program("bash", f"yes gauge,town,level | head -c {size}"), "none"), 10_000):
        count += len(lines)
        most = max(most, me.memory_info().rss - start) if count % 40 == 0 else most
    assert count == -(-size // 17) and most < 60_000_000


def test_slow_reader_slows_the_program(tmp_path):
    ticks = tmp_path / "ticks"
    ticks.write_text("0")
    script = f"i=0; while [ $i -lt 200 ]; do head -c 1000000 /dev/zero; i=$((i+1)); echo $i > {ticks}; done"
    blocks = output(Program("bash", script), "none")
    next(blocks)
    time.sleep(1)
    assert int(ticks.read_text() or 0) < 20  # held back by the pipe
    blocks.close()


@pytest.mark.parametrize(
    "runtime, script, match",
    [
        ("bash", "echo no such gauge >&2; exit 9", "exit code 9.*no such gauge"),
        ("python", "print('a,b'); raise SystemExit(4)", "exit code 4"),
        ("bash", ":", "no output"),
        ("bash", "sleep 30 & sleep 30", "timed out"),
        ("bash", "yes", "timed out"),
    ],
)
def test_programs_that_fail(spark, tmp_path, runtime, script, match):
    path = put(tmp_path, "two.csv", "a,b\n1,2\n")
    setting = {"enabled": True, "runtime": runtime, "script": script, "timeout_seconds": 1}
    with pytest.raises(ProgramError, match=match):
        for _ in output(Program.of(setting), path):
            pass
    if script != "yes":
        with pytest.raises(Exception, match=match):
            P.prepare(spark, path, setting)


def test_settings():
    assert Program.of(None) is None and Program.of({"enabled": False, "runtime": "perl"}) is None
    for wrong in ({"runtime": "perl", "script": "1"}, {"runtime": "bash"}, {"runtime": "bash", "script": "x", "timeout_seconds": -1}):
        with pytest.raises(ValueError):
            Program.of({"enabled": True, **wrong})
    with pytest.raises(ValueError):
        P.prepare(None, "x", {"enabled": False})
    old, new = ({"nodes": [{"id": "a", "table_name": "a", "type": "csv_source", "config": on(SORTED | {"timeout_seconds": t}, "p")}]} for t in (1, 2))
    assert dag.changed_nodes(old, new) == []

"""Log source in bounded memory, ledger of files, retry-safe database writes."""

import io
import os
import resource
import subprocess
import sys
import textwrap
import zipfile

import pytest
from pyspark.sql import functions as F

from transitlake.sources import logs, tables
from transitlake.sources.ledger import Ledger

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def write_log(folder, name, text, member=None):
    with zipfile.ZipFile(folder / f"{name}.txt.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member or f"{name}.txt", text)


@pytest.fixture
def folder(tmp_path):
    write_log(tmp_path, "a", "one\r\ntwo\n\nfour")
    write_log(tmp_path, "b", "x\n")
    write_log(tmp_path, "empty", "")
    write_log(tmp_path, "named", "y\n", member="other.txt")
    (tmp_path / "broken.txt.zip").write_bytes(b"not a zip")
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED) as z:
        z.writestr("crc.txt", "good\nlines\n")
    (tmp_path / "crc.txt.zip").write_bytes(whole.getvalue().replace(b"good", b"evil"))  # wrong sum: no line counts
    (tmp_path / "deep").mkdir()
    write_log(tmp_path / "deep", "c", "z\n")
    (tmp_path / "a.csv").write_text("no log")
    return tmp_path


def test_source_reads_what_the_file_list_reads(spark, folder):
    want = [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, ""), ("a.txt", 4, "four"), ("b.txt", 1, "x"), ("c.txt", 1, "z")]
    for df in (logs.read_logs(spark, str(folder)), logs.log_lines(logs.log_files(spark, str(folder)))):
        assert sorted((r["filename"], r["line_num"], r["line"]) for r in df.collect()) == want
    assert logs.log_files(spark, str(folder)).count() == 7
    assert {r["filename"] for r in logs.read_logs(spark, str(folder), most=1).collect()} == {"a.txt"}
    assert {r["filename"] for r in logs.read_logs(spark, [str(folder / "deep"), f"file://{folder}/deep"], glob="c*").collect()} == {"c.txt"}
    assert logs.read_logs(spark, str(folder), glob="nothing*").count() == 0


def test_files_are_packed_by_size():
    sizes = [(f"f{i:02d}", n) for i, n in enumerate([900, 10, 20, 30, 500, 400, 100, 5, 5, 30])]
    parts = logs.pack(sizes, 1000)
    assert sorted(p for part in parts for p in part) == [p for p, _ in sizes]
    told = dict(sizes)
    assert len(parts) == 2 and max(sum(told[p] for p in part) for part in parts) <= 1010
    assert logs.pack([], 10) == []


def test_a_large_log_takes_bounded_memory(tmp_path):
    """200 MB of lines in one member: a reader of its own stays far below that."""
    line = b"38.921298,-76.969803,312,C,S,000000,0000,17,   ,9,38.921310,-76.969790\n"
    with zipfile.ZipFile(tmp_path / "big.txt.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.txt", "w", force_zip64=True) as member:
        for _ in range(200_000_000 // len(line) // 10_000 + 1):
            member.write(line * 10_000)
    script = f"""
        import resource
        from transitlake.sources.logs import read_file
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        n = sum(b.num_rows for b in read_file({str(tmp_path / "big.txt.zip")!r}))
        print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, check=True, cwd=root)
    n, grown_mb = map(int, out.stdout.split())
    assert n > 2_700_000 and grown_mb < 100
    assert resource.RUSAGE_SELF == 0


def lines_of(lines, files):
    return lines.select("filename", "line_num", "line")


def state(ledger):
    rows = ledger.rows()
    return sorted((r["filename"], r["line_num"], r["line"]) for r in rows.collect()) if rows is not None else []


def test_ledger_reads_only_what_is_new(spark, tmp_path):
    top = tmp_path / "logs"
    top.mkdir()
    write_log(top, "a", "1\n2\n")
    write_log(top, "b", "x\n")
    ledger, files = Ledger(spark, f"file://{tmp_path}/ledger"), lambda: logs.log_files(spark, str(top))
    assert ledger.rows() is None and ledger.files().count() == 0
    read = []

    def make(lines, own):
        read.append(sorted(r["filename"] for r in own.collect()))
        return lines_of(lines, own)

    first = ledger.ingest(files(), make)
    assert state(ledger) == [("a.txt", 1, "1"), ("a.txt", 2, "2"), ("b.txt", 1, "x")]
    assert ledger.ingest(files(), make) is None  # nothing new
    write_log(top, "c", "new\n")
    write_log(top, "a", "1\nchanged\n3\n")
    os.utime(top / "b.txt.zip", (1_700_000_000, 1_700_000_000))  # another time, the same bytes
    second = ledger.ingest(files(), make)
    assert read == [["a.txt", "b.txt"], ["a.txt", "c.txt"]] and ledger.batches() == [first, second]
    assert state(ledger) == [("a.txt", 1, "1"), ("a.txt", 2, "changed"), ("a.txt", 3, "3"), ("b.txt", 1, "x"), ("c.txt", 1, "new")]
    assert {r["filename"]: r["batch"] for r in ledger.files().collect()} == {"a.txt": second, "b.txt": first, "c.txt": second}


def test_a_failed_run_leaves_the_old_state(spark, tmp_path):
    top = tmp_path / "logs"
    top.mkdir()
    write_log(top, "a", "1\n")
    ledger, files = Ledger(spark, f"file://{tmp_path}/ledger"), lambda: logs.log_files(spark, str(top))
    ledger.ingest(files(), lines_of)
    write_log(top, "b", "2\n")
    before = state(ledger)

    def fails(lines, own):
        return lines.select("filename", "line_num", F.raise_error(F.lit("lost")).cast("string").alias("line"))

    with pytest.raises(Exception, match="lost"):
        ledger.ingest(files(), fails)
    assert state(ledger) == before and ledger.files().count() == 1
    ledger.ingest(files(), lines_of)
    assert state(ledger) == [("a.txt", 1, "1"), ("b.txt", 1, "2")]


def test_of_two_runs_from_one_state_one_commits(spark, tmp_path):
    top = tmp_path / "logs"
    top.mkdir()
    write_log(top, "a", "1\n")
    one, other = (Ledger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    files = logs.log_files(spark, str(top))

    def slow(lines, own):
        other.ingest(files, lines_of)  # meanwhile
        return lines_of(lines, own)

    with pytest.raises(RuntimeError, match="another run"):
        one.ingest(files, slow)
    assert state(one) == [("a.txt", 1, "1")] and len(one.batches()) == 1


def test_batches_written_again_add_no_rows(spark):
    url = "jdbc:derby:memory:again;create=true"
    rows = spark.createDataFrame([("f", 1, i, float(i)) for i in range(40)], "filename string, index_run_start int, index_loc int, lat double")
    keys = ["filename", "index_run_start", "index_loc"]
    assert tables.write_jdbc(rows, url, "readings", DERBY, keys, "b1") == 40
    assert tables.write_jdbc(rows, url, "readings", DERBY, keys, "b1") == 0
    more = rows.unionByName(spark.createDataFrame([("g", 1, i, 0.5) for i in range(5)] * 2, rows.schema))
    assert tables.write_jdbc(more, url, "readings", DERBY, keys, "b2") == 5
    back = tables.read_jdbc(spark, url, "readings", tables.PINGS, DERBY)
    assert back.count() == 45 and back.select("filename", "index_loc").distinct().count() == 45
    with pytest.raises(ValueError, match="named by"):
        tables.write_jdbc(rows, url, "readings", DERBY, keys, "x; drop")


def test_a_task_that_fails_after_writing_doubles_nothing(tmp_path):
    """Tasks fail once after their rows were sent; Spark tries them again."""
    script = f"""
        import os
        from pyspark.sql import SparkSession, functions as F
        from pyspark import TaskContext
        from transitlake.sources import tables
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        url, props = "jdbc:derby:memory:retry;create=true", {{"driver": "org.apache.derby.jdbc.EmbeddedDriver", "batchsize": "1", "isolationLevel": "NONE"}}

        def flaky(batches):
            import pyarrow as pa
            for batch in batches:
                yield batch
            mark = os.path.join({str(tmp_path)!r}, str(TaskContext.get().partitionId()))
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("lost")

        rows = spark.range(100).repartition(3).select(F.lit("f").alias("filename"), F.col("id").cast("int").alias("index_loc")).mapInArrow(flaky, "filename string, index_loc int")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        first = tables.write_jdbc(rows, url, "readings", props, ["filename", "index_loc"], "b")
        back = spark.read.jdbc(url, "readings", properties=props)
        print("found", first, back.count(), back.distinct().count(), len(os.listdir({str(tmp_path)!r})))
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, cwd=root, timeout=240)
    told = [line for line in out.stdout.splitlines() if line.startswith("found")]
    assert told and told[0].split()[1:4] == ["100", "100", "100"] and int(told[0].split()[4]) >= 1, out.stderr[-2000:]

"""Logs that grow, are cut short and start over; records published once each."""

from pyspark.sql import functions as F

from aerotrace.operators import logs
from aerotrace.sources.tail import tail_files
from aerotrace.streaming import runs


def lines(*gids):
    return "".join(f"[OK     ] GID={g} Folder ready -> /x\n" if g else "[INFO   ] on its way\n" for g in gids)


def watched(spark, root, publish=None):
    d = runs.watch_runs(logs.parse_lines(tail_files(spark, str(root / "in"))))
    out = d.writeStream.option("checkpointLocation", str(root / "state")).trigger(availableNow=True)
    (out.foreachBatch(publish).start() if publish else out.format("parquet").start(str(root / "out"))).awaitTermination()


def test_growth_truncation_and_restart(spark, tmp_path):
    run, other = tmp_path / "in" / "20240101_000000" / "mission.log", tmp_path / "in" / "20240102_000000" / "mission.log"
    run.parent.mkdir(parents=True)
    other.parent.mkdir()
    run.write_text(lines(0, 7, 0) + "[OK     ] GID=7 Folder re")  # the last line is not whole yet
    watched(spark, tmp_path)
    run.write_text(lines(0, 7, 0, 7, 0))
    other.write_text(lines(7))
    watched(spark, tmp_path)
    run.write_text(lines(7, 0))  # opened anew: shorter
    watched(spark, tmp_path)
    run.write_text(lines(8, 0, 8, 0, 8, 8, 0, 0))  # opened anew and longer already
    watched(spark, tmp_path)
    watched(spark, tmp_path)  # nothing new
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = sorted((r.epoch, r.line_no, r.gid, r.seen) for r in got.filter(F.col("path").contains("20240101")).collect())
    assert [r for r in rows if r[0] == 0] == [(0, 1, None, None), (0, 2, 7, 1), (0, 3, None, None), (0, 4, 7, 2), (0, 5, None, None)]
    assert [r for r in rows if r[0] == 1] == [(1, 1, 7, 1), (1, 2, None, None)]
    assert [r[2:] for r in rows if r[0] == 2] == [(8, 1), (None, None), (8, 2), (None, None), (8, 3), (8, 4), (None, None), (None, None)]
    assert [(r.epoch, r.gid, r.seen) for r in got.filter(F.col("path").contains("20240102")).collect()] == [(0, 7, 1)]


def test_announcements_are_published_once(spark, tmp_path):
    log = tmp_path / "in" / "r" / "mission.log"
    log.parent.mkdir(parents=True)
    cols = "path string, gid bigint, update_no bigint, event string, tid bigint, first_frame bigint, last_frame bigint, best_conf double, best_sharpness double, cumulative_gallery int"
    buffers = spark.createDataFrame([(str(log), 7, k, "new" if k == 1 else "merge", 70 + k, 100 * k, 100 * k + 59, k / 10, 1.0 * k, 5 * k) for k in (1, 2)] + [(str(log), 9, 1, "new", 90, 0, 59, 0.5, 1.0, 5)], cols)
    publish = runs.publisher(buffers, str(tmp_path / "published"), ("path", "gid"))
    failing = [True]

    def once_broken(batch, number):
        publish(batch, number)
        if failing.pop() if failing else False:
            raise RuntimeError("the driver is lost after the write")

    log.write_text(lines(7, 0, 7))
    try:
        watched(spark, tmp_path, once_broken)
    except Exception as e:
        assert "the driver is lost" in str(e)
    watched(spark, tmp_path, publish)
    log.write_text(lines(7, 0, 7, 7, 9, 5))
    watched(spark, tmp_path, publish)
    got = sorted((r.gid, r.seen, r.updates, r.event, r.last_frame) for r in spark.read.parquet(str(tmp_path / "published" / "batch=*")).collect())
    assert got == [(7, 1, 1, "new", 159), (7, 2, 2, "merge", 259), (7, 3, 2, "merge", 259), (9, 1, 1, "new", 59)]

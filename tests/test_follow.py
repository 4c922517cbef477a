import os

import pytest

from docframe.streaming.follow import FollowLines, FollowReader


def drain(spark, path, out, check, **options):
    q = spark.readStream.format("follow_lines").option("path", str(path)).options(**options).load().writeStream.format("json").option("checkpointLocation", str(check)).trigger(availableNow=True).start(str(out))
    q.awaitTermination(60)
    return sorted(r["line"] for r in spark.read.schema("line string").json(str(out)).collect())


def test_unfinished_lines_wait_and_rotation_drains_the_old_file(spark, tmp_path):
    spark.dataSource.register(FollowLines)
    log, out, check = tmp_path / "app.log", tmp_path / "out", tmp_path / "check"
    log.write_text("a\nb\nhalf")
    assert drain(spark, log, out, check) == ["a", "b"]
    with log.open("a") as f:
        f.write("done\nlate\n")
    os.rename(log, tmp_path / "app.log.1")
    log.write_text("new\n")
    assert drain(spark, log, out, check) == ["a", "b", "halfdone", "late", "new"]
    assert drain(spark, log, out, check) == ["a", "b", "halfdone", "late", "new"]


def test_no_line_is_lost_over_rotations(tmp_path):
    log = tmp_path / "app.log"
    reader = FollowReader({"path": str(log)})
    at, got = None, []

    def step():
        nonlocal at
        start, at = at or reader.initialOffset(), reader.latestOffset()
        got.extend(x[0] for p in reader.partitions(start, at) for x in reader.read(p))

    log.write_text("a\n")
    step()
    with log.open("a") as f:
        f.write("tail\n")
    os.rename(log, tmp_path / "app.log.1")
    step()
    step()
    log.write_text("b\n")
    os.rename(tmp_path / "app.log.1", tmp_path / "app.log.2")
    os.rename(log, tmp_path / "app.log.1")
    log.write_text("c\n")
    step()
    step()
    assert got == ["a", "tail", "b", "c"]
    os.rename(log, tmp_path / "elsewhere")
    log.write_text("d\n")
    with pytest.raises(ValueError, match="Lost"):
        step()

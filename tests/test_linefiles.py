"""Lines of files and logs: splits, compression, files that can't be read, and storage that fails."""

import gzip
import io
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tracework.sources import gitlog, linefiles, transcripts


def rows(df):
    return sorted((os.path.basename(r.path), r.at, r.raw, r.error) for r in df.collect())


def plain(data: bytes):
    """(offset, text) of the lines of a file, by a walk over its bytes."""
    out, begin, i = [], 0, 0
    while i < len(data):
        if data[i] in b"\r\n":
            out.append((begin, data[begin:i].decode("utf-8", "replace")))
            i += 2 if data[i : i + 2] == b"\r\n" else 1
            begin = i
        else:
            i += 1
    return [*out, (begin, data[begin:].decode("utf-8", "replace"))] if begin < len(data) else out


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_every_line_comes_once(split):
    rng = random.Random(split)
    for _ in range(60):
        data = b"".join(rng.choice([b"\n", b"\r\n", b"a", b"bc ", "é".encode(), b"\xff", b"\x00", b"x" * rng.randint(0, 90)]) for _ in range(rng.randint(0, 60)))
        got = []
        for a in range(0, max(len(data), 1), split):
            end = a + split if a + split < len(data) else float("inf")
            for batch in linefiles.lines_of("p", io.BytesIO(data), a, end):
                got += zip(batch.column("at").to_pylist(), batch.column("raw").to_pylist(), strict=True)
        assert [r for r in got if r[1]] == [r for r in plain(data) if r[1]]


def test_blocks_smaller_than_lines(monkeypatch):
    monkeypatch.setattr(linefiles, "BLOCK", 5)
    data = b"first line that is long\n\nsecond\nthird one without an end"
    for split in (3, 11, 24, 25, 100):
        got = [x for a in range(0, len(data), split) for b in linefiles.lines_of("p", io.BytesIO(data), a, a + split if a + split < len(data) else float("inf")) for x in zip(b.column("at").to_pylist(), b.column("raw").to_pylist(), strict=True)]
        assert got == plain(data), split


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "sub" / "b.log.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "other.txt").write_text("no")
    want = plain(text.encode())
    got = rows(linefiles.read(spark, str(tmp_path), ".log", split=10_000))
    assert [r[1:3] for r in got if r[0] == "a.log"] == want and [r[1:3] for r in got if r[0] == "b.log.gz"] == want
    assert len(got) == 2 * len(want) and not any(r[3] for r in got)
    assert rows(linefiles.read(spark, [f"file://{tmp_path}/a.log"], ".log")) == [r for r in got if r[0] == "a.log"]
    with pytest.raises(Exception, match="no such path"):
        linefiles.read(spark, str(tmp_path / "none")).collect()


def test_what_cannot_be_read_to_its_end_is_told(spark, tmp_path):
    entry = json.dumps({"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hello " + "z" * 40}})
    body = "".join(f"{entry}\n" for _ in range(40_000)).encode()
    packed = gzip.compress(body, 1)
    (tmp_path / "cut.jsonl.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "fake.jsonl.gz").write_bytes(b"this is not compressed")
    (tmp_path / "good.jsonl").write_text(f"{entry}\nnot json\n")
    os.symlink(tmp_path / "gone", tmp_path / "broken.jsonl")
    lines = transcripts.read_lines(spark, str(tmp_path))
    errors = {os.path.basename(r.path): (r.seq, r.error) for r in lines.where("error is not null").collect()}
    assert errors["cut.jsonl.gz"][1].startswith("EOFError") and errors["fake.jsonl.gz"][1].startswith("BadGzipFile")
    n = {os.path.basename(r.path): r["count"] for r in lines.where("raw is not null").groupBy("path").count().collect()}
    assert 0 < n["cut.jsonl.gz"] < 40_000 and errors["cut.jsonl.gz"][0] == n["cut.jsonl.gz"] * (len(entry) + 1)
    told = {(os.path.basename(r.path), r.reason.split(":")[0]) for r in transcripts.rejects(lines).collect()}
    assert told >= {("cut.jsonl.gz", "EOFError"), ("fake.jsonl.gz", "BadGzipFile"), ("good.jsonl", "unparsable")}
    e = transcripts.entries(lines)
    assert e.count() == n["cut.jsonl.gz"] + 1
    assert {r.session_id for r in e.select("session_id").distinct().collect()} == {"cut", "good"}


def test_errors_of_the_storage_fail():
    class Away(io.BytesIO):
        def read(self, n=-1):
            raise OSError(5, "Input/output error")

    with pytest.raises(OSError, match="Input/output"):
        list(linefiles.lines_of("p", Away(b"x\n"), 0, float("inf")))


def test_logs_of_repositories(spark, tmp_path):
    def run(repo, *a):
        env = {"GIT_AUTHOR_DATE": "2026-01-01T10:00:00+00:00", "GIT_COMMITTER_DATE": "2026-01-01T10:00:00+00:00", "GIT_AUTHOR_NAME": "A b", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "A b", "GIT_COMMITTER_EMAIL": "a@b.c", "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
        return subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True, env=env).stdout

    repos = [tmp_path / f"r{i}" for i in range(3)]
    for i, r in enumerate(repos):
        r.mkdir()
        run(r, "init", "-q")
        for j in range(i + 1):
            (r / f"f{j}").write_text("x\n" * (j + 1))
            run(r, "add", ".")
            run(r, "commit", "-qm", f"add {j}")
    missing = tmp_path / "missing"
    c, n = gitlog.export(spark, [str(r) for r in [*repos, missing]])
    assert sorted((r.repo_id[-2:], r.subject) for r in c.collect()) == [(f"r{i}", f"add {j}") for i in range(3) for j in range(i + 1)]
    assert n.where("added = 3").count() == 1
    # the error is told beside the lines, and doesn't fail the others
    lines = gitlog.export_lines(spark, [str(repos[0]), str(missing)], [f"--format={gitlog.COMMITS_FORMAT}"])
    assert [r.repo_id for r in gitlog.rejects(lines).collect()] == [str(missing)] and gitlog.commits(lines).count() == 1
    # a filter that finds nothing falls back, for the commits and for their files
    c, n = gitlog.export(spark, [str(repos[2])], names=["nobody"])
    assert c.count() == 3 and n.count() == 3
    # exported logs as files
    (tmp_path / "logs").mkdir()
    for r in repos:
        (tmp_path / "logs" / f"{r.name}.log").write_bytes(run(r, "log", f"--format={gitlog.NUMSTAT_FORMAT}", "--numstat"))
    got = gitlog.numstat(gitlog.lines(spark, str(tmp_path / "logs")))
    assert sorted((os.path.basename(r.repo_id), r.file, r.added) for r in got.collect()) == [(f"r{i}.log", f"f{j}", j + 1) for i in range(3) for j in range(i + 1)]


def test_small_files_share_a_task(spark, tmp_path):
    n = 300
    lines = spark.range(n * 3).selectExpr("id % 3 AS at", f"concat('d=', id div 3, '/l.txt', if(id div 3 % 2 = 0, '.gz', '')) AS path", "concat('é ', id) AS value")
    linefiles.write(lines, f"{tmp_path}/logs", ["at"])
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith(".")]
    (tmp_path / "logs" / "large.txt").write_text("x\n" * 1000)
    read = linefiles.read(spark, f"{tmp_path}/logs", ".txt", split=500)
    # a task a file before; the large one's splits stay apart
    assert read.rdd.getNumPartitions() == -(-n // linefiles.FILES) + 4
    got = {}
    for r in read.where("error is null").orderBy("path", "at").collect():
        got.setdefault(os.path.relpath(r.path, tmp_path / "logs"), []).append(r.raw)
    assert got.pop("large.txt") == ["x"] * 1000
    assert got == {f"d={i}/l.txt{'.gz' if i % 2 == 0 else ''}": [f"é {i * 3 + k}" for k in range(3)] for i in range(n)}


def test_written_anew(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n, n) for n in names], "path string, value string")
    linefiles.write(rows("a.txt", "b.txt"), str(tmp_path / "out"))
    linefiles.write(rows("a.txt", "c.txt"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt", "c.txt"]
    linefiles.write(rows("d.txt"), f"file://{tmp_path}/out", overwrite=True)
    assert [(p.name, p.read_text()) for p in (tmp_path / "out").iterdir()] == [("d.txt", "d.txt\n")]


def test_texts_go_to_folders_that_are_there(spark, tmp_path):
    """As when a task is tried again after some of its folders have come."""
    rows = lambda *some: spark.createDataFrame(some, "key long, path string, text string")
    kept = linefiles.texts_to(rows((1, "a/1", "old"), (2, "a/2", "two"), (3, "b/3", None)), str(tmp_path / "out"), F.substring_index("path", "/", 1))
    assert kept.columns == ["key"] and sorted(r.key for r in kept.collect()) == [1, 2, 3]
    linefiles.texts_to(rows((1, "a/1", "new"), (4, "a/4", "x"), (4, "a/4", "y"), (5, "c/5", "five")), str(tmp_path / "out"), F.substring_index("path", "/", 1)).collect()
    found = {os.path.relpath(os.path.join(at, f), tmp_path / "out"): (tmp_path / "out" / at / f).read_text() for at, _, files in os.walk(tmp_path / "out") for f in files}
    assert found == {"a/1": "new\n", "a/2": "two\n", "b/3": "\n", "a/4": "x\ny\n", "c/5": "five\n"}
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "b", "c"]

"""The text source reads the same numbers however files are cut, as a batch and as a stream."""

import json
import random

import pytest
from pyspark.sql.types import LongType

from keytally.session import work_path
from keytally.sources import live_text
from keytally.streaming import linear as stream_linear


def numbers_of(text):
    out = []
    for word in text.split():
        body = word[1:] if word[:1] in "+-" else word
        if body.isascii() and body.isdigit() and -(1 << 63) <= int(word) < 1 << 63:
            out.append(int(word))
    return sorted(out)


def read_all(reader, parts):
    return sorted(k for p in parts for b in reader.read(p) for k in b.column(0).to_pylist())


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_same_numbers(seed, tmp_path, monkeypatch):
    r = random.Random(seed)
    words = [str(r.randint(-(10**6), 10**6)) for _ in range(r.randint(0, 50))]
    words += r.sample(["x1", "+7", "-0", str(10**18), str(2**63), str(-(2**63)), "٣", "1.5", "9" * 40], 4)
    r.shuffle(words)
    text = "".join(w + r.choice([" ", "  ", "\n", "\t "]) for w in words)
    text = text.strip() if seed % 3 == 0 else text
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-1").write_text(text)
    (tmp_path / "a" / "_SUCCESS").write_text("9")
    (tmp_path / "b").write_text(" 5 6 ")
    (tmp_path / ".b.crc").write_text("7")
    want = sorted(numbers_of(text) + [5, 6])
    monkeypatch.setattr(live_text, "BLOCK_BYTES", r.choice([5, 64, 4 << 20]))
    options = {"path": str(tmp_path), "splitBytes": str(r.choice([1, 3, 50, 1000]))}
    batch = live_text.KeyTextReader(options)
    assert read_all(batch, batch.partitions()) == want
    stream = live_text.KeyTextStreamReader(options | {"triggerBytes": str(r.choice([1, 9, 200])), "closed": "true"})
    at, got = stream.initialOffset(), []
    while (end := stream.latestOffset()) != at:
        got += read_all(stream, stream.partitions(at, end))
        at = end
    assert sorted(got) == want and stream.partitions(at, at) == []


def test_a_growing_file_waits_for_white_space(tmp_path):
    path, stream = tmp_path / "log", live_text.KeyTextStreamReader({"path": str(tmp_path)})
    at, got = stream.initialOffset(), []
    assert stream.latestOffset() == at
    for text, want in (("12 34", [12]), ("12 345 6", [12, 345]), ("12 345 67 ", [12, 345, 67])):
        path.write_text(text)
        end = stream.latestOffset()
        got += read_all(stream, stream.partitions(at, end))
        at = end
        assert got == want
    path.write_text("12 345 67 8")
    (tmp_path / "log2").write_text("9 ")  # a successor says that the first file is complete
    assert read_all(stream, stream.partitions(at, stream.latestOffset())) == [8, 9]


def test_batch_stream_and_restart(spark, tmp_path):
    live_text.register(spark)
    r = random.Random(3)
    keys = [r.randrange(30) for _ in range(4000)]
    folder, out = tmp_path / "in", work_path(spark, "live")
    folder.mkdir()
    want = {}
    progress = []
    for step in range(3):
        part = keys[step * 1000 : (step + 1) * 1000]
        (folder / f"{step}").write_text(" ".join(map(str, part)) + " ")
        for k in part:
            want[k] = want.get(k, 0) + 1
        stream = (
            spark.readStream.format("key_text").option("triggerBytes", 700).option("splitBytes", 300)
        )
        progress += stream_linear.run_histogram(stream.load(str(folder)), out, 2, drain=True)
        got = {x.key: x.cnt for x in stream_linear.stream_histogram(spark, out, LongType()).collect()}
        assert got == want
    assert len({p.batchId for p in progress}) > 4
    assert json.loads(progress[-1].sources[0].endOffset)["file"] == "2"
    batch = spark.read.format("key_text").option("splitBytes", 997).load(str(folder))
    assert {x.key: x["count"] for x in batch.groupBy("key").count().collect()} == want
    assert spark.read.format("key_text").load(str(tmp_path / "none")).count() == 0

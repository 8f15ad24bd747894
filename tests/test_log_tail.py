"""The log tail as a reader: what the driver does, offsets, line ends across ranges and batches."""

import builtins
import json
import os
import random
import time

import pytest

from fleetwright.sources import logtail


class Folder:
    def __init__(self, path, **options):
        self.path = path
        self.reader = logtail.LogTailReader({"path": str(path), **options})
        self.offset = self.reader.initialOffset()

    def add(self, name, data):
        with open(self.path / name, "ab") as log:
            log.write(data)

    def batch(self):
        end = self.reader.latestOffset()
        rows = []
        if end != self.offset:
            for part in self.reader.partitions(self.offset, end):
                rows += [(os.path.basename(p), at, line) for p, at, line in self.reader.read(part)]
        self.offset = json.loads(json.dumps(end))
        return rows


def lines(name, data, floor=0):
    at, out = floor, []
    for raw in data[floor:].split(b"\n")[:-1]:
        out.append((name, at, raw.decode()))
        at += len(raw) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_growing_files(tmp_path, seed, monkeypatch):
    monkeypatch.setattr(logtail, "_CHUNK", 5)
    rng = random.Random(seed)
    folder = Folder(tmp_path, rangeBytes="7", fromByte="4" if seed == 3 else "0")
    whole, got = {}, []
    for _ in range(12):
        for name in rng.sample("abc", 2):
            data = "".join(rng.choice("xy\n\n") * rng.randint(0, 6) for _ in range(rng.randint(0, 5))).encode()
            folder.add(name, data)
            whole[name] = whole.get(name, b"") + data
        got += folder.batch()
    want = [row for name, data in whole.items() for row in lines(name, data, 4 if seed == 3 else 0)]
    assert sorted(got) == sorted(want)


def test_a_line_longer_than_ranges_and_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(logtail, "_CHUNK", 16)
    folder = Folder(tmp_path, rangeBytes="10")
    folder.add("a", b"x" * 1000)
    assert folder.batch() == []
    folder.add("a", b"y" * 100 + b"\nend\n")
    assert folder.batch() == [("a", 0, "x" * 1000 + "y" * 100), ("a", 1101, "end")]


def test_driver_opens_no_file(tmp_path, monkeypatch):
    folder = Folder(tmp_path)
    folder.add("a", b"one\ntwo")

    def refuse(*args, **kwargs):
        raise AssertionError("opened a file")

    with monkeypatch.context() as patch:
        patch.setattr(builtins, "open", refuse)
        end = folder.reader.latestOffset()
        assert len(folder.reader.partitions(folder.offset, end)) == 1


def test_offsets_forget_files_that_rest(tmp_path):
    folder = Folder(tmp_path, idleSeconds="0.05")
    got, sizes = [], []
    for i in range(30):
        folder.add(f"log-{i}", b"first\nsecond\n")
        got += folder.batch()
        sizes.append(len(folder.offset["open"]))
        time.sleep(0.02)
    # Files that came and rested between two batches are read as well.
    for i in range(30, 40):
        folder.add(f"log-{i}", b"first\nsecond\n")
        time.sleep(0.02)
    got += folder.batch()
    assert max(sizes) <= 6 and len(folder.offset["open"]) <= 6
    assert sorted(got) == sorted(row for i in range(40) for row in lines(f"log-{i}", b"first\nsecond\n"))


def test_a_new_reader_goes_on_from_its_offset(tmp_path):
    folder = Folder(tmp_path)
    folder.add("a", b"one\ntw")
    folder.add("b", b"x\n")
    first = folder.batch()
    later = Folder(tmp_path)
    later.offset = folder.offset
    assert later.batch() == []
    later.add("a", b"o\n")
    assert first + later.batch() == [("a", 0, "one"), ("b", 0, "x"), ("a", 4, "two")]


def test_limited_batches(tmp_path):
    folder = Folder(tmp_path, maxBytesPerBatch="10")
    data = {name: b"".join(b"%d\n" % (100 + i) for i in range(20)) for name in "ab"}
    for name, text in data.items():
        folder.add(name, text)
    batches = [folder.batch() for _ in range(18)]
    assert max(len(rows) for rows in batches) <= 3
    assert sorted(sum(batches, [])) == sorted(row for name, text in data.items() for row in lines(name, text))

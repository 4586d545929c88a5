import json
import random
import zipfile

from ledgerlens.operators import trees
from ledgerlens.sources import datasource as D
from ledgerlens.sources import exports


def zipped(path, members, links=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            if name in links:
                info.external_attr = 0o120777 << 16
            z.writestr(info, content)


def test_files_of_all_kinds(spark, tmp_path, monkeypatch):
    linear = [{"uuid": "c1", "name": "t", "chat_messages": [{"uuid": "a", "sender": "human", "text": "hi"}, {"uuid": "b", "sender": "assistant", "text": "ho"}]}]
    generic = {"format": "conversation-import", "conversations": [{"id": "g", "title": None, "messages": [{"id": "1", "parent": None, "role": "user", "text": "x"}]}]}
    tmp_path.joinpath("deep").mkdir()
    tmp_path.joinpath("deep/a.json").write_text(json.dumps(linear))
    tmp_path.joinpath("bom.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(generic).encode())
    tmp_path.joinpath("b.jsonl").write_text(json.dumps(linear[0]) + "\n\n{broken\n" + json.dumps({"odd": 1}) + "\n")
    tmp_path.joinpath("bad.json").write_text('{"a": ')
    tmp_path.joinpath("latin.json").write_bytes(b'["\xe9"]')
    tmp_path.joinpath("note.MD").write_text("# Title\ntext")
    tmp_path.joinpath("x.bin").write_bytes(b"\0")
    tmp_path.joinpath("_hidden.json").write_text("{")
    tmp_path.joinpath("cut.zip").write_bytes(b"PK\x03\x04 no archive")
    zipped(tmp_path / "ok.zip", [("d/one.json", json.dumps(linear)), ("page.html", "<p>x"), ("in.zip", b"PK"), ("odd.exe", "x"), ("bad.json", "[")])
    zipped(tmp_path / "up.zip", [("../one.json", "[]")])
    zipped(tmp_path / "abs.zip", [("/one.json", "[]")])
    zipped(tmp_path / "drive.zip", [("C:\\one.json", "[]")])
    zipped(tmp_path / "link.zip", [("l.json", "[]")], links=["l.json"])
    zipped(tmp_path / "nest.zip", [("a.zip", "x"), ("b.tar", "x")])
    zipped(tmp_path / "bomb.zip", [("z.json", "0" * 3_000_000)])
    files = D.read_files(spark, str(tmp_path))
    got = {(r.path.removeprefix(f"{tmp_path}/"), r.member, r.record): (r.kind, r.fault) for r in files.collect()}
    assert got == {
        ("deep/a.json", None, 0): ("json", None), ("bom.json", None, 0): ("json", None), ("b.jsonl", None, 0): ("jsonl", None), ("b.jsonl", None, 2): ("jsonl", "malformed"), ("b.jsonl", None, 3): ("jsonl", None),
        ("bad.json", None, 0): ("json", "malformed"), ("latin.json", None, 0): ("json", "not_utf8"), ("note.MD", None, 0): ("transcript", None), ("x.bin", None, 0): ("other", "unknown_ending"), ("cut.zip", None, 0): ("zip", "malformed"),
        ("ok.zip", "d/one.json", 0): ("json", None), ("ok.zip", "page.html", 0): ("activity", None), ("ok.zip", "in.zip", 0): ("zip", "archive_inside"), ("ok.zip", "odd.exe", 0): ("other", "unknown_ending"), ("ok.zip", "bad.json", 0): ("json", "malformed"),
        ("up.zip", None, 0): ("zip", "unsafe_path"), ("abs.zip", None, 0): ("zip", "unsafe_path"), ("drive.zip", None, 0): ("zip", "unsafe_path"), ("link.zip", None, 0): ("zip", "special_file"), ("nest.zip", None, 0): ("zip", "nested"), ("bomb.zip", None, 0): ("zip", "ratio"),
    }
    messages, faults = D.imported(files)
    read = [(r.format, r.conv, r.node, r.role, r.text) for r in messages.where("format = 'linear'").collect()]
    assert set(read) == {("linear", "c1", "a", "user", "hi"), ("linear", "c1", "b", "assistant", "ho")} and len(read) == 6
    assert {(r.format, r.conv) for r in messages.collect()} == {("linear", "c1"), ("generic", "g")}
    assert {(r.path.removeprefix(f"{tmp_path}/"), r.record) for r in faults.where("fault = 'unknown_format'").collect()} == {("b.jsonl", 3)}
    assert faults.count() == 14 + 1


def test_limits_of_archives(tmp_path):
    info = lambda size, name="a.json": type("Info", (), {"file_size": size, "filename": name, "external_attr": 0})()
    assert D.archive_fault([info(1)], exports.MAX_COMPRESSED + 1) == "too_large"
    assert D.archive_fault([info(exports.MAX_EXPANDED + 1)], exports.MAX_COMPRESSED) == "expands_too_far"
    assert D.archive_fault([info(1)] * (exports.MAX_FILES + 1), 10**6) == "too_many_files"
    assert D.archive_fault([info(100)], 1) is None and D.archive_fault([info(101)], 1) == "ratio" and D.archive_fault([info(5, "x.zip")], 1) is None


def test_planning_by_size(spark, tmp_path):
    assert [f.paths for f in D.planned([("b", 5), ("a", 5), ("c", 20), ("d", 1), ("e", 9)], 10)] == [["a", "b"], ["c"], ["d", "e"]]
    assert D.planned([], 10) == []
    for i in range(6):
        tmp_path.joinpath(f"{i}.json").write_text("[]")
    assert D.read_files(spark, f"file://{tmp_path}", taskbytes="4").rdd.getNumPartitions() == 3
    empty = tmp_path / "empty"
    empty.mkdir()
    assert D.read_files(spark, str(empty)).count() == 0


def test_walk_matches_a_loop(spark):
    rng = random.Random(3)
    nodes, leaves, want = [], [], []
    for c in range(80):
        n = rng.randrange(1, 14)
        parent = {i: rng.choice([None, *range(n), 99]) for i in range(n)}
        leaf = rng.choice([*range(n), 77])
        nodes += [(c, i, p) for i, p in parent.items()]
        leaves.append((c, leaf))
        seen, at = [], leaf
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        want += [(c, x, k) for k, x in enumerate(seen)]
    nodes += [(500, i, i - 1 if i else None) for i in range(700)]
    leaves.append((500, 699))
    want += [(500, 699 - k, k) for k in range(700)]
    got = trees.walked(spark.createDataFrame(nodes, "conv long, node long, parent long"), spark.createDataFrame(leaves, "conv long, leaf long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)

import dataclasses
import io
import json
import socket
import tarfile
import time
import zipfile

import pytest

from loomcast import __main__ as command
from loomcast import config
from loomcast.operators import curation
from loomcast.sources import connectors, writers
from loomcast.streaming import run, search


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"search": {"dwell_s": 60}, "x": 1}')
    told = config.override(config.load(spark, str(tmp_path / "a.json")), ["search.dwell_s=90", "course.surge=0.5", "name=v2", "on=true"])
    assert told == {"search": {"dwell_s": 90}, "x": 1, "course": {"surge": 0.5}, "name": "v2", "on": True}
    for bad in ("nothing", "=1", "x.y=1"):
        with pytest.raises(ValueError):
            config.override({"x": 1}, [bad])
    s = config.apply(search.Search(), {"dwell_s": 5.0, "course": {"surge": 0.1}})
    assert s.dwell_s == 5.0 and s.course.surge == 0.1 and s.course.speed == search.Course().speed
    with pytest.raises(ValueError):
        config.apply(search.Search(), {"dwel_s": 5.0})
    assert config.apply(search.Search(), {"dwel_s": 5.0}, strict=False) == search.Search()
    with pytest.raises(ValueError):
        config.parse("[1, 2]")


def test_deployed_settings_differ_from_the_defaults():
    own = curation.Settings.of(config.DEPLOYED["curation"])
    assert own.per_group == 4000 and len(own.source_caps) == 5 and curation.Settings().per_group is None
    assert config.apply(search.Steer(), config.DEPLOYED["steering"]).ahead == 0.4 and search.Steer().ahead == 0.5
    assert {f.name for f in dataclasses.fields(search.Steer)} >= {"size", "standoff"}


def test_commands(spark, tmp_path):
    assert "bucket_balance" in command.main(["queries"])
    out = command.main(["fetch", "synthetic", "-", str(tmp_path / "s"), "--set", "n=6"], spark)
    assert out == "synthetic: 6 records"
    told = command.main(["simulate", str(tmp_path / "d"), "--hours", "0.02", "--seeds", "0", "1", "--set", "sea.side=40.0"], spark)
    assert told.splitlines()[2].startswith("| adaptive | 0.3 | True | 2 |")
    with pytest.raises(SystemExit):
        command.main(["nothing"])


def test_datagrams(spark, tmp_path):
    assert connectors.datagram(b'{"depth_m": 3, "heading_deg": null, "x": 1}') == {"depth_m": 3.0, "heading_deg": None}
    assert connectors.datagram(b"{") is None and connectors.datagram(b"[1]") is None and connectors.datagram(b'{"depth_m": "deep"}') is None
    assert connectors.navigation(spark, None) is None
    with pytest.raises(ValueError):
        connectors.navigation(spark, {"kind": "mavlink"})
    r = connectors.UdpReader("127.0.0.1", 0)
    port = r.socket.getsockname()[1]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for x in (b'{"depth_m": 1}', b"broken", b'{"depth_m": null}'):
            s.sendto(x, ("127.0.0.1", port))
    time.sleep(0.2)
    rows, end = r.read(r.initialOffset())
    rows = list(rows)
    assert [x[2] for x in rows] == [{"depth_m": 1.0}, None, {"depth_m": None}] and end == {"n": 3}
    assert len(list(r.readBetweenOffsets({"n": 1}, end))) == 2
    r.commit(end)
    assert list(r.read(end)[0]) == []
    r.socket.close()


def test_sinks(spark, tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        send = writers.fan_out(writers.sinks([{"kind": "null"}, {"kind": "jsonl", "path": str(tmp_path / "log")}, {"kind": "udp", "port": s.getsockname()[1]}]))
        send(spark.createDataFrame([(1, "SEARCH")], "t int, state string"), 0)
        assert json.loads(s.recv(1000)) == {"t": 1, "state": "SEARCH"}
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    with pytest.raises(ValueError):
        writers.sinks([{"kind": "mavlink"}])


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/b.txt", "x")
    assert writers.extract(str(tmp_path / "ok.zip"), str(tmp_path / "out")) == ["a/b.txt"] and (tmp_path / "out/a/b.txt").read_text() == "x"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    for name, make in (("up.tar", lambda m: m), ("link.tar", lambda m: setattr(m, "type", tarfile.SYMTYPE) or setattr(m, "linkname", "/etc/passwd") or m)):
        with tarfile.open(tmp_path / name, "w") as t:
            t.addfile(make(tarfile.TarInfo("../evil.txt" if name == "up.tar" else "x")), io.BytesIO(b""))
    for name in ("bad.zip", "up.tar", "link.tar"):
        with pytest.raises(OSError):
            writers.extract(str(tmp_path / name), str(tmp_path / "out2"))
    assert not (tmp_path / "evil.txt").exists() and not (tmp_path / "out2").exists()


def test_packed_files_go_once_they_are_held(spark, tmp_path):
    for name, text in (("i/a", "one"), ("i/b", "two"), ("j/c", "three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    loose = spark.createDataFrame([("i/a", bytearray(b"one"), 1.0), ("i/b", bytearray(b"two"), 1.0), ("j/c", bytearray(b"three"), 1.0)], "key string, content binary, mtime double")
    packs = writers.pack(loose, None).selectExpr("key", "CASE WHEN key = 'i/b' THEN CAST('tw?' AS BINARY) ELSE content END AS content", "length", "mtime", "crc32", "part").cache()
    assert sorted(r.key for r in writers.deletable(packs, loose).collect()) == ["i/a", "j/c"]
    assert writers.delete_packed(packs, loose.select("key", "content"), str(tmp_path)) == 2
    assert not (tmp_path / "i/a").exists() and (tmp_path / "i/b").exists() and not (tmp_path / "j").exists() and tmp_path.exists()


def test_recordings_and_encounters(spark):
    frames = spark.createDataFrame([(1, 0.0, []), (1, 10.0, ["encounter_start", "start_recording"]), (1, 40.0, ["stop_recording", "start_recording"]), (1, 60.0, ["stop_recording"]), (1, 90.0, ["start_recording"]), (2, 5.0, [])], "vehicle long, t double, events array<string>")
    files = run.recordings(frames, "vehicle", "t", "events")
    assert sorted(map(tuple, files.collect())) == [(1, 1, 5.0, 40.0), (1, 2, 35.0, 60.0), (1, 3, 85.0, None)]
    encounters = spark.createDataFrame([(1, 1, 12.0, 38.0), (1, 2, 95.0, 99.0), (1, 3, 70.0, 80.0), (2, 4, 12.0, 38.0)], "vehicle long, id long, t_start double, t_end double")
    got = {r.id: [tuple(f) for f in r.files] for r in run.encounter_files(encounters, files, "vehicle").collect()}
    assert got == {1: [(1, 7.0), (2, 0.0)], 2: [(3, 10.0)], 3: [], 4: []}
    seen = []
    run.on_close(files, "vehicle", [lambda b: seen.extend(b.collect())])(encounters, 0)
    assert len(seen) == 4


def test_mirrors():
    import hashlib

    pages = {"a": (404, b""), "b": (200, b"half"), "c": (200, b"whole")}
    get = lambda url: pages[url]
    assert connectors.fetch_mirror(get, ["a", "b", "c"], hashlib.sha256(b"whole").hexdigest()) == b"whole"
    assert connectors.fetch_mirror(get, ["a", "b"]) == b"half"
    with pytest.raises(OSError, match="another checksum"):
        connectors.fetch_mirror(get, ["a", "b"], "00")


def test_files_appear_whole(spark, tmp_path):
    for text in ("first", "zweite ü"):
        writers.write_file(spark, str(tmp_path / "x/a.json"), text)
        assert (tmp_path / "x/a.json").read_text() == text
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["a.json"]

import math
import pickle

import pytest

from loomcast.streaming import search as S


def sail(m, rows, **fixed):
    """Feed a planner a vehicle that follows its setpoints; answers and depths."""
    depth, heading, surge, out = fixed.pop("depth", 25.0), 0.0, 0.0, []
    for row in rows:
        told = m.step({"hour": 12.0, "searching": True, "detected": False, "ended": None, "altitude": None, "depth": depth, "heading": heading, "surge": surge} | fixed | row)
        out.append(told | {"t": row["t"], "at": depth})
        if told["depth"] is not None:
            depth += S.within(told["depth"] - depth, fixed.get("sink", 2.0))
        if told["heading"] is not None:
            heading = (heading + S.within(S.turn(told["heading"] - heading), 20.0)) % 360
        surge = told["surge"]
    return out


def test_profile_then_bands():
    m = S.Search()
    out = sail(m, [{"t": float(i)} for i in range(900)])
    assert {r["mode"] for r in out[:170]} == {"profile"} and max(r["at"] for r in out) > 195
    assert not m.reach.sweep and {r["mode"] for r in out[300:]} <= {"transect", "drift"}
    assert all(20 <= r["depth"] <= 200 for r in out) and len({r["depth"] for r in out[300:]}) > 1


def test_the_bottom_ends_the_way_down():
    m = S.Search()
    out = sail(m, [{"t": float(i), "altitude": None} for i in range(600)], sink=0.0, depth=80.0)
    assert m.reach.high == 80.0 and m.reach.low == 80.0 and not m.reach.sweep
    assert {r["depth"] for r in out[200:]} <= {75.0, 85.0, 20.0}
    m = S.Search(reach=S.Reach(sweep=[]))
    assert all(r["depth"] <= 95.0 + 1e-9 for r in sail(m, [{"t": float(i), "altitude": 100.0 - 90.0} for i in range(50)], depth=90.0, sink=0.0))


def test_bands_learn():
    b = S.Bands()
    for _ in range(50):
        b.add(105.0, 60.0, True)
        b.add(55.0, 60.0, False)
    picks = [b.choose(12.0, 20.0, 200.0) for _ in range(200)]
    assert picks.count(b.of(105.0)) > 120 and picks.count(b.of(55.0)) == 0
    b.pass_time(1200.0)
    assert b.met[b.of(105.0)] == pytest.approx(25) and max(b.rates()) == b.rates()[b.of(105.0)]
    assert b.prior(b.of(150.0), 18.0) == 3.0 and b.prior(b.of(50.0), 18.0) == 1.0 and b.prior(0, 12.0) == 1.0 and b.prior(b.of(60.0), 1.0) > b.prior(b.of(180.0), 1.0)
    assert b.of(-5.0) == 0 and b.of(999.0) == len(b.met) - 1
    assert {b.choose(12.0, 95.0, 105.0) for _ in range(50)} <= {b.of(95.0), b.of(105.0)}


def test_after_an_animal():
    rows = [{"t": float(i)} for i in range(60)]
    m = S.Search(reach=S.Reach(sweep=[]))
    assert {r["mode"] for r in sail(m, [{"t": 0.0}, {"t": 1.0, "ended": "swarm"}, *[{"t": 2.0 + i} for i in range(150)]])[1:]} == {"loops"}
    m = S.Search(reach=S.Reach(sweep=[]))
    sail(m, rows)
    out = sail(m, [{"t": 60.0, "ended": "mobile"}, *[{"t": 61.0 + i} for i in range(300)]])
    assert out[0]["mode"] == "move_on" and out[-1]["mode"] in ("transect", "drift") and math.hypot(m.wake.x, m.wake.y) > 20
    m = S.Search(reach=S.Reach(sweep=[]))
    out = sail(m, [{"t": 0.0, "ended": "drifter"}, *rows[1:]], depth=77.0)
    assert {r["depth"] for r in out} == {77.0}
    m = S.Search(reach=S.Reach(sweep=[]))
    out = sail(m, [{"t": 0.0, "detected": True}, *[{"t": 1.0 + i} for i in range(120)]])
    assert out[50]["mode"] == "loops" and out[-1]["mode"] != "loops"


def test_loops_widen():
    m = S.Search(reach=S.Reach(sweep=[]), course=S.Course(surge=0.35))
    apart = []
    sail(m, [{"t": 0.0}])
    m.course.loops(0.0, 1e9, m.wake)
    for k in range(3):
        sail(m, [{"t": 1.0 + 400 * k + i} for i in range(400)])
        apart.append(math.hypot(m.wake.x, m.wake.y))
    assert apart[0] < apart[1] < apart[2] < 40


def test_strategies_and_crossings():
    rows = [{"t": float(i)} for i in range(700)]
    scan = sail(S.Search("scan"), rows)
    assert {r["yaw"] for r in scan} == {-0.15, 0.15} and {r["depth"] for r in scan} == {None}
    assert {r["depth"] for r in sail(S.Search("legs"), rows)} == {None} and sail(S.Search("depth"), rows)[-1]["depth"] is not None
    blind = sail(S.Search(), rows, heading=None, depth=None)
    assert {r["mode"] for r in blind} == {"look", "hop"} and {r["surge"] for r in blind} == {0.0, 0.35}
    dusk = sail(S.Search(reach=S.Reach(sweep=[])), rows, hour=18.0)
    assert {r["mode"] for r in dusk} == {"hover", "relocate"} and {r["surge"] for r in dusk if r["mode"] == "hover"} == {0.0}


def test_new_legs_go_where_nothing_was():
    w = S.Wake()
    for i in range(40):
        w.move(float(i), 0.0, 5.0)
    w.x = w.y = 0.0
    assert w.visited(40.0, 0.0, 200.0) > 2 > w.visited(40.0, 180.0, 200.0) == 0
    assert S.turn(350.0) == -10 and S.turn(-190) == 170


def test_steering():
    s = S.Steer()
    go = lambda t, **row: s.step({"t": t} | row)
    assert go(0.0, mode="track", yaw=1.0, pitch=-1.0, size=0.22) == {"yaw": 0.0, "heave": 0.0, "surge": 0.0}
    right = [go(0.1 * i, mode="track", yaw=30.0, pitch=0.0, size=0.1) for i in range(1, 20)]
    assert right[0]["yaw"] == pytest.approx(0.2) and right[-1]["yaw"] == pytest.approx(0.8) and right[-1]["surge"] == 0
    near = [go(2.0 + 0.1 * i, mode="track", yaw=30.0, pitch=0.0, size=0.9) for i in range(1, 20)]
    assert near[-1]["surge"] == pytest.approx(-0.3)
    ahead = [go(5.0 + i, mode="track", yaw=3.0, pitch=0.0, size=0.1) for i in range(3)]
    assert ahead[-1]["surge"] == pytest.approx(0.36)
    assert go(10.0, mode="lost", yaw=-5.0)["yaw"] == pytest.approx(-0.3)
    assert go(12.0, mode="release", elapsed=0.5, away=1.0)["surge"] == pytest.approx(-0.2)
    assert go(14.0, mode="release", elapsed=3.0, away=-1.0)["yaw"] == pytest.approx(-0.6)
    assert go(16.0, mode="release", elapsed=9.0, away=-1.0)["surge"] == pytest.approx(0.3)
    turning = go(18.0, mode="release", elapsed=9.0, away=1.0, heading=0.0, goal=120.0)
    assert turning["yaw"] == pytest.approx(0.6) and turning["surge"] == 0
    assert go(30.0, mode="hold") == {"yaw": 0.0, "heave": 0.0, "surge": 0.0}


def frame(t, prob, yaw=0.0, size=0.2, **more):
    found = prob > 0.5
    return {"t": t, "frame_prob": prob, "peak": prob, "found": found, "yaw": yaw if found else None, "pitch": 0.0 if found else None, "size": size if found else None, "blobs": int(found), "vector": [1.0, 0.0, 0.0], "hour": 12.0, "depth": 50.0, "heading": 0.0, "altitude": None, "luma": 0.3, "grid": None, "weak": None} | more


def test_the_whole_guidance():
    p, out = S.Pilot(search=S.Search(reach=S.Reach(sweep=[]))), []
    for i in range(900):
        t = i / 5
        seen = 100 <= i < 400
        out.append(p.step(frame(t, 0.9 if seen else 0.1, yaw=max(0.0, 20 - (i - 100) / 5), weak=(0.8, 0.5) if i in (50, 51) else None, grid=None)))
        if i == 300:
            p = pickle.loads(pickle.dumps(p))
    states = [r["state"] for r in out]
    assert {"SEARCH", "ACQUIRE", "TRACK", "FILM", "LOST"} <= set(states)
    assert out[52]["look"]["looking"] and out[52]["command"]["yaw"] > 0
    first = states.index("TRACK")
    assert out[first + 5]["command"]["yaw"] > 0 and all(abs(a["command"]["yaw"] - b["command"]["yaw"]) <= 0.41 for a, b in zip(out, out[1:]))
    assert any(r["encounter"] for r in out) and out[-1]["search"]["mode"] in ("transect", "drift", "loops", "move_on") and out[-1]["lamp"]["level"] == 0
    assert S.safe_row(1.23456, "SAFE", 0.5, 0.25)["cmd"]["light"] == 0


def test_pilot_as_a_replay(spark):
    from loomcast.streaming import run

    rows = [(v, *[frame(i / 5, 0.9 if 50 <= i < 150 else 0.1)[k] for k in ("t", "frame_prob", "peak", "found", "yaw", "pitch", "size", "blobs", "vector", "hour", "depth", "heading", "altitude", "luma")]) for v in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "vehicle long, t double, frame_prob double, peak double, found boolean, yaw double, pitch double, size double, blobs int, vector array<double>, hour double, depth double, heading double, altitude double, luma double").selectExpr("*", "CAST(NULL AS array<array<double>>) AS grid", "CAST(NULL AS array<double>) AS weak")
    out = run.replay(df, "vehicle", ["t"], S.Pilot, "vehicle long, t double, state string, command struct<yaw: double, heave: double, surge: double>", ["vehicle", "t"]).collect()
    assert len(out) == 400 and {"SEARCH", "TRACK"} <= {r.state for r in out}
    assert [r.state for r in sorted(out) if r.vehicle == 1] == [r.state for r in sorted(out) if r.vehicle == 2]

"""Workspaces and decisions against plain walks over their logs."""

import random

import pytest

from junctura.operators import curation


def walked(log):
    """The state machine as written: a list of versions, the workspace, the status."""
    versions, current, number, status = [], None, 0, "open"

    def put(p):
        nonlocal current, number
        versions.append(p)
        current, number = (p,), len(versions)

    def clear():
        nonlocal current, number
        if current is not None:
            versions.append(None)
        current, number = None, 0

    for action, payload in log:
        if action == "save" or action == "undo" and len(versions) >= 2:
            put(payload if action == "save" else versions[-2])
            status = "in_review" if status == "open" else status
        elif action == "reset" or action == "undo" and len(versions) == 1:
            clear()
            status = "open"
        elif action == "reopen" and status in ("resolved", "dismissed"):
            status = "in_review" if current else "open"
        elif action == "resolve" and current or action in ("dismiss", "dismiss_clear"):
            if current:
                put(current[0])
            if action == "dismiss_clear":
                clear()
            status = "resolved" if action == "resolve" else "dismissed"
    return status, current is not None, number, len(versions), current[0] if current else None


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_workspace_state(spark, block):
    r = random.Random(block)
    logs = {1: ["save", "save", "undo", "save"], 2: ["save", "save", "undo", "undo"], 3: ["save", "reset", "save", "undo"], 4: ["undo"], 5: ["save", "undo"], 6: ["resolve", "dismiss"]}
    logs |= {k: r.choices(curation.ACTIONS, [5, 4, 1, 1, 1, 1, 1], k=r.randint(1, 25)) for k in range(10, 150)}
    logs = {k: [(a, f"p{k}.{i}" if a == "save" else None) for i, a in enumerate(log)] for k, log in logs.items()}
    events = spark.createDataFrame([(k, i * 7 + k, a, p) for k, log in logs.items() for i, (a, p) in enumerate(log)], "cluster_key long, version long, action string, payload string")
    got = {x.cluster_key: (x.status, x.has_workspace, x.version, x.versions, x.payload) for x in curation.workspace_state(events, block).collect()}
    assert got == {k: walked(log) for k, log in logs.items()}
    assert got[1][-1] == "p1.3" and got[2][-1] == "p2.1" and got[3][:2] == ("in_review", True)


def applied(log, stations):
    """Decisions one after the other, as written. stations: id -> [name, country, lat, lon, active]."""
    at_station, into = {k: k for k in stations}, {}
    for _, group, name in log:
        members = list(dict.fromkeys(group))
        target = members[0]
        if len(members) > 1:
            rows = [stations[m] for m in members if m in stations]
            spots = [(r[2], r[3]) for r in rows if r[2] is not None and r[3] is not None]
            at_station = {k: target if s in members[1:] else s for k, s in at_station.items()}
            for m in members[1:]:
                if m in stations:
                    stations[m][4], into[m] = False, target
            if target in stations:
                t = stations[target]
                t[1] = next((r[1] for r in rows if r[1]), None) or t[1]
                if spots:
                    t[2], t[3] = (sum(s[j] for s in spots) / len(spots) for j in (0, 1))
                t[4] = True
        if name and target in stations:
            stations[target][0] = name
    return at_station, stations, into


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions(spark, seed):
    from junctura.operators import decisions

    r = random.Random(seed)
    stations = {k: [f"n{k}", r.choice(["DE", "FR", "", None]), *((r.uniform(-9, 9), r.uniform(-9, 9)) if r.random() < 0.8 else (None, None)), True] for k in range(60)}
    log = [(1, [1, 2], None), (2, [3, 1], None), (3, [2, 3], None), (4, [1, 2, 2, 1], "back"), (5, [9, 9], "alone"), (6, [8], "renamed"), (7, [70, 7], None), (8, [10, 71], None)]
    log += [(10 + 3 * k, r.choices(range(62), k=r.randint(1, 4)), r.choice([None, "", f"new{k}"])) for k in range(60)]
    rows = spark.createDataFrame([(at, p, s, name) for at, group, name in log for p, s in enumerate(group)], "at long, pos int, station_id long, rename_to string")
    table = spark.createDataFrame([(k, *v) for k, v in stations.items()], "station_id long, display_name string, country string, lat double, lon double, is_active boolean")
    mappings = spark.createDataFrame([(k, f"m{k}", k % 7 > 0) for k in stations], "station_id long, ref string, is_active boolean")
    at_station, after, into = applied(log, {k: list(v) for k, v in stations.items()})
    got = {x.ref: x.station_id for x in decisions.moved(mappings, decisions.redirects(rows)).collect()}
    assert got == {f"m{k}": at_station[k] if k % 7 else k for k in stations}
    for x in decisions.decided_stations(rows, table).collect():
        name, country, lat, lon, active = after[x.station_id]
        assert (x.display_name, x.country or None, x.is_active, x.merged_into) == (name, country or None, active, into.get(x.station_id)), x
        assert (x.lat is None) == (lat is None) and (lat is None or abs(x.lat - lat) + abs(x.lon - lon) < 1e-9)
    empty = rows.limit(0)
    assert decisions.redirects(empty).count() == 0 and decisions.decided_stations(empty, table).count() == 60


def test_decisions_share_members(spark):
    """Members are worked out once for both functions; 20 merges that build on one another are more than one plan keeps apart."""
    from junctura.operators import decisions

    log = spark.createDataFrame([(at, p, s, None) for at in range(1, 21) for p, s in enumerate((at, at - 1))], "at long, pos int, station_id long, rename_to string")
    table = spark.createDataFrame([(k, f"n{k}", "DE" if k == 0 else None, *((8.0, 1.0) if k == 0 else (None, None)), True) for k in range(21)], "station_id long, display_name string, country string, lat double, lon double, is_active boolean")
    m = decisions.members(log)
    assert decisions.members(m) is m
    assert {x.station_id: x.final_id for x in decisions.redirects(m).collect()} == dict.fromkeys(range(20), 20)
    got = {x.station_id: (x.country, x.lat, x.lon, x.is_active, x.merged_into) for x in decisions.decided_stations(m, table).collect()}
    assert got == {k: ("DE", 8.0, 1.0, k == 20, k + 1 if k < 20 else None) for k in range(21)}


def test_members_are_dealt_once(spark):
    """Removals by one deal of each entity's rows: doubled members and removals, nulls, entities that keep one."""
    from junctura.operators import curation

    kind = "cluster_key long, entity_id long, member long"
    merges = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 2, 1), (2, 1, 1), (2, 1, 2), (3, 1, None), (3, 1, 1), (3, 1, 2), (None, 1, 1), (None, 1, 2)], kind)
    removed = spark.createDataFrame([(1, 1, 3), (1, 1, 3), (2, 1, 2), (3, 1, None), (9, 9, 9)], kind)
    found = curation.without_member(merges, removed)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 1, 1), (1, 1, 2), (1, 1, 2), (3, 1, None), (3, 1, 1), (3, 1, 2)], key=repr)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_inputs_are_looked_up_once(spark):
    """Each distinct input is looked up once, whatever number of rows asks for it, and all rows are answered."""
    from junctura.operators import lookup

    stops = spark.createDataFrame([(1, "5", "Nord", "1", "1.0", "2.0")], "seq long, stop_id string, stop_name string, location_type string, stop_lat string, stop_lon string")
    texts = ["5", " nord ", "", None, "Else [5]", "1.50,2"]
    rows = [(k, texts[k % 6]) for k in range(600)]
    found = lookup.resolved(spark.createDataFrame(rows, "key long, input string"), lookup.index(stops, "tg"), "tg")
    want = [("5", "tg_5", "station_lookup", "5"), ("nord", "tg_5", "station_lookup", "5"), ("", "", "empty", None), ("", "", "empty", None), ("Else [5]", "tg_5", "station_lookup", "5"), ("1.50,2", "1.5,2", "coordinates", None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(k, *want[k % 6]) for k in range(600)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [input" in plan

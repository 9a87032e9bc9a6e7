"""Edits in bulk against the same edits one after another."""

import random

import pandas as pd

from gemello.operators import cursor, edits

REGIONS = "file string, side string, id long, parent_id long, ord int, start long, end long, is_leaf boolean, alignment_id long, fold_state_id long"
REQUESTS = "file string, request long, kind string, ids array<long>, offset int"


def random_file(rng, name):
    """Two sides of one tree; some leaves only on one, some of other lengths."""
    rows, ids, states = [], {"lhs": 0, "rhs": 1000}, [0]

    def put(parents, ord_, starts, deep):
        sides = [s for s in ("lhs", "rhs") if s in parents and (deep == 0 or rng.random() < 0.85)]
        state, ends = states[0], {}
        states[0] += 1
        leaf = deep > 0 and (deep == 3 or rng.random() < 0.5)
        size = rng.randrange(1, 5)
        own = {}
        for s in sides:
            ids[s] += 1
            own[s] = ids[s]
        if leaf:
            for s in sides:
                ends[s] = starts[s] + size + (rng.random() < 0.1)
        else:
            at = {s: starts[s] for s in sides}
            kids = {s: 0 for s in sides}
            for _ in range(rng.randrange(1, 5)):
                for s, e in put(own, kids, at, deep + 1).items():
                    at[s] = e
                    kids[s] += 1
            ends = at
        for s in sides:
            rows.append((name, s, own[s], parents[s], ord_[s] if ord_ else 0, starts[s], ends[s], leaf, state if leaf else None, None if leaf else state))
        return ends

    put({"lhs": None, "rhs": None}, None, {"lhs": 0, "rhs": 0}, 0)
    return rows


def requests_for(rng, rows):
    out = []
    by_parent = {}
    for r in rows:
        by_parent.setdefault((r[1], r[3]), []).append(r)
    for k in range(25):
        if rng.random() < 0.5:
            r = rng.choice(rows)
            out.append((rows[0][0], k, "cut", [rng.choice([r[2], r[2], 99999])], rng.randrange(0, 5)))
        else:
            group = sorted(rng.choice(list(by_parent.values())), key=lambda r: r[4])
            a = rng.randrange(len(group))
            ids = [r[2] for r in group[a : a + rng.randrange(1, 4)]]
            if rng.random() < 0.2:
                ids.append(rng.choice(rows)[2])
            out.append((rows[0][0], k, "join", ids, None))
    return [*out, (rows[0][0], 90, "join", [], None), (rows[0][0], 91, "cut", [], 1), (rows[0][0], 92, "cut", None, None)]


def shape(rows):
    """Trees without ids: (side, start, end, leaf, children), with the pairs of leaves by their places."""
    kids, of = {}, {}
    for r in rows:
        kids.setdefault((r[1], r[3]), []).append(r)
        if r[7]:
            of.setdefault(r[8], []).append((r[1], r[5], r[6]))

    def walk(side, parent):
        return [(r[5], r[6], r[7], walk(side, r[2])) for r in sorted(kids.get((side, parent), []), key=lambda r: r[4])]

    return walk("lhs", None), walk("rhs", None), sorted(sorted(v) for v in of.values())


def test_bulk_edits(spark):
    rng = random.Random(11)
    files = {f"f{i}": random_file(rng, f"f{i}") for i in range(30)}
    asked = {f: requests_for(rng, rows) for f, rows in files.items()}
    regions = spark.createDataFrame([r for rows in files.values() for r in rows], REGIONS)
    after, outcomes = edits.edited(regions, spark.createDataFrame([r for rows in asked.values() for r in rows], REQUESTS))
    got, result = {}, {}
    for r in after.collect():
        got.setdefault(r.file, []).append(tuple(r))
    for r in outcomes.collect():
        result[r.file, r.request] = r.reason
    assert len(result) == sum(map(len, asked.values())) and {r for r in result.values() if r} <= set(edits.REASONS)
    assert {"overlap", "unknown_region", "not_a_leaf", "out_of_range", "too_few", "not_siblings", None} <= set(result.values())
    names = {x.split()[0]: None for x in cursor.REGIONS.split(", ")}
    for f, rows in files.items():
        frame = pd.DataFrame([{**names, "file": r[0], "side": r[1], "id": r[2], "parent_id": r[3], "ord": r[4], "start": r[5], "end": r[6], "alignment_id": r[8], "fold_state_id": r[9], "collapsed": False, "tags": [], "changed": False} for r in rows])
        pairs = {r[2]: [x[2] for x in rows if x[7] and x[8] == r[8]] for r in rows if r[7]}
        hit = {q[1]: set(pairs.get(q[3][0], []) if q[2] == "cut" and q[3] else q[3] or []) for q in asked[f]}
        done = [q for q in asked[f] if result[f, q[1]] is None]
        for a in done:  # what was done doesn't touch, and what overlaps does
            assert not any(a[1] != b[1] and hit[a[1]] & hit[b[1]] for b in done)
        for q in asked[f]:
            alone = cursor.load(frame)
            side = {r[2]: r[1] for r in rows}
            place = {r[2]: r[4] for r in rows}
            runs = [sorted((i for i in q[3] or [] if side.get(i) == s), key=place.get) for s in ("lhs", "rhs")]
            try:
                if q[2] == "cut":
                    alone.cut((q[3] or [-1])[0], q[4] or 0)
                else:
                    if any(i not in side for i in q[3]) or len(q[3]) < 2 or len(set(q[3])) < len(q[3]) or any(len(x) == 1 for x in runs):
                        raise cursor.Refused("unknown_region")
                    alone.join([x for x in runs if x])
                fine = True
            except cursor.Refused:
                fine = False
            assert fine == (result[f, q[1]] in (None, "overlap")), (q, result[f, q[1]])
            if result[f, q[1]] == "overlap":
                assert any(hit[q[1]] & hit[d[1]] for d in done)
        file = cursor.load(frame)
        for q in done:
            if q[2] == "cut":
                file.cut(q[3][0], q[4])
            else:
                side, place = {r[2]: r[1] for r in rows}, {r[2]: r[4] for r in rows}
                file.join([x for x in (sorted((i for i in q[3] if side[i] == s), key=place.get) for s in ("lhs", "rhs")) if x])
        want = [(f, r.side, r.id, None if pd.isna(r.parent_id) else r.parent_id, r.ord, r.start, r.end, not pd.isna(r.alignment_id), r.alignment_id, None) for r in cursor.dump(f, file).itertuples()]
        assert shape(got[f]) == shape(want)


def test_no_requests(spark):
    regions = spark.createDataFrame(random_file(random.Random(1), "f"), REGIONS)
    after, outcomes = edits.edited(regions, spark.createDataFrame([], REQUESTS))
    assert outcomes.count() == 0 and after.count() == regions.count()

"""Region edits: both sides or none, and nothing after a refusal."""

import pandas as pd
import pytest

from gemello.operators import cursor as c


def rows():
    cols = [f.split()[0] for f in c.REGIONS.split(", ")]
    out = []
    for base, side in ((0, "lhs"), (10, "rhs")):
        out += [
            ("f", side, base + 1, None, 0, 0, 30, 100, None, False, None, [], False),
            ("f", side, base + 2, base + 1, 0, 0, 12, None, 0, False, None, [], False),
            ("f", side, base + 3, base + 1, 1, 12, 14, None, 50 + base, False, None, [], True),
            ("f", side, base + 4, base + 1, 2, 14, 30, None, 1, False, None, [], False),
        ]
    return pd.DataFrame(out, columns=cols)


def test_navigation():
    f = c.load(rows())
    assert f.ancestors(2) == [1] and f.siblings(3) == [2, 3, 4] and f.paired_leaf(2) == 12 and f.paired_leaf(3) is None
    assert f.leaves("rhs", 11, 13) == [12, 13] and f.linked(1) == [1, 11] and f.is_one_sided(3) and not f.is_one_sided(1) and f.has_changes(1) and not f.has_changes(2)
    assert f.matching_siblings([2]) == [12] and f.matching_siblings([3]) == [] and f.matching_siblings([2, 4]) is None
    assert f.row_summary(1) == (False, 12, 16, 16)


def test_cut_takes_the_pair_along():
    f = c.load(rows())
    _, new = f.cut(2, 5)
    assert (f.get(2).end, f.get(new).start, f.get(new).end) == (5, 5, 12)
    assert f.paired_leaf(new) is not None and f.get(f.paired_leaf(new)).start == 5 and f.siblings(2)[:2] == [2, new]


@pytest.mark.parametrize("edit, reason", [(lambda f: f.cut(99, 1), "unknown_region"), (lambda f: f.cut(1, 1), "not_a_leaf"), (lambda f: f.cut(2, 12), "out_of_range"), (lambda f: f.join([[2]]), "too_few"), (lambda f: f.join([[2, 4]]), "not_siblings"), (lambda f: f.join([[1, 2]]), "root"), (lambda f: f.link([1, 2]), "conflict"), (lambda f: f.join([[2, 3], [3, 4]]), "conflict")])
def test_refusals_change_nothing(edit, reason):
    f = c.load(rows())
    before = c.dump("f", f)
    with pytest.raises(c.Refused) as e:
        edit(f)
    assert e.value.reason == reason and c.dump("f", f).equals(before)


def test_uneven_pairs_are_not_cut():
    r = rows()
    r.loc[r.id == 12, "end"] = 11
    with pytest.raises(c.Refused, match="uneven_sides"):
        c.load(r).cut(2, 3)


def test_join_link_and_collapse():
    f = c.load(rows())
    fold = f.join([[2, 3], [12, 13]])
    assert len(f.linked(fold)) == 2 and f.get(2).parent.id == fold and (f.get(fold).start, f.get(fold).end) == (0, 14)
    f.set_collapsed(fold, True, "x")
    assert all(f.get(i).collapsed for i in f.linked(fold)) and f.get(fold).label == "x"
    f.link([1, fold])
    assert len(f.linked(1)) == 4 and f.get(1).collapsed


def test_walk_passes_over_new_nodes():
    f, seen = c.load(rows()), []

    def pre(r):
        seen.append(r.id)
        if r.id == 2:
            f.cut(2, 4)
        return True

    f.visit(pre)
    assert seen == [1, 2, 3, 4, 11, 12, 13, 14]


def test_context_over_a_table(spark):
    files = pd.concat([rows(), rows().assign(file="g")])
    whole = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) else v
    table = spark.createDataFrame([tuple(map(whole, r)) for r in files.itertuples(index=False)], c.REGIONS)
    out = c.edited(table, c.keep_context(3)).toPandas()
    for name in ("f", "g"):
        own = out[(out.file == name) & out.collapsed]
        assert sorted(zip(own.side, own.start, own.end, strict=True)) == [("lhs", 0, 9), ("lhs", 17, 30), ("rhs", 0, 9), ("rhs", 17, 30)]
        assert set(own.label) == {"9 unchanged lines", "13 unchanged lines"}
        assert sum(out[(out.file == name) & (out.side == "lhs") & out.fold_state_id.isna()].pipe(lambda d: d.end - d.start)) == 30

"""Edits of one file's regions: the steps that have to walk a tree, over both sides at once.

A file's regions are small and their edits depend on each other, so they run as grouped maps by file; everything that only reads regions is
in operators.regions. A refused edit raises Refused and leaves the file as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

REGIONS = "file string, side string, id long, parent_id long, ord int, start long, end long, fold_state_id long, alignment_id long, collapsed boolean, label string, tags array<string>, changed boolean"
#: Why an edit is refused.
REASONS = ("unknown_region", "not_a_leaf", "root", "out_of_range", "uneven_sides", "not_siblings", "too_few", "conflict", "already_collapsed")


class Refused(ValueError):
    def __init__(self, reason: str):
        assert reason in REASONS
        super().__init__(reason)
        self.reason = reason


@dataclass
class Region:
    id: int
    side: str
    start: int
    end: int
    fold_state_id: int | None = None  # folds
    alignment_id: int | None = None  # leaves
    collapsed: bool = False
    label: str | None = None
    tags: list[str] = field(default_factory=list)
    changed: bool = False
    children: list[Region] = field(default_factory=list)
    parent: Region | None = None

    @property
    def is_leaf(self) -> bool:
        return self.fold_state_id is None


class File:
    """The two trees of a file, with counters for new ids."""

    def __init__(self, roots: dict[str, Region]):
        self.roots = roots
        self.by = {r.id: r for root in roots.values() for r in _walk(root)}
        self.next_id = max(self.by, default=0) + 1
        self.next_alignment = max((r.alignment_id for r in self.by.values() if r.alignment_id is not None), default=-1) + 1
        self.next_state = max((r.fold_state_id for r in self.by.values() if r.fold_state_id is not None), default=0) + 1

    def get(self, ident: int) -> Region:
        if ident not in self.by:
            raise Refused("unknown_region")
        return self.by[ident]

    def ancestors(self, ident: int) -> list[int]:
        r, out = self.get(ident).parent, []
        while r is not None:
            out.append(r.id)
            r = r.parent
        return out

    def siblings(self, ident: int) -> list[int]:
        r = self.get(ident)
        return [c.id for c in r.parent.children] if r.parent else [ident]

    def leaves(self, side: str, start: int, end: int) -> list[int]:
        """Leaves that share a line with [start, end), in order."""
        return [r.id for r in _walk(self.roots[side]) if r.is_leaf and r.start < end and start < r.end] if side in self.roots else []

    def paired_leaf(self, ident: int) -> int | None:
        own = self.get(ident)
        if own.alignment_id is None:
            return None
        return next((r.id for r in self.by.values() if r.side != own.side and r.is_leaf and r.alignment_id == own.alignment_id), None)

    def linked(self, ident: int) -> list[int]:
        own = self.get(ident)
        return [r.id for r in self.by.values() if own.fold_state_id is not None and r.fold_state_id == own.fold_state_id]

    def is_one_sided(self, ident: int) -> bool:
        return not any(r.is_leaf and self.paired_leaf(r.id) is not None for r in _walk(self.get(ident)))

    def has_changes(self, ident: int) -> bool:
        return any(r.changed or (r.is_leaf and self.paired_leaf(r.id) is None) for r in _walk(self.get(ident)))

    def matching_siblings(self, idents: list[int]) -> list[int] | None:
        """The run of siblings on the other side that a run's leaves are paired with: [] if there is none, None if they aren't one run."""
        partners = []
        for i in idents:
            r = self.get(i)
            for leaf in (x for x in _walk(r) if x.is_leaf):
                other = self.paired_leaf(leaf.id)
                if other is not None:
                    top = self.get(other)
                    while top.parent and top.parent.parent and not r.is_leaf and len(partners) >= 0 and top.parent is not self._holder(r, top):
                        top = top.parent
                    if top.id not in partners:
                        partners.append(top.id)
        if not partners:
            return []
        row = self.siblings(partners[0])
        at = [row.index(p) for p in partners if p in row]
        return partners if len(at) == len(partners) and at == list(range(at[0], at[0] + len(at))) else None

    def _holder(self, own: Region, other: Region) -> Region | None:
        """The other side's node that own's parent is linked to, else the other root."""
        if own.parent is not None and own.parent.fold_state_id is not None:
            for r in self.by.values():
                if r.side == other.side and r.fold_state_id == own.parent.fold_state_id:
                    return r
        return self.roots.get(other.side)

    def cut(self, ident: int, offset: int) -> tuple[int, int]:
        """Split a leaf, and the leaf it is paired with, after offset lines; both or none."""
        own = self.get(ident)
        if not own.is_leaf:
            raise Refused("not_a_leaf")
        if not 0 < offset < own.end - own.start:
            raise Refused("out_of_range")
        pair = self.paired_leaf(ident)
        if pair is not None and self.get(pair).end - self.get(pair).start != own.end - own.start:
            raise Refused("uneven_sides")
        alignment, self.next_alignment = self.next_alignment, self.next_alignment + 1
        new = None
        for r in [own] + ([self.get(pair)] if pair is not None else []):
            tail = replace(r, id=self.next_id, start=r.start + offset, alignment_id=alignment if r.alignment_id is not None else None, children=[])
            self.next_id += 1
            self.by[tail.id] = tail
            r.end = r.start + offset
            row = r.parent.children
            row.insert(row.index(r) + 1, tail)
            new = new or tail.id
        return ident, new

    def join(self, runs: list[list[int]]) -> int:
        """Wrap runs of at least two consecutive siblings, one run for each side, in a fold that they share."""
        checked = []
        for run in runs:
            if len(run) < 2:
                raise Refused("too_few")
            nodes = [self.get(i) for i in run]
            holder = nodes[0].parent
            if holder is None:
                raise Refused("root")
            at = [holder.children.index(n) if n.parent is holder else -1 for n in nodes]
            if at != list(range(at[0], at[0] + len(at))) or at[0] < 0:
                raise Refused("not_siblings")
            checked.append((holder, nodes, at[0]))
        if len({n.side for _, nodes, _ in checked for n in nodes}) != len(checked):
            raise Refused("conflict")
        state, self.next_state = self.next_state, self.next_state + 1
        first = None
        for holder, nodes, at in checked:
            fold = Region(self.next_id, nodes[0].side, nodes[0].start, nodes[-1].end, fold_state_id=state, children=nodes, parent=holder)
            self.next_id += 1
            self.by[fold.id] = fold
            holder.children[at : at + len(nodes)] = [fold]
            for n in nodes:
                n.parent = fold
            first = first or fold.id
        return first

    def link(self, idents: list[int]) -> None:
        """Give folds the first one's state; all are collapsed if any was."""
        nodes = [self.get(i) for i in idents]
        if any(n.is_leaf for n in nodes):
            raise Refused("conflict")
        states = {n.fold_state_id for n in nodes}
        shut = any(r.collapsed for r in self.by.values() if r.fold_state_id in states)
        for r in self.by.values():
            if r.fold_state_id in states:
                r.fold_state_id, r.collapsed = nodes[0].fold_state_id, shut

    def set_collapsed(self, ident: int, collapsed: bool, label: str | None = None) -> None:
        """Of a fold's whole state; the label is the one region's."""
        own = self.get(ident)
        for r in self.by.values():
            if r is own or (own.fold_state_id is not None and r.fold_state_id == own.fold_state_id):
                r.collapsed = collapsed
        own.label = label

    def row_summary(self, ident: int) -> tuple[bool, int, int, int]:
        """(anything collapsed, unchanged lines at the start, at the end, longest run of unchanged lines) of a subtree, folded from left to right."""
        shut, lead, trail, longest, total, whole = False, 0, 0, 0, 0, True
        for r in (x for x in _walk(self.get(ident)) if x.is_leaf or x.collapsed):
            shut |= r.collapsed
            if not r.is_leaf:
                continue
            n = r.end - r.start
            total += n
            if r.changed or self.paired_leaf(r.id) is None:
                whole, trail = False, 0
            else:
                trail += n
                lead = total if whole else lead
            longest = max(longest, trail)
        return shut, lead, trail, longest

    def visit(self, pre: Callable[[Region], bool], post: Callable[[Region], None] | None = None) -> None:
        """Walk both trees; nodes made during the walk are passed over, and a pre that says no skips what is below and its post."""
        known = set(self.by)
        for side in ("lhs", "rhs"):
            work = [(self.roots[side], False)] if side in self.roots else []
            while work:
                r, left = work.pop()
                if left:
                    if post:
                        post(r)
                elif r.id in known and pre(r):
                    work.append((r, True))
                    work += [(c, False) for c in reversed(list(r.children))]


def _walk(root: Region):
    work = [root]
    while work:
        r = work.pop()
        yield r
        work += reversed(r.children)


def load(rows: pd.DataFrame) -> File:
    """A file's trees from its region rows."""
    nodes, kids, roots = {}, {}, {}
    whole = lambda v: None if pd.isna(v) else int(v)
    for r in rows.itertuples(index=False):
        nodes[r.id] = Region(int(r.id), r.side, int(r.start), int(r.end), whole(r.fold_state_id), whole(r.alignment_id), bool(r.collapsed), None if pd.isna(r.label) else r.label, list(r.tags) if r.tags is not None else [], bool(r.changed))
        if pd.isna(r.parent_id):
            roots[r.side] = nodes[r.id]
        else:
            kids.setdefault(int(r.parent_id), []).append((r.ord, nodes[r.id]))
    for ident, own in kids.items():
        for _, n in sorted(own, key=lambda x: x[0]):
            n.parent = nodes[ident]
            nodes[ident].children.append(n)
    return File(roots)


def dump(name: str, file: File) -> pd.DataFrame:
    """Region rows of a file's trees."""
    out = []
    for root in file.roots.values():
        for r in _walk(root):
            place = r.parent.children.index(r) if r.parent else 0
            out.append((name, r.side, r.id, r.parent.id if r.parent else None, place, r.start, r.end, r.fold_state_id, r.alignment_id, r.collapsed, r.label, r.tags, r.changed))
    frame = pd.DataFrame(out, columns=[f.split()[0] for f in REGIONS.split(", ")])
    return frame.astype({c: "Int64" for c in ("parent_id", "fold_state_id", "alignment_id")})


def edited(regions: DataFrame, edit: Callable[[File], None]) -> DataFrame:
    """Region tables after an edit of each file. A refused edit leaves its file as it was."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        file = load(rows)
        try:
            edit(file)
        except Refused:
            file = load(rows)
        return dump(rows["file"].iloc[0], file)

    return regions.groupBy("file").applyInPandas(run, REGIONS)


def keep_context(lines: int = 3, least: int = 2) -> Callable[[File], None]:
    """An edit that collapses unchanged lines farther than so many from a change, both sides together."""

    def run(file: File) -> None:
        side = "lhs" if "lhs" in file.roots else "rhs"
        near = [(r.start - lines, r.end + lines) for r in _walk(file.roots[side]) if r.is_leaf and (r.changed or file.paired_leaf(r.id) is None)]
        for leaf in [r for r in _walk(file.roots[side]) if r.is_leaf and not r.changed and file.paired_leaf(r.id) is not None]:
            kept = [any(a <= k < b for a, b in near) for k in range(leaf.start, leaf.end)]
            edges = [k for k in range(1, len(kept)) if kept[k] != kept[k - 1]]
            for k in reversed(edges):
                file.cut(leaf.id, k)
        for r in [x for x in _walk(file.roots[side]) if x.is_leaf and not x.changed and x.parent is not None]:
            n = r.end - r.start
            pair = file.paired_leaf(r.id)
            if pair is None or n < least or any(a < r.end and r.start < b for a, b in near):
                continue
            for i in (r.id, pair):
                file.set_collapsed(i, True, f"{n} unchanged lines")

    return run

"""Which two snapshots a comparison's arguments mean."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable
from dataclasses import dataclass

# Names of the operands that aren't a revision.
INDEX, WORKING_TREE, EMPTY = ":index", ":working-tree", ":empty"


class SelectionError(ValueError):
    """Arguments that mean nothing or more than one thing."""


@dataclass(frozen=True)
class Selection:
    """Snapshots before and after, and the paths to compare, from the root; `merge` names two revisions whose merge base is before."""

    before: str
    after: str
    paths: tuple[str, ...] = ()
    merge: tuple[str, str] | None = None

    def based(self, merge_base: Callable[[str, str], str]) -> Selection:
        """With the merge base in place of what names it, on whichever side that is."""
        if self.merge is None:
            return self
        put = lambda x: merge_base(*self.merge) if x == MERGE else x
        return Selection(put(self.before), put(self.after), self.paths)


MERGE = ":merge-base"


def _sorted_out(items: Iterable[str], is_revision, is_path, separated: bool) -> tuple[list[str], list[str]]:
    revisions: list[str] = []
    paths: list[str] = []
    for x in items:
        rev, path = is_revision(x), is_path(x)
        if rev and path and not separated:
            raise SelectionError(f"{x!r} is both a revision and a path; use -- to separate them")
        if rev and paths:
            raise SelectionError("revisions come before paths; use -- to separate them")
        if not rev and not path:
            raise SelectionError(f"{x!r} is neither a revision nor a path; use -- before pathspecs")
        (revisions if rev else paths).append(x)
    return revisions, paths


def _range(text: str) -> tuple[str, str, bool]:
    """(left, right, whether the left is a merge base) of `A..B` or `A...B`; a side left out is HEAD."""
    dots = "..." if "..." in text else ".."
    a, _, b = text.partition(dots)
    return a or "HEAD", b or "HEAD", dots == "..."


def select(
    items: Iterable[str],
    is_revision: Callable[[str], bool],
    is_path: Callable[[str], bool] = lambda p: False,
    paths: Iterable[str] = (),
    *,
    separated: bool = False,
    cached: bool = False,
    merge_base: bool = False,
    reverse: bool = False,
    prefix: str = "",
    unborn: bool = False,
) -> Selection:
    """The comparison that arguments mean: nothing, `A`, `A B`, `A..B` or `A...B`, then paths, relative to prefix.

    Nothing compares the index with the working tree, one revision is compared with the working tree; cached puts the index after, with
    HEAD before if no revision is given, or nothing at all where HEAD is unborn. merge_base compares from the base of both sides.
    """
    revisions, own = _sorted_out(items, is_revision, is_path, separated)
    ranged = len(revisions) == 1 and ".." in revisions[0]
    if len(revisions) > (1 if cached else 2):
        raise SelectionError("at most two revisions are compared, with the index one")
    if ranged and cached:
        raise SelectionError("the index is compared with one revision, not with a range")
    if merge_base and not revisions:
        raise SelectionError("a merge base needs a revision")
    if merge_base and ".." in revisions[0]:
        raise SelectionError("a range names its own merge base")
    merge = None
    if ranged:
        before, after, of_both = _range(revisions[0])
        if of_both:
            before, merge = MERGE, (before, after)
    else:
        first = revisions[0] if revisions else (EMPTY if unborn else "HEAD") if cached else INDEX
        before, after = first, revisions[1] if len(revisions) == 2 else INDEX if cached else WORKING_TREE
    if merge_base:
        before, merge = MERGE, (revisions[0], revisions[1] if len(revisions) == 2 else "HEAD")
    if reverse:
        before, after = after, before
    normal = tuple(posixpath.normpath(posixpath.join(prefix, p)) for p in (*own, *paths))
    return Selection(before, after, normal, merge)

"""From an additive ensemble to one decision graph with the same class on a declared domain.

The cuts of a feature divide its values into bins; a region is an interval of bins for each
feature, whether the feature may be missing, and for exactly-one groups the members that may be
set.  A search state is a region with, for every tree, the node reached, and the channel scores
added so far, in tree order and single precision.  Forced branches are taken at once, leading
leaves are added, and what no open subtree can read is dropped from the region, so that states
which answer alike become equal.

Spark runs the search in waves: each wave explores from the states of the frontier in parallel,
every task up to a budget of states with a memo of its own, keeps the open states not seen before
(a distinct and an anti join on the state's bytes), and writes them to the shared folder.
Afterwards nodes get structural hashes from the leaves up; equal subgraphs have equal hashes and
so become one node, and nodes with equal children vanish.  Up to ``SMALL`` states this last step
is done in memory, beyond that by joins.

A state whose winner no open leaf can change is a leaf: its channels' least and greatest sums
decide, ties going to the smaller class.  They are not looked for where two witness points of the
region have different classes.  Where trees one by one prove nothing, they are taken two at a time: a pair of
leaves counts only if one point of the region reaches both.  Last, the difference of two classes is bounded as
one exact sum, subtrees that read one feature added up bin by bin, with room for all rounding.  A search beyond ``most_states`` raises; a
graph is never returned incomplete.

With a ``folder`` each wave is kept there with a manifest, and a later call with the same ensemble,
domain and policy goes on after the last whole wave, once the waves were checked.  With a ``region`` the
search starts from a part of the domain, and the graph answers for that part alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce
from itertools import zip_longest
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import directed
from ..functions.fp32 import value_of, word_of
from ..functions.models import NODES, split_mix
from ..plans.storage import bounded, content_id, cut, load, save
from .graph import MOST_NODES

SMALL = 1 << 16  #: states whose graph is put together in memory
BUDGET = 4096  #: states that a task explores for one batch of the frontier
LOWEST, HIGHEST = -3.4028234663852886e38, 3.4028234663852886e38
SCREEN = 4  #: points of a region that are tried before its bounds
GOLDEN = 0.6180339887498949


Policy = str | Callable[[list[tuple[int, int, float]]], Any]


class Paused(Exception):
    """A search stopped after a stated number of waves; the folder has them."""


@dataclass
class Region:
    """A part of a domain: for features, the least and greatest value and whether it may be missing; for
    groups, the members that may be set.  What is not named is as the domain has it."""

    values: dict[int, tuple[float, float]] = field(default_factory=dict)
    missing: dict[int, bool] = field(default_factory=dict)
    members: dict[int, list[int]] = field(default_factory=dict)


@dataclass
class Domain:
    """Whether features may be missing, and groups of 0/1 features of which exactly one is 1."""

    missing: bool = True
    groups: list[list[int]] = field(default_factory=list)


class Ensemble:
    """Trees in memory: node arrays, cuts by feature, what each subtree reads and its extremes."""

    def __init__(self, rows: list, bias: list[float], features: int, domain: Domain, visits: int = 64, screen: bool = True, joint: bool = True, gaps: bool = True) -> None:
        self.visits = visits  #: nodes of a subtree looked at for its extremes inside a region
        self.screen = screen  #: whether points are tried before the extremes
        self.joint = joint  #: whether trees are looked at two at a time where one by one proves nothing
        self.gaps = gaps  #: whether the difference of two classes is bounded as one sum where that proves nothing
        trees: dict[int, dict[int, object]] = {}
        for r in rows:
            trees.setdefault(r["tree"], {})[r["node"]] = r
        self.bias, self.features, self.domain = np.array(bias, np.float32), features, domain
        self.trees = [trees[t] for t in sorted(trees)]
        self.channel = [t[0]["channel"] for t in self.trees]
        self.cuts: list[list[float]] = [[] for _ in range(features)]
        for t in self.trees:
            for r in t.values():
                if r["feature"] >= 0:
                    self.cuts[r["feature"]].append(float(np.float32(r["cut"])) + 0.0)
        self.cuts = [sorted(set(c)) for c in self.cuts]
        self.index = [{c: j for j, c in enumerate(cs)} for cs in self.cuts]
        self.group = {f: (g, m) for g, members in enumerate(domain.groups) for m, f in enumerate(members)}
        self.reads: list[dict[int, frozenset]] = []
        self.low: list[dict[int, np.float32]] = []
        self.high: list[dict[int, np.float32]] = []
        for t in self.trees:
            reads, low, high = {}, {}, {}
            for n in sorted(t, reverse=True):  # children come after their parents
                r = t[n]
                if r["feature"] < 0:
                    reads[n], low[n], high[n] = frozenset(), np.float32(r["value"]), np.float32(r["value"])
                else:
                    a, b = r["left"], r["right"]
                    reads[n] = reads[a] | reads[b] | {(r["feature"], self.cut_index(r))}
                    low[n], high[n] = min(low[a], low[b]), max(high[a], high[b])
            self.reads.append(reads)
            self.low.append(low)
            self.high.append(high)
        self.steps = [self.step_functions(t) for t in self.trees]

    def step_functions(self, tree: dict) -> dict[int, tuple[int, np.ndarray]]:
        """For each subtree that reads one feature outside groups: the feature, and the leaf of each bin, the missing value's last."""
        out: dict[int, tuple[int, np.ndarray]] = {}
        for n in sorted(tree, reverse=True):
            r = tree[n]
            f = r["feature"]
            if f < 0 or f in self.group:
                continue
            sides = []
            for child in (r["left"], r["right"]):
                if tree[child]["feature"] < 0:
                    sides.append(np.full(len(self.cuts[f]) + 2, float(np.float32(tree[child]["value"]))))
                elif child in out and out[child][0] == f:
                    sides.append(out[child][1])
            if len(sides) == 2:
                left = np.append(np.arange(len(self.cuts[f]) + 1) <= self.cut_index(r), bool(r["default_left"]))
                out[n] = f, np.where(left, *sides)
        return out

    def cut_index(self, r: object) -> int:
        return self.index[r["feature"]][float(np.float32(r["cut"])) + 0.0]

    def bins(self, f: int) -> tuple[int, int]:
        """The first and last bin of a feature that some finite value is in."""
        cuts = self.cuts[f]
        first = sum(c <= LOWEST for c in cuts)
        return first, len(cuts) - sum(c > HIGHEST for c in cuts)

    def start(self, region: Region | None = None) -> tuple:
        """The state of the whole domain or of a region, which must be a part of it and not empty."""
        part = region or Region()
        lo, hi = map(list, zip(*(self.bins(f) for f in range(self.features)), strict=True))
        miss = [part.missing.get(f, self.domain.missing) for f in range(self.features)]
        if any(miss) and not self.domain.missing:
            raise ValueError("the domain has no missing values")
        for f, (low, high) in part.values.items():
            if f in self.group or not np.isfinite([low, high]).all():
                raise ValueError(f"feature {f} has no range of values")
            own = [sum(c <= float(np.float32(v)) for c in self.cuts[f]) for v in (low, high)]
            lo[f], hi[f] = (max(lo[f], own[0]), min(hi[f], own[1])) if low <= high else (1, 0)
        if any(lo[f] > hi[f] and not miss[f] for f in range(self.features)):
            raise ValueError("the region is empty")
        groups = [(1 << len(g)) - 1 for g in self.domain.groups]
        for g, members in part.members.items():
            groups[g] = sum({1 << self.domain.groups[g].index(f) for f in members})
            if not groups[g]:
                raise ValueError("the region is empty")
        return [0] * len(self.trees), lo, hi, miss, groups, list(self.bias)

    def choices(self, state: tuple) -> list[list[float]]:
        """For each feature outside groups what a point of a state's region may have there: the ends of its values, both zeros, missing.

        The coordinates of groups follow, with the features that may be the one.
        """
        _, lo, hi, miss, groups, _ = state
        out: list[list[float]] = []
        for f in range(self.features):
            cuts, own = self.cuts[f], []
            if f not in self.group and lo[f] <= hi[f]:
                ends = cuts[lo[f] - 1] if lo[f] else LOWEST, float(np.nextafter(np.float32(cuts[hi[f]]), np.float32("-inf"))) if hi[f] < len(cuts) else HIGHEST
                own = [*dict.fromkeys(ends), *([-0.0, 0.0] if ends[0] <= 0 <= ends[1] else [])]
            out.append(own + [float("nan")] * bool(miss[f] and f not in self.group))
        return out + [[float(f) for k, f in enumerate(g) if groups[i] >> k & 1] for i, g in enumerate(self.domain.groups)]

    def witness(self, state: tuple, number: int = 0) -> list[float]:
        """A point of a state's region: of each coordinate's choices, the one that a multiple of an irrational step falls on."""
        drawn = [own[int(number * (i + 1) * GOLDEN % 1 * len(own))] if own else 0.0 for i, own in enumerate(self.choices(state))]
        ones = {int(f) for f in drawn[self.features :]}
        return [float(f in ones) if f in self.group else drawn[f] for f in range(self.features)]

    def class_at(self, state: tuple, point: list[float]) -> int:
        """The class of a point of a state's region, from the scores added so far and the open trees in order."""
        at, score = state[0], [np.float32(s) for s in state[5]]
        for t, tree in enumerate(self.trees):
            n = at[t]
            if n < 0:
                continue
            while (r := tree[n])["feature"] >= 0:
                x = point[r["feature"]]
                n = r["left"] if (r["default_left"] if x != x else np.float32(x) < np.float32(r["cut"])) else r["right"]
            score[self.channel[t]] = np.float32(score[self.channel[t]] + np.float32(r["value"]))
        return max(range(len(score)), key=lambda k: (score[k], -k))

    def seen_class(self, state: tuple) -> int | None:
        """The class of all of ``SCREEN`` points of the region; none if two differ, so that no one class can be proved."""
        first = self.class_at(state, self.witness(state))
        return first if all(self.class_at(state, self.witness(state, k)) == first for k in range(1, SCREEN)) else None

    def sides(self, r: object, lo: list[int], hi: list[int], miss: list[bool], groups: list[int]) -> tuple[bool, bool]:
        """Whether some point of the region goes left, and right, at a node."""
        f = r["feature"]
        if f in self.group:
            g, m = self.group[f]
            can_be_0, can_be_1 = bool(groups[g] & ~(1 << m)), bool(groups[g] >> m & 1)
            zero_left, one_left = r["cut"] > 0, r["cut"] > 1
            return (can_be_0 and zero_left) or (can_be_1 and one_left), (can_be_0 and not zero_left) or (can_be_1 and not one_left)
        j = self.cut_index(r)
        numbers = lo[f] <= hi[f]
        left = (numbers and lo[f] <= j) or (miss[f] and r["default_left"])
        return left, (numbers and hi[f] > j) or (miss[f] and not r["default_left"])

    def restrict(self, state: tuple, r: object, left: bool) -> tuple:
        at, lo, hi, miss, groups, score = ([*x] for x in state)
        f = r["feature"]
        if f in self.group:
            g, m = self.group[f]
            keep = sum(1 << k for k in range(len(self.domain.groups[g])) if groups[g] >> k & 1 and ((r["cut"] > (1 if k == m else 0)) == left))
            groups[g] = keep
        else:
            j = self.cut_index(r)
            if left:
                hi[f] = min(hi[f], j)
            else:
                lo[f] = max(lo[f], j + 1)
            miss[f] = miss[f] and bool(r["default_left"]) == left
            if lo[f] > hi[f]:
                lo[f], hi[f] = 1, 0
        return at, lo, hi, miss, groups, score

    def settle(self, state: tuple, widen: bool = True) -> tuple[bytes, int | None]:
        """The state in normal form as bytes, or the class of all its points.

        Intervals are widened to the next cuts that are still read, unless the state's own bins are to be kept.
        """
        at, lo, hi, miss, groups, score = state
        for t, tree in enumerate(self.trees):
            while at[t] >= 0 and tree[at[t]]["feature"] >= 0:
                left, right = self.sides(tree[at[t]], lo, hi, miss, groups)
                if left and right:
                    break
                at[t] = tree[at[t]]["left" if left else "right"]
        blocked: set[int] = set()
        for t, tree in enumerate(self.trees):
            c = self.channel[t]
            if at[t] < 0 or c in blocked:
                continue
            if tree[at[t]]["feature"] < 0:
                score[c] = np.float32(score[c] + np.float32(tree[at[t]]["value"]))
                at[t] = -1
            else:
                blocked.add(c)
        low, high = [np.float32(s) for s in score], [np.float32(s) for s in score]
        seen: set[tuple[int, int]] = set()
        seen_class = self.seen_class(state) if self.screen else None
        mixed = self.screen and seen_class is None
        for t in range(len(self.trees)):
            if at[t] >= 0:
                c = self.channel[t]
                if not mixed:
                    least, most = self.extremes(t, at[t], (lo, hi, miss, groups), [self.visits])
                    low[c], high[c] = np.float32(low[c] + least), np.float32(high[c] + most)
                seen |= self.reads[t][at[t]]
        for w in range(len(score)) if not mixed else ():
            if all(low[w] > high[r] or (low[w] == high[r] and w < r) for r in range(len(score)) if r != w):
                return b"", w
        if self.joint and not mixed:
            state = (at, lo, hi, miss, groups, score)
            for w in range(len(score)) if seen_class is None else [seen_class]:
                if self.leads(state, w):
                    return b"", w
        used: dict[int, list[int]] = {}
        for f, j in seen:
            used.setdefault(f, []).append(j)
        read_groups = {self.group[f][0] for f in used if f in self.group}
        for f in range(self.features):
            first, last = self.bins(f)
            if f not in used or f in self.group:
                lo[f], hi[f], miss[f] = first, last, self.domain.missing
            elif widen and lo[f] <= hi[f]:
                lo[f] = max([first, *(j + 1 for j in used[f] if j + 1 <= lo[f])])
                hi[f] = min([last, *(j for j in used[f] if j >= hi[f])])
        for g, members in enumerate(self.domain.groups):
            if g not in read_groups:
                groups[g] = (1 << len(members)) - 1
        return self.pack((at, lo, hi, miss, groups, score)), None

    def pack(self, state: tuple) -> bytes:
        at, lo, hi, miss, groups, score = state
        ints = np.array([*at, *lo, *hi], "<i4").tobytes() + np.array(groups, "<u8").tobytes()
        return ints + bytes(map(bool, miss)) + np.array(score, "<f4").tobytes()

    def unpack(self, data: bytes) -> tuple:
        t, f, g = len(self.trees), self.features, len(self.domain.groups)
        ints = np.frombuffer(data, "<i4", t + 2 * f).tolist()
        at = 4 * (t + 2 * f)
        groups = np.frombuffer(data, "<u8", g, at).tolist()
        at += 8 * g
        return ints[:t], ints[t : t + f], ints[t + f :], [bool(b) for b in data[at : at + f]], groups, list(np.frombuffer(data, "<f4", len(self.bias), at + f))

    def split(self, state: tuple, policy: Policy = "source") -> object:
        """The node whose test a state is split by.

        ``source`` takes the first open tree, ``widest`` the one with the widest range of values,
        ``common`` the test that most open trees share at their node.  A callable gets the open
        nodes as (tree, feature, cut) and proposes a position; what is none is passed over.
        """
        open_at = [(t, a) for t, a in enumerate(state[0]) if a >= 0 and self.trees[t][a]["feature"] >= 0]
        nodes = [self.trees[t][a] for t, a in open_at]
        if callable(policy):
            at = policy([(t, n["feature"], n["cut"]) for (t, _), n in zip(open_at, nodes, strict=True)])
            return nodes[at] if isinstance(at, int) and 0 <= at < len(nodes) else nodes[0]
        if policy == "widest":
            return nodes[int(np.argmax([self.high[t][a] - self.low[t][a] for t, a in open_at]))]
        if policy == "common":
            tests = [(n["feature"], n["cut"], n["default_left"]) for n in nodes]
            return nodes[max(range(len(nodes)), key=lambda i: (tests.count(tests[i]), -i))]
        return nodes[0]

    def extremes(self, t: int, node: int, region: tuple, visits: list[int]) -> tuple[np.float32, np.float32]:
        """Least and greatest leaf below a node that the region can reach; static once visits run out."""
        r = self.trees[t][node]
        visits[0] -= 1
        if r["feature"] < 0 or visits[0] < 0:
            return self.low[t][node], self.high[t][node]
        left, right = self.sides(r, *region)
        found = [self.extremes(t, r[side], region, visits) for side, can in (("left", left), ("right", right)) if can]
        return (min(f[0] for f in found), max(f[1] for f in found)) if found else (self.low[t][node], self.high[t][node])

    def parts(self, t: int, node: int, region: tuple, visits: list[int]) -> Iterator[tuple[np.float32, np.float32, tuple]]:
        """(least, greatest, region) of the leaves below a node that the region reaches; of whole subtrees once visits run out."""
        r = self.trees[t][node]
        visits[0] -= 1
        if r["feature"] < 0 or visits[0] < 0:
            yield self.low[t][node], self.high[t][node], region
            return
        left, right = self.sides(r, *region)
        for side, can in (("left", left), ("right", right)):
            if can:
                own = self.restrict(([], *region, []), r, side == "left")[1:5] if left and right else region
                yield from self.parts(t, r[side], own, visits)

    def reached(self, t: int, node: int, region: tuple) -> tuple[np.float32, np.float32]:
        """Least and greatest leaf below a node that some point of the region reaches, tests of one feature taken together."""
        found = [part[:2] for part in self.parts(t, node, region, [self.visits])]
        return min(f[0] for f in found), max(f[1] for f in found)

    def paired(self, t: int, u: int, at: list[int], region: tuple, low: np.float32, high: np.float32) -> tuple[np.float32, np.float32]:
        """Least and greatest ordered sum of two trees' leaves that one point can reach, on sums from ``low`` to ``high``.

        Rounding keeps order, so that the least sum before gives the least after.
        """
        found = []
        for least, most, own in self.parts(t, at[t], region, [self.visits]):
            a, b = self.reached(u, at[u], own)
            found.append((np.float32(np.float32(low + least) + a), np.float32(np.float32(high + most) + b)))
        return min(f[0] for f in found), max(f[1] for f in found)

    def before_last(self, state: tuple, c: int) -> tuple[np.float32, np.float32, int | None]:
        """Bounds of a channel's sum before its last open tree, trees taken two at a time, and that tree."""
        at, *region, score = state
        trees = [t for t in range(len(self.trees)) if at[t] >= 0 and self.channel[t] == c]
        low = high = np.float32(score[c])
        while len(trees) > 1:
            if len(trees) > 2:
                low, high = self.paired(trees[0], trees[1], at, tuple(region), low, high)
            else:
                least, most = self.reached(trees[0], at[trees[0]], tuple(region))
                low, high = np.float32(low + least), np.float32(high + most)
            trees = trees[2 if len(trees) > 2 else 1 :]
        return low, high, trees[0] if trees else None

    def leads(self, state: tuple, w: int) -> bool:
        """Whether class ``w`` wins on the whole region, by bounds of two trees at a time.

        Against each rival the last open trees of both classes are looked at together: no pair of their leaves
        that one point can reach may put the rival ahead.
        """
        return all(self.ahead(state, w, r) or (self.gaps and self.gap(state, w, r) > 0) for r in range(len(self.bias)) if r != w)

    def ahead(self, state: tuple, w: int, r: int) -> bool:
        at, *region, _ = state
        low, _, last = self.before_last(state, w)
        own = [(np.float32(low + least), part) for least, _, part in self.parts(last, at[last], tuple(region), [self.visits])] if last is not None else [(low, tuple(region))]
        _, high, rival = self.before_last(state, r)
        for least, part in own:
            most = high if rival is None else np.float32(high + self.reached(rival, at[rival], part)[1])
            if not (least > most or (least == most and w < r)):
                return False
        return True

    def rounding(self, state: tuple, c: int) -> float:
        """The most that rounding moves a channel's ordered sum: half a unit in the last place of each partial sum's bound."""
        at, *_, score = state
        size, moved = abs(float(score[c])), 0.0
        for t in range(len(self.trees)):
            if at[t] >= 0 and self.channel[t] == c:
                most = max(abs(float(self.low[t][at[t]])), abs(float(self.high[t][at[t]])))
                size = float(directed.add_up(directed.add_up(size, most), moved))
                moved = float(directed.add_up(moved, max(size * 2.0**-24, 2.0**-150)))
        return moved

    def gap(self, state: tuple, w: int, r: int) -> float:
        """A lower bound of the exact difference of two classes' scores over the region, less what rounding may move.

        Subtrees that read one feature are added up as step functions over that feature's bins, both classes
        together, and only the least bin that the region reaches counts.  The others are bounded two at a time, one
        of each class, over pairs of leaves that one point reaches; what is left, alone.
        """
        at, lo, hi, miss, groups, score = state
        region = lo, hi, miss, groups
        total = directed.sub_down(float(score[w]), float(score[r]))
        axes: dict[int, np.ndarray] = {}
        others: dict[int, list[int]] = {w: [], r: []}
        for t in range(len(self.trees)):
            c = self.channel[t]
            if at[t] < 0 or c not in others:
                continue
            if at[t] in self.steps[t]:
                f, values = self.steps[t][at[t]]
                own = values if c == w else -values
                axes[f] = directed.add_down(axes[f], own) if f in axes else own
            elif self.trees[t][at[t]]["feature"] < 0:
                value = float(np.float32(self.trees[t][at[t]]["value"]))
                total = directed.add_down(total, value if c == w else -value)
            else:
                others[c].append(t)
        for f, values in axes.items():
            total = directed.add_down(total, min([*values[lo[f] : hi[f] + 1], *values[-1:][: bool(miss[f])]]))
        for t, u in zip_longest(others[w], others[r]):
            if t is None:
                least = -float(self.reached(u, at[u], region)[1])
            elif u is None:
                least = float(self.reached(t, at[t], region)[0])
            else:
                least = min(float(directed.sub_down(float(low), float(self.reached(u, at[u], own)[1]))) for low, _, own in self.parts(t, at[t], region, [self.visits]))
            total = directed.add_down(total, least)
        return float(directed.sub_down(total, directed.add_up(self.rounding(state, w), self.rounding(state, r))))

    def children(self, state: tuple, policy: Policy = "source", widen: bool = True) -> tuple[object, tuple[bytes, int | None], tuple[bytes, int | None]]:
        r = self.split(state, policy)
        return r, self.settle(self.restrict(state, r, True), widen), self.settle(self.restrict(state, r, False), widen)


EXPANDED = "state binary, feature int, cut_bits int, default_left boolean, left binary, left_class int, right binary, right_class int"


def expand(front: DataFrame, ensemble: object, policy: Policy, budget: int = BUDGET) -> DataFrame:
    """A row (EXPANDED) for each state of the frontier and the states below it, up to the budget."""

    def draft(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ensemble = ensemble.value
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
        for batch in source:
            work = deque(batch.column("state").to_pylist())
            must, known, out = len(work), set(work), []
            while work and len(out) < max(must, budget):
                data = work.popleft()
                r, (a, x), (b, y) = own.children(own.unpack(data), policy)
                out.append((data, r["feature"], word_of(r["cut"]), r["default_left"], a, x, b, y))
                for child, label in ((a, x), (b, y)):
                    if label is None and child not in known:
                        known.add(child)
                        work.append(child)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in EXPANDED.split(", ")])

    return front.mapInArrow(draft, EXPANDED)


def compile_graph(
    trees: DataFrame, bias: list[float], features: int, domain: Domain | None = None, policy: Policy = "source", most_states: int = 1 << 20, budget: int = BUDGET, small: int = SMALL,
    region: Region | None = None, folder: str | None = None, most_waves: int | None = None, screen: bool = True, joint: bool = True, gaps: bool = True,
) -> tuple[DataFrame, int]:
    """(nodes, root) of the graph that gives every point of the domain, or of a region, the ensemble's class.

    A search of more than ``most_waves`` waves in this call raises ``Paused``.
    """
    spark = trees.sparkSession
    own = Ensemble([r.asDict() for r in bounded(trees, MOST_NODES, "ensemble")], bias, features, domain or Domain(), screen=screen, joint=joint, gaps=gaps)
    first, label = own.settle(own.start(region))
    if label is not None:
        return spark.createDataFrame([(0, -1, None, None, None, -1, -1, label)], NODES), 0
    shared = spark.sparkContext.broadcast(own)
    waves = Waves(spark, folder, own, region, policy) if folder else None
    done = waves.restore(first) if waves else []
    states = union_of(spark, done)
    while True:
        front = cut(spark.createDataFrame([(first,)], "state binary").coalesce(1) if not done else open_children(states).join(states.select("state"), "state", "left_anti"), "front")
        if done and front.isEmpty():
            break
        if most_waves is not None and most_waves <= 0:
            raise Paused(f"{len(done)} waves are kept")
        most_waves = most_waves if most_waves is None else most_waves - 1
        # a task may explore what an earlier wave or another task has
        wave = expand(front, shared, policy, budget).dropDuplicates(["state"]).join(states.select("state"), "state", "left_anti")
        done.append(waves.keep(wave, len(done)) if waves else cut(wave, "wave"))
        states = union_of(spark, done)
        total = states.count()
        if total > most_states:
            raise ValueError(f"the search has more than {most_states} states; no graph is returned")
    if states.count() <= small:
        return assemble_small(spark, states.collect(), first)
    return assemble(spark, states, first)


def union_of(spark: SparkSession, waves: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, waves) if waves else spark.createDataFrame([], EXPANDED)


def open_children(states: DataFrame) -> DataFrame:
    """(state): the different open states below ``states``."""
    sides = F.array(F.when(F.col("left_class").isNull(), F.col("left")), F.when(F.col("right_class").isNull(), F.col("right")))
    return states.select(F.explode(sides).alias("state")).where("state IS NOT NULL").distinct()


class Waves:
    """The waves of a search in a folder: a table each, and a manifest that is written after it."""

    def __init__(self, spark: SparkSession, folder: str, own: Ensemble, region: Region | None, policy: Policy) -> None:
        if callable(policy):
            raise ValueError("a search by a callable cannot be resumed")
        self.spark, self.folder = spark, folder.rstrip("/")
        nodes = [[sorted((k, str(v)) for k, v in r.items()) for _, r in sorted(t.items())] for t in own.trees]
        facts = repr((nodes, [float(b).hex() for b in own.bias], own.features, own.domain, region, own.visits, own.screen, own.joint, own.gaps))
        self.plan = {"search": hashlib.sha256(facts.encode()).hexdigest(), "policy": policy}

    def keep(self, wave: DataFrame, number: int) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        wave.write.parquet(path)
        kept = self.spark.read.schema(EXPANDED).parquet(path)
        save(self.spark.createDataFrame([(path, kept.count(), content_id(kept))], "path string, states long, content string"), f"{self.folder}/wave-{number}", self.plan)
        return kept

    def restore(self, first: bytes) -> list[DataFrame]:
        """The whole waves of the folder; one that is not a search's that starts at ``first`` is an error."""
        out: list[DataFrame] = []
        while True:
            try:
                row = load(self.spark, f"{self.folder}/wave-{len(out)}", self.plan)[0].first()
            except AnalysisException:
                break
            wave = self.spark.read.schema(EXPANDED).parquet(row["path"])
            if content_id(wave) != row["content"]:
                raise ValueError(f"wave {len(out)} is not as it was written")
            out.append(wave)
        if out:
            self.check(out, first)
        return out

    def check(self, waves: list[DataFrame], first: bytes) -> None:
        """Every state once, each but the first below another, and leaves with classes alone."""
        states = union_of(self.spark, waves)
        counts = states.agg(F.count("*").alias("n"), F.count_distinct("state").alias("k"), F.count_if(F.col("state") == F.lit(first)).alias("first"), F.count_if((F.length("left") == 0) != F.col("left_class").isNotNull()).alias("odd")).first()
        above = states.where(F.col("state") != F.lit(first)).select("state").join(open_children(states), "state", "left_anti")
        if counts["n"] != counts["k"] or counts["first"] != 1 or counts["odd"] or not above.isEmpty():
            raise ValueError("the kept waves are not those of one search")


def witnesses(trees: DataFrame, bias: list[float], features: int, states: DataFrame, domain: Domain | None = None, points: int = 5) -> DataFrame:
    """(state, number, x, class): points of the regions of ``states`` (state), and the class that a state's scores and open trees give each."""
    own = Ensemble([r.asDict() for r in bounded(trees, MOST_NODES, "ensemble")], bias, features, domain or Domain())
    shared = states.sparkSession.sparkContext.broadcast(own)

    def drawn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ensemble = shared.value
        for batch in source:
            out = []
            for data in batch.column("state").to_pylist():
                state = own.unpack(data)
                for number in range(points):
                    x = own.witness(state, number)
                    out.append((data, number, x, own.class_at(state, x)))
            if out:
                kinds = [pa.binary(), pa.int32(), pa.list_(pa.float32()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["state", "number", "x", "class"])

    return states.select("state").mapInArrow(drawn, "state binary, number int, x array<float>, class int")


def explored(trees: DataFrame, bias: list[float], features: int, domain: Domain | None = None, budget: int = BUDGET) -> DataFrame:
    """EXPANDED rows of a first wave from the whole domain."""
    spark = trees.sparkSession
    own = Ensemble([r.asDict() for r in bounded(trees, MOST_NODES, "ensemble")], bias, features, domain or Domain())
    first, label = own.settle(own.start())
    front = spark.createDataFrame([(first,)] if label is None else [], "state binary").coalesce(1)
    return cut(expand(front, spark.sparkContext.broadcast(own), "source", budget), "wave")


def branch_hash(feature: int, word: int, default_left: bool, a: str, b: str) -> str:
    return hashlib.sha256(f"branch:{feature}:{word}:{str(default_left).lower()}:{a}:{b}".encode()).hexdigest()


def assemble_small(spark: SparkSession, rows: list, first: bytes) -> tuple[DataFrame, int]:
    """What ``assemble`` does, over a bounded number of states in memory."""
    states = {bytes(r["state"]): r for r in rows}
    nodes: dict[str, dict] = {}
    known: dict[bytes, str] = {}

    def done(data: bytes, label: int | None) -> str | None:
        if label is None:
            return known.get(bytes(data))
        name = hashlib.sha256(f"leaf:{label}".encode()).hexdigest()
        nodes.setdefault(name, {"height": 0, "class": label, "a": None, "b": None})
        return name

    work = [first]
    while work:
        r = states[work[-1]]
        a, b = done(r["left"], r["left_class"]), done(r["right"], r["right_class"])
        if a is None or b is None:
            work += [bytes(r[side]) for side, ready in (("left", a), ("right", b)) if ready is None]
            continue
        name = a
        if a != b:
            name = branch_hash(r["feature"], r["cut_bits"], r["default_left"], a, b)
            nodes.setdefault(name, {"height": 1 + max(nodes[a]["height"], nodes[b]["height"]), "class": None, "feature": r["feature"], "cut_bits": r["cut_bits"], "default_left": r["default_left"], "a": a, "b": b})
        known[work.pop()] = name
    return number_nodes(spark, nodes, known[first])


def number_nodes(spark: SparkSession, by_id: dict[str, dict], top: str) -> tuple[DataFrame, int]:
    """What is reachable from ``top``, children before parents."""
    live, work = {top}, [top]
    while work:
        r = by_id[work.pop()]
        fresh = {c for c in (r["a"], r["b"]) if c is not None} - live
        live |= fresh
        work += fresh
    order = {i: k for k, i in enumerate(sorted(live, key=lambda i: (by_id[i]["height"], by_id[i]["class"] if by_id[i]["class"] is not None else -1, i)))}
    out = []
    for i, k in order.items():
        r = by_id[i]
        if r["a"] is None:
            out.append((k, -1, None, None, None, -1, -1, r["class"]))
        else:
            out.append((k, r["feature"], value_of(r["cut_bits"]), r["cut_bits"], r["default_left"], order[r["a"]], order[r["b"]], None))
    return spark.createDataFrame(out, NODES), order[top]


def leaf_hash(label: F.Column) -> F.Column:
    return F.sha2(F.concat(F.lit("leaf:"), label.cast("string")), 256)


def assemble(spark: SparkSession, states: DataFrame, first: bytes) -> tuple[DataFrame, int]:
    """Structural hashes from the leaves up, then the nodes of the graph in order of height."""
    labels = states.select(F.explode(F.array("left_class", "right_class")).alias("class")).where("class IS NOT NULL").distinct()
    none = "CAST(NULL AS INT) AS feature", "CAST(NULL AS INT) AS cut_bits", "CAST(NULL AS BOOLEAN) AS default_left", "CAST(NULL AS STRING) AS a", "CAST(NULL AS STRING) AS b"
    nodes = cut(labels.select(leaf_hash(F.col("class")).alias("id"), F.lit(0).alias("height"), "class").selectExpr("id", "height", "class", *none), "nodes")
    known = spark.createDataFrame([], "state binary, id string, height int")
    pending = states
    while True:
        left = known.select(F.col("state").alias("left"), F.col("id").alias("a1"), F.col("height").alias("h1"))
        right = known.select(F.col("state").alias("right"), F.col("id").alias("b1"), F.col("height").alias("h2"))
        a = F.when(F.col("left_class").isNotNull(), leaf_hash(F.col("left_class"))).otherwise(F.col("a1"))
        b = F.when(F.col("right_class").isNotNull(), leaf_hash(F.col("right_class"))).otherwise(F.col("b1"))
        tried = pending.join(left, "left", "left").join(right, "right", "left").withColumn("a", a).withColumn("b", b)
        ready = tried.where("a IS NOT NULL AND b IS NOT NULL")
        made = F.sha2(F.concat_ws(":", F.lit("branch"), "feature", "cut_bits", F.col("default_left").cast("string"), "a", "b"), 256)
        ready = ready.withColumn("id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(made)).withColumn("height", F.greatest(F.coalesce("h1", F.lit(0)), F.coalesce("h2", F.lit(0))) + F.when(F.col("a") == F.col("b"), 0).otherwise(1))
        ready = cut(ready.select("state", "id", "height", "feature", "cut_bits", "default_left", "a", "b"), "ready")
        if ready.isEmpty():
            raise ValueError("the search is incomplete")
        new = ready.where("a <> b").select("id", "height", F.lit(None).cast("int").alias("class"), "feature", "cut_bits", "default_left", "a", "b")
        nodes = cut(nodes.unionByName(new).dropDuplicates(["id"]), "nodes")
        known = cut(known.unionByName(ready.select("state", "id", "height")), "known")
        pending = cut(pending.join(ready.select("state"), "state", "left_anti"), "pending")
        if pending.isEmpty():
            break
    top = known.where(F.col("state") == F.lit(first)).first()["id"]
    return number_nodes(spark, {r["id"]: r.asDict() for r in bounded(nodes, MOST_NODES, "graph")}, top)


def estimate_states(trees: DataFrame, bias: list[float], features: int, paths: int, domain: Domain | None = None, seed: int = 1, policy: Policy = "source") -> DataFrame:
    """(path, depth, weight): random walks from the start; the mean weight estimates the tree's leaves.

    Each step takes either child with probability one half, so a walk of d steps has weight 2^d.
    """
    spark = trees.sparkSession
    shared = spark.sparkContext.broadcast(Ensemble([r.asDict() for r in bounded(trees, MOST_NODES, "ensemble")], bias, features, domain or Domain()))

    def walk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ensemble = shared.value
        for batch in source:
            out = []
            for path in batch.column("id").to_pylist():
                state, depth = split_mix(seed * 1_000_003 + path)[0], 0
                data, label = own.settle(own.start())
                while label is None:
                    state, r = split_mix(state)
                    _, left, right = own.children(own.unpack(data), policy)
                    data, label = left if r & 1 else right
                    depth += 1
                out.append((path, depth, float(2**depth)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["path", "depth", "weight"])

    return spark.range(paths).mapInArrow(walk, "path long, depth long, weight double")


LIMB = 32  #: bits of a part of a count of cells; sums of up to 2^31 such parts fit in 64 bits


def coverage(trees: DataFrame, bias: list[float], features: int, domain: Domain | None = None, policy: Policy = "source", most_waves: int | None = None, budget: int = BUDGET) -> DataFrame:
    """(wave, class, cells, share): exactly how many cells of the domain's grid each wave of a search settles for each class.

    All cells start at the first state.  A wave hands the cells of every open state on to its two children, in proportion
    to the bins of the tested feature, and adds up what a state gets from several parents; cells that reach a class
    are settled.  A task goes on below its states for up to ``budget`` steps.  A row with class null has the cells that are still open after ``most_waves``; without that number the search
    runs to its end.  ``cells`` is the count in decimal digits, exact at every size: counts travel as parts of 32 bits.
    States keep the bins they were reached by, as far as they are still read, so there are more of them than in a
    compilation; one that is reached at several depths is stepped once for each.  Cells of a domain with exactly-one
    groups are no grid and are refused.
    """
    spark = trees.sparkSession
    own = Ensemble([r.asDict() for r in bounded(trees, MOST_NODES, "ensemble")], bias, features, domain or Domain())
    if own.domain.groups:
        raise ValueError("the cells of a domain with groups are not counted")
    total = 1
    for f in range(features):
        first, last = own.bins(f)
        total *= last - first + 1 + own.domain.missing
    limbs = total.bit_length() // LIMB + 1
    names = [f"m{i}" for i in range(limbs)]
    mask = (1 << LIMB) - 1
    split_up = lambda n: [n >> LIMB * i & mask for i in range(limbs)]
    schema = "state binary, class int, " + ", ".join(f"{m} long" for m in names)
    out: list[tuple[int, int | None, int]] = []

    def settle(rows: DataFrame, wave: int) -> None:
        sums = rows.groupBy("class").agg(*(F.sum(m).alias(m) for m in names))
        out.extend((wave, r["class"], sum(r[m] << LIMB * i for i, m in enumerate(names))) for r in bounded(sums, MOST_NODES, "classes"))

    start, label = own.settle(own.start(), False)
    shared = spark.sparkContext.broadcast(own)

    def hand_on(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ensemble = shared.value
        for batch in source:
            work: dict[bytes, int] = {}
            settled: dict[int, int] = {}
            for data, *parts in zip(*(batch.column(c).to_pylist() for c in ("state", *names)), strict=True):
                work[data] = sum(p << LIMB * i for i, p in enumerate(parts))
            for _ in range(max(len(work), budget)):
                if not work:
                    break
                data = next(iter(work))
                cells = work.pop(data)
                state = own.unpack(data)
                r, *kids = own.children(state, policy, False)
                _, lo, hi, miss, *_ = state
                f = r["feature"]
                numbers = max(0, hi[f] - lo[f] + 1)
                left = max(0, min(hi[f], own.cut_index(r)) - lo[f] + 1) + (miss[f] and r["default_left"])
                one, rest = divmod(cells, numbers + miss[f])
                if rest:
                    raise ValueError("a state's cells are not whole slices of its tested feature")
                for (child, done), n in zip(kids, (one * left, one * (numbers + miss[f] - left)), strict=True):
                    to, key = (work, child) if done is None else (settled, done)
                    to[key] = to.get(key, 0) + n
            rows = [(data, None, *split_up(n)) for data, n in work.items()] + [(None, k, *split_up(n)) for k, n in settled.items()]
            if rows:
                kinds = [pa.binary(), pa.int32(), *(pa.int64() for _ in names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["state", "class", *names])

    at = spark.createDataFrame([(start if label is None else None, label, *split_up(total))], schema)
    wave = 0
    while True:
        settle(at.where("class IS NOT NULL"), wave)
        front = at.where("class IS NULL").groupBy("state").agg(*(F.sum(m).alias(m) for m in names))
        if most_waves is not None and wave >= most_waves:
            settle(front.withColumn("class", F.lit(None).cast("int")), wave)
            break
        at = cut(front.mapInArrow(hand_on, schema), "cells")
        if at.isEmpty():
            break
        wave += 1
    rows = [(w, k, str(n), float(Fraction(n, total))) for w, k, n in out]
    return spark.createDataFrame(rows, "wave int, class int, cells string, share double")


def eta(progress: DataFrame, remaining: float, window: int = 4) -> DataFrame:
    """One row: mean rate of the last steps of ``progress`` (step, work, seconds), its error, and the seconds left.

    ``status`` says why there is no estimate: too few steps, or no progress in them.
    """
    last = progress.orderBy(F.desc("step")).limit(window)
    rate = F.col("work") / F.col("seconds")
    facts = last.agg(F.count("*").alias("steps"), F.avg(rate).alias("rate"), (F.stddev_samp(rate) / F.sqrt(F.count("*"))).alias("error"))
    status = F.when(F.col("steps") < 2, "too few steps").when(F.col("rate") <= 0, "no progress").otherwise("estimated")
    ok = status == "estimated"
    return facts.select("steps", "rate", "error", status.alias("status"), F.when(ok, remaining / F.col("rate")).alias("seconds"), F.when(ok, remaining / (F.col("rate") + 2 * F.col("error"))).alias("least"), F.when(ok & (F.col("rate") > 2 * F.col("error")), remaining / (F.col("rate") - 2 * F.col("error"))).alias("most"))


def work_summary(walks: DataFrame) -> DataFrame:
    """One row: mean and standard error of the walks' weights, extremes, and the largest share."""
    w = F.col("weight")
    return walks.agg(F.count("*").alias("paths"), F.avg(w).alias("mean"), (F.stddev_samp(w) / F.sqrt(F.count("*"))).alias("standard_error"), F.min(w).alias("least"), F.max(w).alias("most"), (F.max(w) / F.sum(w)).alias("largest_share"))



"""Secret scans: fixed rules, and a character convolutional network over every other candidate.

Candidates are what the rules' spans leave of runs of LEAST_VALUE or more of CANDIDATE's characters, and, within
such a piece, the parts between its / and =.  Windows of characters that slide over each (any STEP characters in a row
are whole in one) are scored by a small network in numpy, and the highest score counts: character features, one
convolution, a maximum over the inside and one over the whole window, a logistic unit.  A piece that passes is a span;
of a piece that does not, the parts that pass are.  The convolution is trained on findings made by rule, with look-alikes
that are none (`secret_examples`).  The logistic unit is fitted on these and on every window of the table, those of values
that the rules confirm against those of all other pieces, by ROUNDS steps down a quadratic bound of the logistic loss: a step
is one pass whose tasks add up gradient and curvature.  Confirmed values are shown with and without what stands before them, half a weight each, so that
the shape of a value counts by itself.  The threshold is the highest whose recall is at least RECALL by the lower end of its
Wilson interval, of the made findings held out and of these together with all distinct confirmed values, each scored without
what stands before it by a unit fitted on the other half of the windows.  The rules' own spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .common import col
from .secret_examples import examples

# The rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE, CUTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-", "/="
BEFORE, INSIDE, BEHIND, STEP = 32, 48, 16, 24
WIDTH = BEFORE + INSIDE + BEHIND
RECALL = 0.98
FOLDS, ROUNDS, RIDGE = 2, 2, 0.0025
SUMS_SCHEMA = "head int, confirmed boolean, sums array<double>, inputs array<double>, hash long"
BIN, LEAST_BIN, BINS = 256, -8192, 16385  # logits are counted in steps of 1 / BIN from -32 to 32
FILTERS, REACH, EPOCHS, BATCH, RATE = 16, 5, 12, 128, 0.01

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.ASCII), re.compile(ACCESS), re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
# Cheap tests of whole texts; a text without a hit has no span of the kind.
HINTS = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]", "hex": rf"[0-9a-f]{{{LEAST_HEX}}}"}


def base_spans(text: str, kinds: set[str] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' spans, by start and kind."""
    spans = []
    if kinds is None or "assign" in kinds:
        spans += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if kinds is None or "access" in kinds:
        spans += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if kinds is None or "hex" in kinds:
        spans += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def window(text: str, start: int, stop: int) -> str:
    """Fixed-width view of at most INSIDE characters: what stands before, they themselves, what stands behind."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    return before + text[start:stop].ljust(INSIDE, "\0") + text[stop : stop + BEHIND].ljust(BEHIND, "\0")


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, far enough apart that no window sees two of them, and where each begins."""
    gap = "\0" * BEFORE
    points = np.frombuffer((gap + gap.join(texts) + gap + "\0" * INSIDE).encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.array([len(t) + BEFORE for t in texts], dtype=np.int64)
    return np.minimum(points, 255).astype(np.uint8), BEFORE + np.cumsum(sizes) - sizes


def stretches(free: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of free places begin and end, without dots at the end; those of LEAST_VALUE or more."""
    edges = np.flatnonzero(np.diff(free.view(np.int8), prepend=0, append=0))
    solid = np.maximum.accumulate(np.where(codes != ord("."), np.arange(len(codes), dtype=np.int32), np.int32(-1)))
    start, stop = edges[::2], solid[edges[1::2] - 1] + 1
    long = stop - start >= LEAST_VALUE
    return start[long], stop[long].astype(np.int64)


def candidates(codes: np.ndarray, covered: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces outside the covered spans, then those of the parts, and each part's piece."""
    free = _IN_RUN[codes]
    for start, stop in covered:
        free[start:stop] = False
    start, stop = stretches(free, codes)
    part_start, part_stop = stretches(free & ~_IS_CUT[codes], codes)
    piece = np.searchsorted(start, part_start, side="right") - 1
    inner = (part_start != start[piece]) | (part_stop != stop[piece]) if len(piece) else np.zeros(0, dtype=bool)
    return start, stop, part_start[inner], part_stop[inner], piece[inner]


def slides(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that slide over each candidate, one a row, and the first of each candidate."""
    size = stop - start
    number = 1 + np.maximum(0, -((INSIDE - size) // STEP))
    first = np.cumsum(number) - number
    which = np.arange(int(number.sum())) - np.repeat(first, number)
    at = np.repeat(start, number) + np.minimum(which * STEP, np.repeat(np.maximum(0, size - INSIDE), number))
    inside = np.minimum(np.repeat(size, number), INSIDE)
    out = np.empty((len(at), WIDTH), dtype=np.uint8)
    out[:, :BEFORE] = codes[at[:, None] + np.arange(-BEFORE, 0)]
    places = np.arange(INSIDE)
    out[:, BEFORE : BEFORE + INSIDE] = codes[at[:, None] + places] * (places < inside[:, None])
    out[:, BEFORE + INSIDE :] = codes[(at + inside)[:, None] + np.arange(BEHIND)]
    return out, first


def hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of windows by what they hold from the value on."""
    words = np.ascontiguousarray(windows[:, BEFORE:]).view(np.uint64)
    odd = np.random.default_rng(11).integers(0, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((words ^ (words >> np.uint64(29))) * odd).sum(axis=1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _table() -> np.ndarray:
    """Features of the first 256 code points (255 stands for all others)."""
    names = np.zeros((256, 12), dtype=np.float32)
    for c in range(256):
        ch = chr(c)
        groups = (
            c == 0, "a" <= ch <= "f", "g" <= ch <= "z", "A" <= ch <= "Z", "0" <= ch <= "9", ch == " ", ch == "\n",
            ch in "\"'", ch in ":=", ch in "+/_.-", 32 < c < 127 and not ch.isalnum(), c > 126,
        )
        names[c] = groups
    codes = np.random.default_rng(7).choice([-0.5, 0.5], size=(256, 8)).astype(np.float32)
    codes[0] = 0
    return np.concatenate([names, codes], axis=1)


_FEATURES = _table()
_IN_RUN, _IS_CUT = (np.isin(np.arange(256), [ord(c) for c in chars]) for chars in (CANDIDATE, CUTS))
_MASK = np.zeros((WIDTH, 1), dtype=np.float32)
_MASK[BEFORE : BEFORE + INSIDE] = 1
_INNER = slice(BEFORE, BEFORE + INSIDE - REACH + 1)


def inputs(windows: list[str]) -> np.ndarray:
    """(windows, places, REACH * features), ready for the convolution."""
    points = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(len(windows), WIDTH)
    x = _FEATURES[np.minimum(points, 255)]
    x = np.concatenate([x, np.broadcast_to(_MASK, (len(windows), WIDTH, 1))], axis=2)
    places = WIDTH - REACH + 1
    return np.concatenate([x[:, k : k + places] for k in range(REACH)], axis=2)


@dataclass
class Network:
    """Weights, calibration and threshold."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    intercept: float = 0.0
    threshold: float = 1.1
    calibrated: bool = False
    recall: float = 0.0
    false_rate: float = 0.0
    confirmed: int = 0  # windows of the table that it was fitted on
    others: int = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.kernel + self.bias, 0)
        inner = h[:, _INNER].argmax(axis=1) + BEFORE
        outer = h.argmax(axis=1)
        at = np.concatenate([inner, outer], axis=1)
        pooled = np.take_along_axis(np.concatenate([h, h], axis=2), at[:, None, :], axis=1)[:, 0]
        return pooled @ self.out + self.shift, pooled, at

    def scores(self, windows: list[str]) -> np.ndarray:
        """Calibrated probabilities."""
        parts = [self.forward(inputs(windows[i : i + 512]))[0] for i in range(0, len(windows), 512)]
        logits = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * logits + self.intercept)))

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the first two, the next two and the last character under the kernel add, and what a place adds."""
        kernel = self.kernel.reshape(REACH, -1, FILTERS)
        one = (_FEATURES @ kernel[:, :-1]).astype(np.float32)
        two = [(one[k][:, None] + one[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)]
        places = WIDTH - REACH + 1
        return *two, one[4], (self.bias + sum(_MASK[k : k + places] * kernel[k, -1] for k in range(REACH))).astype(np.float32)[:, None]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """What the logistic unit sees of windows given as codes."""
        first, second, last, fixed = self.tables
        out = np.empty((len(windows), 2 * FILTERS), dtype=np.float32)
        room = np.empty((2, WIDTH - REACH + 1, 64, FILTERS), dtype=np.float32)
        for i in range(0, len(windows), 64):
            codes = windows[i : i + 64].T.astype(np.intp)
            pairs = codes[:-1] * 256 + codes[1:]
            h, more = room if codes.shape[1] == 64 else np.empty((2, room.shape[1], codes.shape[1], FILTERS), dtype=np.float32)
            first.take(pairs[:-3], axis=0, out=h, mode="clip")
            h += second.take(pairs[2:-1], axis=0, out=more, mode="clip")
            h += last.take(codes[4:], axis=0, out=more, mode="clip")
            h += fixed
            inner = np.maximum(h[_INNER].max(axis=0), 0)
            outer = np.maximum(h[: _INNER.start].max(axis=0), h[_INNER.stop :].max(axis=0))
            out[i : i + 64] = np.concatenate([inner, np.maximum(inner, outer)], axis=1)
        return out

    def of_codes(self, windows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of windows given as codes; what characters add at each reach is looked up."""
        logits = self.pooled(windows) @ self.out + self.shift
        return 1 / (1 + np.exp(-(self.slope * logits + self.intercept)))


def train(windows: list[str], labels: np.ndarray, seed: int = 0) -> Network:
    """Adam on the logistic loss, classes weighted equally."""
    rng = np.random.default_rng(seed)
    depth = REACH * (_FEATURES.shape[1] + 1)
    net = Network(rng.normal(0, (2 / depth) ** 0.5, (depth, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)
    weights = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum())) * len(labels)
    moments = [np.zeros_like(p) for p in (net.kernel, net.bias, net.out, np.zeros(1))]
    squares = [m.copy() for m in moments]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            x = inputs([windows[i] for i in part])
            logits, pooled, at = net.forward(x)
            error = (1 / (1 + np.exp(-logits)) - labels[part]) * weights[part] / len(part)
            back = np.outer(error, net.out) * (pooled > 0)
            kernel, bias = np.zeros_like(net.kernel), np.zeros_like(net.bias)
            for f in range(2 * FILTERS):
                rows = x[np.arange(len(part)), at[:, f]]
                kernel[:, f % FILTERS] += back[:, f] @ rows
                bias[f % FILTERS] += back[:, f].sum()
            step += 1
            values = [net.kernel, net.bias, net.out, np.array([net.shift])]
            for i, slope in enumerate((kernel, bias, pooled.T @ error, np.array([error.sum()]))):
                moments[i] = 0.9 * moments[i] + 0.1 * slope
                squares[i] = 0.999 * squares[i] + 0.001 * slope**2
                values[i] = values[i] - RATE * (moments[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
            net.kernel, net.bias, net.out, net.shift = *values[:3], float(values[3][0])
    return net


def platt(logits: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt scaling by Newton steps; `yes` true ones and `no` others have each logit."""
    n = yes + no
    target = (yes * ((yes.sum() + 1) / (yes.sum() + 2)) + no / (no.sum() + 2)) / np.maximum(n, 1)
    design = np.stack([logits, np.ones_like(logits)], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        line = line - np.clip(np.linalg.solve(hessian, design.T @ (n * (p - target)) + 1e-3 * (line - [1, 0])), -1, 1)
    return float(line[0]), float(line[1])


def calibrate(net: Network, windows: list[str], labels: np.ndarray) -> None:
    """Platt scaling, then the highest threshold that keeps RECALL of the true ones."""
    logits = np.concatenate([net.forward(inputs(windows[i : i + 512]))[0] for i in range(0, len(windows), 512)])
    slope, intercept = platt(logits, labels.astype(float), (~labels).astype(float))
    net.calibrated = slope > 0
    if net.calibrated:
        net.slope, net.intercept = slope, intercept
    # Without calibration the scores are the network's own; the threshold keeps RECALL of the true ones all the same.
    net.threshold = keeps_recall(net.scores([w for w, y in zip(windows, labels, strict=True) if y]))


def wilson(hits: int, n: int, z: float = 1.645) -> float:
    """The lower end of the Wilson interval of a share (one-sided, 95 percent)."""
    share = hits / n
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def keeps_recall(true: np.ndarray) -> float:
    """The highest threshold whose recall of these scores is surely RECALL; the least score where they are too few."""
    return float(np.sort(true)[may_lose(len(true))])


def may_lose(n: int) -> int:
    """How many of n true ones can go so that the recall is still surely RECALL."""
    lost = 0
    while lost + 1 < n and wilson(n - lost - 1, n) >= RECALL:
        lost += 1
    return lost


def measure(net: Network, true: np.ndarray, false: np.ndarray) -> None:
    """Recall and false-positive rate on held-out scores, each half under the threshold that the other half gives."""
    halves = [(true[k::2], false[k::2], keeps_recall(true[1 - k :: 2])) for k in range(2)]
    net.recall = sum(int((t >= least).sum()) for t, _, least in halves) / len(true)
    net.false_rate = sum(int((f >= least).sum()) for _, f, least in halves) / len(false)


def coded(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.minimum(points, 255).astype(np.uint8).reshape(len(windows), WIDTH)


def without_context(w: str) -> str:
    return "\0" * BEFORE + w[BEFORE:]


def bundled() -> list[tuple[str, bool]]:
    """Windows of the findings made by rule; a long value is seen through the window that slides to its end as well."""
    rows = []
    for text, start, stop, secret in examples():
        rows.append((window(text, start, min(stop, start + INSIDE)), secret))
        if stop - start > INSIDE and secret:
            rows.append((window(text, stop - INSIDE, stop), secret))
    return rows


def made_findings() -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """Labelled windows of the findings made by rule: two thirds to learn from, one held out."""
    learn: list[tuple[str, bool]] = []
    held: list[tuple[str, bool]] = []
    for y in (True, False):
        part = [w for w, label in bundled() if label == y]
        learn += [(w, y) for i, w in enumerate(part) if i % 3]
        held += [(w, y) for w in part[::3]]
    return learn, held


def fit(rows: list[tuple[str, bool]]) -> Network:
    """A network from the findings made by rule and labelled windows; a third of either is held out."""
    learn, held = made_findings()
    for y in (True, False):
        part = [w for w, label in rows if label == y]
        learn += [(without_context(w) if y and i % 2 else w, y) for i, w in enumerate(part) if i % 3]
        held += [(without_context(w) if y else w, y) for w in part[::3]]
    net = train([w for w, _ in learn], np.array([y for _, y in learn]))
    calibrate(net, [w for w, _ in held], np.array([y for _, y in held]))
    # As the scan computes scores, to the last bit.
    true = net.of_codes(coded([w for w, y in held if y]))
    net.threshold = keeps_recall(true)
    measure(net, true, net.of_codes(coded([w for w, y in held if not y])))
    return net


class Batch:
    """Texts of one Arrow batch: their rules' spans, and the candidates that these leave."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("text").cast(pa.large_string()).fill_null("")
        texts = column.to_pylist()
        hits = {k: pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False) for k, p in HINTS.items()}
        self.bases: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        self.codes, self.begin = laid_out(texts)
        covered, values = [], []
        for i in np.flatnonzero(np.logical_or.reduce(list(hits.values()))).tolist():
            self.bases[i] = base_spans(texts[i], {k for k in HINTS if hits[k][i]})
            at = int(self.begin[i])
            for kind, start, stop in self.bases[i]:
                covered.append((at + start, at + stop))
                values.append((at + (_ASSIGN.match(texts[i], start).start(2) if kind == 0 else start), at + stop))
        self.values = np.array(values, dtype=np.int64).reshape(-1, 2)
        self.start, self.stop, self.part_start, self.part_stop, self.piece = candidates(self.codes, covered)

    def labelled(self) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
        """Hashes, whether the rules confirm them, and the windows of all values and pieces."""
        for confirmed, start, stop in ((True, self.values[:, 0], self.values[:, 1]), (False, self.start, self.stop)):
            windows = slides(self.codes, start, stop)[0]
            yield hashes(windows), confirmed, windows

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The text that each place is in."""
        return np.searchsorted(self.begin, at, side="right") - 1

    def added(self, net: Network) -> list[list[tuple[int, int, int]]]:
        """Spans of each text that the network finds; the pieces' scores are kept in `best`."""

        def scored(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            windows, first = slides(self.codes, start, stop)
            return np.maximum.reduceat(net.of_codes(windows), first) if len(first) else np.zeros(0)

        self.best = scored(self.start, self.stop)
        whole = self.best >= net.threshold
        parts = ~whole[self.piece]
        start, stop = self.part_start[parts], self.part_stop[parts]
        part = scored(start, stop) >= net.threshold
        start, stop = np.r_[self.start[whole], start[part]], np.r_[self.stop[whole], stop[part]]
        spans: list[list[tuple[int, int, int]]] = [[] for _ in self.bases]
        owner = self.owners(start)
        base = self.begin[owner]
        for i, s, e in zip(owner.tolist(), (start - base).tolist(), (stop - base).tolist(), strict=True):
            spans[i].append((3, s, e))
        return spans


def seen(net: Network, windows: np.ndarray) -> np.ndarray:
    """Inputs of the logistic unit, a one last."""
    return np.concatenate([net.pooled(windows), np.ones((len(windows), 1))], axis=1, dtype=np.float64)


def slopes(x: np.ndarray, confirmed: bool, head: np.ndarray) -> np.ndarray:
    """Number of rows, and gradient and curvature of the parabola that touches their logistic loss at a head from above."""
    logits = np.clip(x @ head, -30, 30)
    p = 1 / (1 + np.exp(-logits))
    bend = np.where(np.abs(logits) > 1e-3, (p - 0.5) / np.where(logits == 0, 1, logits), 0.25)
    return np.r_[len(x), x.T @ (p - confirmed), (x.T @ (x * bend[:, None])).ravel()]


def adding(net: Network, heads: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task's windows for each head, the one of their fold and the last, which learns from all; and what the unit
    sees of each confirmed value without what stands before it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = heads.shape[1]
        sums = np.zeros((FOLDS + 1, 2, 1 + size + size * size))
        for batch in batches:
            for own, confirmed, windows in Batch(batch).labelled():
                for i in range(0, len(windows), 8192):
                    views, h = [seen(net, windows[i : i + 8192])], own[i : i + 8192]
                    if confirmed:
                        bare = windows[i : i + 8192].copy()
                        bare[:, :BEFORE] = 0
                        views.append(seen(net, bare))
                        yield _sums((h % FOLDS).tolist(), [True] * len(bare), [None] * len(bare), list(views[1][:, :-1]), h.tolist())
                    for x in views:
                        for k in range(FOLDS):
                            sums[k, int(confirmed)] += slopes(x[h % FOLDS == k], confirmed, heads[k]) / len(views)
                        sums[FOLDS, int(confirmed)] += slopes(x, confirmed, heads[FOLDS]) / len(views)
        places = [(k, y) for k in range(FOLDS + 1) for y in (0, 1)]
        yield _sums([k for k, _ in places], [bool(y) for _, y in places], [sums[p] for p in places], [None] * len(places), [None] * len(places))

    return add


def _sums(heads: list[int], confirmed: list[bool], sums: list, inputs_: list, own: list) -> pa.RecordBatch:
    columns = [pa.array(heads, pa.int32()), pa.array(confirmed, pa.bool_())]
    columns += [pa.array(sums, pa.list_(pa.float64())), pa.array(inputs_, pa.list_(pa.float64())), pa.array(own, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["head", "confirmed", "sums", "inputs", "hash"])


def step(start: np.ndarray, head: np.ndarray, made: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
    """The lowest point of the bound from sums over made findings and the table, others first, so the loss never rises: both
    classes weigh the same, and the table's windows of a class as much as the made ones where they are as many.  Rounded, so
    that the order of summing is not seen."""
    size = len(head)
    gradient, curve = RIDGE * (head - start), RIDGE * np.eye(size)
    for of_made, of_table in zip(made, own, strict=True):
        share = min(of_made[0], of_table[0])
        for sums, weight in ((of_made, of_made[0]), (of_table, share)):
            each = weight / (of_made[0] + share) / max(sums[0], 1) / 2
            gradient = gradient + each * sums[1 : size + 1]
            curve = curve + each * sums[size + 1 :].reshape(size, size)
    return np.round(head - np.linalg.solve(curve, gradient), 6)


def binned(logits: np.ndarray) -> np.ndarray:
    """How many logits each step holds."""
    return np.bincount(np.floor(np.clip(logits, -32, 32) * BIN).astype(np.int64) - LEAST_BIN, minlength=BINS)


def least_bin(made: np.ndarray, table: np.ndarray) -> int:
    """The highest step from which on the made true ones, and these and the table's, keep RECALL."""
    return min(int(np.searchsorted(np.cumsum(c), may_lose(int(c.sum())), side="right")) for c in (made, made + table))


def learned(rows: DataFrame, space: Workspace) -> tuple[Network, np.ndarray, np.ndarray, int]:
    """The network fitted on every row; counts of the true ones' and the made look-alikes' logits; the threshold's step."""
    net = fit([])
    learn, held = ([coded([w for w, y in part if y == label]) for label in (False, True)] for part in made_findings())
    start = np.round(np.r_[net.out, net.shift], 6)
    heads = np.tile(start, (FOLDS + 1, 1))
    made = [seen(net, windows) for windows in learn]
    for _ in range(ROUNDS):
        added = rows.select("text").mapInArrow(adding(net, heads), SUMS_SCHEMA)
        table = space.materialize(added, "sums")
        each = table.filter("sums IS NOT NULL").select("head", "confirmed", F.posexplode("sums").alias("place", "value"))
        totals = np.zeros((FOLDS + 1, 2, 1 + len(start) + len(start) ** 2))
        for r in each.groupBy("head", "confirmed", "place").agg(F.sum("value").alias("value")).collect():
            totals[r["head"], int(r["confirmed"]), r["place"]] = r["value"]
        steps = [[slopes(x, bool(y), head) for y, x in enumerate(made)] for head in heads]
        heads = np.array([step(start, h, m, t) for h, m, t in zip(heads, steps, totals, strict=True)])
    net.others, net.confirmed = (round(n) for n in totals[FOLDS, :, 0])

    def logit(head: np.ndarray):
        terms = F.zip_with("inputs", F.array(*[F.lit(float(v)) for v in head[:-1]]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(float(head[-1])), lambda total, term: total + term)

    # A confirmed value is scored by the head of the other fold.
    crosswise = F.when(F.col("head") == 0, logit(heads[1])).otherwise(logit(heads[0]))
    number = F.floor(F.least(F.greatest(crosswise, F.lit(-32.0)), F.lit(32.0)) * BIN) - LEAST_BIN
    true = np.zeros((FOLDS, BINS), dtype=np.int64)
    for r in table.filter("inputs IS NOT NULL").dropDuplicates(["hash"]).groupBy("head", number.alias("step")).count().collect():
        true[r["head"], r["step"]] = r["count"]
    of_made = [seen(net, windows) @ heads[FOLDS] for windows in held]
    halves = [binned(of_made[1][k::2]) for k in range(2)]
    least = least_bin(sum(halves), sum(true))
    crossed = [least_bin(halves[1 - k], true[1 - k]) for k in range(2)]
    all_true = sum(halves) + sum(true)
    net.recall = sum(int((halves[k] + true[k])[crossed[k] :].sum()) for k in range(2)) / int(all_true.sum())
    threshold = 1 / (1 + math.exp(-(least + LEAST_BIN) / BIN))
    return replace(net, out=heads[FOLDS][:-1], shift=float(heads[FOLDS][-1]), slope=1.0, intercept=0.0, threshold=threshold), all_true, binned(of_made[0]), least


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn, n_candidates, calibrated, recall,
    false_positive_rate for every row.

    Spans are kind:start:end over code points, by start and then kind; base_sha256 is taken over the rules' spans only
    (of an empty string where there are none).  n_candidates counts the pieces of runs that no rule's span covers.  Null
    text is empty.  The network is fitted on every row at any size of the table, an empty one included; recall is that of
    made findings held out and of all distinct confirmed values, half of them under the threshold of the other half;
    false_positive_rate is the share that passes of all unconfirmed pieces and of made look-alikes held out; calibrated
    says whether Platt's line over all these scores rises.  Rows are independent of each other once the network is fitted;
    an empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    space = Workspace(docs.sparkSession)
    net, true, false, least = learned(rows, space)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Batch(batch)
            counts = np.bincount(own.owners(own.start), minlength=len(batch))
            added = own.added(shared.value)
            columns = [[] for _ in range(6)]
            for spans, more in zip(own.bases, added, strict=True):
                said = [f"{KINDS[k]}:{s}:{e}" for k, s, e in spans]
                every = [f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans + more, key=lambda x: (x[1], x[0]))]
                values = [sum(k == kind for k, _, _ in spans) for kind in range(3)]
                values += [hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(every), len(more)]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            with np.errstate(divide="ignore"):
                logits = np.clip(np.log(own.best) - np.log1p(-own.best), -32, 32)
            # The last bits of a score that passes may lie below the step.
            steps = np.floor(logits * BIN).astype(np.int64) - LEAST_BIN
            steps = np.where(own.best >= shared.value.threshold, np.maximum(steps, least), np.minimum(steps, least - 1)).astype(np.int16)
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            scores = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(steps))
            arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], scores]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "steps"])

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, steps array<short>"
    scanned = space.materialize(rows.mapInArrow(score, schema), "scanned")
    for r in scanned.select(F.explode("steps").alias("step")).groupBy("step").count().collect():
        false[r["step"]] += r["count"]
    slope, _ = platt((np.arange(BINS) + LEAST_BIN) / BIN, true.astype(float), false.astype(float))
    return scanned.select(
        *scanned.columns[:-1], F.size("steps").cast("long").alias("n_candidates"), F.lit(slope > 0).alias("calibrated"),
        F.lit(net.recall).alias("recall"), F.lit(float(false[least:].sum() / false.sum())).alias("false_positive_rate"),
    )

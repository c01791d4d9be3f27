"""Personal data by a semi-Markov conditional random field over whole candidate spans, beside exact base patterns.

Text is looked at in *islands*: runs of neighbouring words that hold a digit or an @; elsewhere no candidate exists and every
token is outside. An island is cut into atoms (runs of letters, runs of digits, single marks, runs of blanks). Candidate
segments are ranges of up to ``MAX_ATOMS`` atoms; features look at the whole span (digit count, checksum, separators, shape,
what stands at its sides). Viterbi over segments and types picks boundaries and kinds together; a token outside is a segment
of one atom. The weights are trained by maximum likelihood (forward-backward over segmentations) on sentences made from a
seeded generator, so the model is the same on every run and at every size.

An island of any length is searched as a whole, in parts of bounded memory: a part looks ahead by one segment's atoms, features
of all its candidates are sums over atoms, and the search carries its state from part to part. Candidates that no
segmentation could gain by are not searched.

Base spans are always kept; the field adds spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections.abc import Iterator
from itertools import islice
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.llm.ids import with_long_id
from florilege.llm.textkernels import sliced

KINDS = ("email", "ip", "card", "phone")
#: Atoms of a segment, and those whose candidates are scored at a time; islands may be of any length.
MAX_ATOMS, SCORED_ATOMS = 16, 4096
#: Bytes of texts at a time.
SLICE_BYTES = 4 << 20
#: Sentences and rounds of the training, which bound its cost; it ends before once a round gains less than this part.
TRAIN_SENTENCES, TRAIN_ROUNDS, LEAST_GAIN = 360, 60, 2e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always begins where a run of digits does, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ATOM = re.compile(r"([^\W\d_]+)|([0-9]+)|(\s+)|.", re.S)
_LETTERS, _DIGITS, _BLANKS = 1, 2, 3
_BLANK = re.compile(r"[\x20\x09-\x0D]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns by start, then kind as listed; offsets are code points, ends exclusive."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if _small_parts(m.group()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring words, one blank apart, that hold a digit or an @."""
    start = end = -1
    pos = 0
    while m := _TRIGGER.search(text, pos):
        low = m.start()
        while low > max(pos, 0) and not _BLANK.match(text[low - 1]):
            low -= 1
        stop = _BLANK.search(text, m.end())
        high = stop.start() if stop else len(text)
        if low - end == 1 and start >= 0:
            end = high
        else:
            if start >= 0:
                yield start, end
            start, end = low, high
        pos = high
    if start >= 0:
        yield start, end


#: Names of the whole-span features; every kind has a weight for each.
FEATURES = (
    "bias", "digits<7", "digits 7-9", "digits 10-13", "digits 14-19", "digits>19", "one @", "email shape", "letters without @", "four parts", "parts to 255",
    "checksum", "card groups", "card marks only", "starts +", "starts (", "phone marks only", "phone groups", "no separator", "open bracket", "atom cut left",
    "atom cut right", "mark left", "mark right", "ends in digit", "groups 3-3-4",
    "trunk number", "equal groups", "mixed marks",
)
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_CARD_GROUPS = re.compile(r"[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{2,4}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}")
_PHONE_GROUPS = re.compile(r"(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?")
_THREES = re.compile(r"(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}")
_TRUNK = re.compile(r"(?:\(0[1-9][0-9]{1,3}\)|0[1-9][0-9]{1,3})[\x20-](?:[0-9]{5,8}|[0-9]{3,4}[\x20-][0-9]{3,4})")
_GROUPS, _NOT_GROUPS = re.compile(r"[0-9]+"), re.compile(r"[^0-9]")
_PARTS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
#: Other marks that a card, an address and a phone may have within, and characters beside a span that speak against or for it.
_CARD_MARKS, _PARTS_MARKS, _PHONE_MARKS = "-", ".", "().-"
_CUT_LEFT, _CUT_RIGHT, _MARK_LEFT, _MARK_RIGHT = "_+(@", "_@", "=\"'#$/.-,:", "=\"'%/-:"
_DOUBLED = np.array([2 * d - 9 * (d > 4) for d in range(10)])


def _sums(flags) -> np.ndarray:
    """The sum of the flags before each bound."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


class Atoms:
    """A run of atoms: bounds, and what the features of any range of them are summed up from."""

    def __init__(self, text: str, bounds: list[int], kinds: list[int]):
        self.text, self.bounds = text, bounds
        kind, at = np.array(kinds, np.int8), np.array(bounds)
        first = [text[b] for b in bounds[:-1]]
        last = [text[b - 1] for b in bounds[1:]]
        letters, digit, mark = kind == _LETTERS, kind == _DIGITS, kind == 0
        odd_blank = np.zeros(len(kinds), bool)
        for k in np.flatnonzero(kind == _BLANKS):
            odd_blank[k] = bool(text[bounds[k] : bounds[k + 1]].strip(" "))
        is_ = lambda marks: np.array([c in marks for c in first]) & mark
        self.digits, self.ats, self.letters = _sums(np.diff(at) * digit), _sums(is_("@")), _sums(letters)
        self.brackets = _sums(is_("(").astype(np.int64) - is_(")"))
        beyond = letters | odd_blank
        self.no_card, self.no_phone = _sums(beyond | (mark & ~is_(_CARD_MARKS))), _sums(beyond | (mark & ~is_(_PHONE_MARKS)))
        self.no_parts = _sums(letters | (kind == _BLANKS) | (mark & ~is_(_PARTS_MARKS)))
        self.no_digit = _sums([not d and not text[a:b].isdigit() for d, a, b in zip(digit.tolist(), bounds, bounds[1:], strict=False)])
        plus = is_("+")
        self.plus, self.round = plus, is_("(")
        after = np.where(plus, len(kinds), np.arange(len(kinds)))
        self.after_plus = np.minimum.accumulate(after[::-1])[::-1]  # the first atom from each on that is no +
        self.opens = np.array([c.isalnum() for c in first]) | plus | self.round
        self.closes = np.array([c.isalnum() for c in last])
        self.ends_in_digit = np.array([c.isdigit() for c in last])
        before, behind = [text[b - 1 : b] for b in bounds[:-1]], [text[b : b + 1] for b in bounds[1:]]
        beside = lambda chars, marks: np.array([c != "" and (c.isalnum() or c in marks) for c in chars])
        marked = lambda chars, marks: np.array([c != "" and c in marks for c in chars])
        self.cut_left, self.cut_right = beside(before, _CUT_LEFT), beside(behind, _CUT_RIGHT)
        self.mark_left, self.mark_right = marked(before, _MARK_LEFT), marked(behind, _MARK_RIGHT)
        d = np.frombuffer("".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(digit)).encode(), np.uint8) - 48
        even = np.arange(len(d)) % 2 == 0
        # sums for the checksum, by the place of the digit that is last: a digit is doubled at every other place before it
        self.check = [_sums(np.where(even == (p == 0), d, _DOUBLED[d])) for p in (0, 1)]

    def segments(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that begin at the atoms from low to high, as atom ranges: those that hold an @ or seven digits, without
        blanks at the sides and with no mark there that no kind can have."""
        n = len(self.bounds) - 1
        i = np.flatnonzero(self.opens[low:high]) + low
        j = i[:, None] + np.arange(1, MAX_ATOMS + 1)
        inside, j = j <= n, np.minimum(j, n)
        ats, digits = self.ats[j] - self.ats[i][:, None], self.digits[j] - self.digits[i][:, None]
        row, column = np.nonzero(inside & self.closes[j - 1] & ((ats == 1) | ((ats == 0) & (digits >= 7))))
        return i[row], j[row, column]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The features of the candidates, one row each."""
        over = lambda sums: sums[j] - sums[i]
        n, at, last = over(self.digits), over(self.ats), j - 1
        card, parts = over(self.no_card) == 0, over(self.no_parts) == 0
        phone = self.no_phone[j] == self.no_phone[np.minimum(self.after_plus[i], j)]
        a, b = self.digits[i], self.digits[j]
        check = np.where((b - 1) % 2 == 0, self.check[0][b] - self.check[0][a], self.check[1][b] - self.check[1][a]) % 10 == 0
        x = np.zeros((len(i), len(FEATURES)))
        x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 4], x[:, 5] = 1, n < 7, (n >= 7) & (n <= 9), (n >= 10) & (n <= 13), (n >= 14) & (n <= 19), n > 19
        x[:, 6], x[:, 8] = at == 1, (at == 0) & (over(self.letters) > 0)
        x[:, 11], x[:, 13] = (n >= 13) & (n <= 19) & check, card
        x[:, 14], x[:, 15], x[:, 16] = self.plus[i], self.round[i], phone
        x[:, 18], x[:, 19] = over(self.no_digit) == 0, over(self.brackets) != 0
        x[:, 20], x[:, 21], x[:, 22], x[:, 23], x[:, 24] = self.cut_left[i], self.cut_right[last], self.mark_left[i], self.mark_right[last], self.ends_in_digit[last]
        # shapes, of those alone that have no other characters than the shape
        for column, shape, some in ((7, _EMAIL_SHAPE, at == 1), (9, _PARTS, parts), (12, _CARD_GROUPS, card & (n >= 13) & (n <= 19)), (17, _PHONE_GROUPS, phone & (n >= 7) & (n <= 19))):
            for c in np.flatnonzero(some):
                x[c, column] = shape.fullmatch(self.text, self.bounds[i[c]], self.bounds[j[c]]) is not None
        for c in np.flatnonzero(phone & (n >= 7) & (n <= 19)):
            start, stop = self.bounds[i[c]], self.bounds[j[c]]
            x[c, 25], x[c, 26] = _THREES.fullmatch(self.text, start, stop) is not None, _TRUNK.fullmatch(self.text, start, stop) is not None
            sizes = [len(g) for g in _GROUPS.findall(self.text, start, stop)]
            x[c, 27] = len(sizes) > 1 and len(set(sizes)) == 1
            x[c, 28] = len(set(_NOT_GROUPS.findall(self.text, start, stop))) > 1
        for c in np.flatnonzero(x[:, 9]):
            x[c, 10] = _small_parts(self.text[self.bounds[i[c]] : self.bounds[j[c]]])
        return x


def atoms(text: str, start: int, end: int, most: int | None = None) -> Iterator[tuple[Atoms, int]]:
    """The atoms of an island in parts: each with how many of them are its own, and with those of one segment beyond."""
    most = most or SCORED_ATOMS
    found, bounds, kinds = _ATOM.finditer(text, start, end), [start], []
    while True:
        for m in islice(found, most + MAX_ATOMS - len(kinds)):
            bounds.append(m.end())
            kinds.append(m.lastindex or 0)
        if not kinds:
            return
        own = min(most, len(kinds)) if len(kinds) == most + MAX_ATOMS else len(kinds)
        yield Atoms(text, bounds, kinds), own
        bounds, kinds = bounds[own:], kinds[own:]


class SemiMarkov:
    """Weights of features by kind, and of kinds that follow one another; outside scores 0 and resets nothing."""

    def __init__(self, weights: np.ndarray, follow: np.ndarray):
        self.weights, self.follow = weights, follow
        # the most that a segment of each kind can gain by what stands before and after it, against atoms outside
        self.most = follow.max(0) + np.maximum(0, (follow[1:] - follow[0]).max(1))

    def _scored(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, int, float]]:
        """Start, end, kind and score of the candidates that may be gained by, ordered by these."""
        for part, own in atoms(text, start, end):
            if not part.ats[-1] and part.digits[-1] < 7:
                continue
            i, j = part.segments(0, own)
            if not len(i):
                continue
            scores = part.features(i, j) @ self.weights.T
            for c, k in zip(*np.nonzero(scores + self.most > 0), strict=True):
                yield part.bounds[i[c]], part.bounds[j[c]], int(k), float(scores[c, k])

    def decode(self, text: str, start: int, end: int) -> list[Span]:
        """The best segmentation of an island: its segments that are not outside.

        States change only where segments begin and end; between, what is best so far is carried on. Of equal segmentations
        that with more outside is taken.
        """
        follow = self.follow.tolist()
        value, path = 0.0, None  # of the best segmentation so far that ends outside
        ends: list[int] = []
        ended: dict[int, dict[int, tuple[float, tuple]]] = {}  # by end and kind, those that end in a segment

        def leave(before: float) -> None:
            nonlocal value, path
            while ends and ends[0] < before:
                for _, (v, p) in sorted(ended.pop(heapq.heappop(ends)).items()):
                    if v > value:
                        value, path = v, p

        for s, e, k, score in self._scored(text, start, end):
            leave(s)
            best, via = value + follow[0][k], path
            for before, (v, p) in sorted(ended.get(s, {}).items()):
                if v + follow[before + 1][k] > best:
                    best, via = v + follow[before + 1][k], p
            if e not in ended:
                ended[e] = {}
                heapq.heappush(ends, e)
            if k not in ended[e] or best + score > ended[e][k][0]:
                ended[e][k] = (best + score, (via, k, s, e))
        leave(float("inf"))
        out = []
        while path:
            path, k, s, e = path
            out.append((KINDS[k], s, e))
        return out[::-1]


def _sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A training sentence and its spans: personal data in many formats, among numbers that are none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioutnrslhd") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+{rng.randint(1, 99)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(30, 59)}{digits(10)}", f"+{rng.randint(30, 59)} {digits(2)} {digits(4)} {digits(4)}", f"{a} {b} {c}", f"0{rng.randint(11, 99)} {digits(rng.randint(6, 8))}", f"0{rng.randint(111, 999)} {digits(7)}", f"0{rng.randint(11, 999)} {b} {c}"))

    made = {
        "email": lambda: f"{word()}{rng.choice(('', '.', '_', '+'))}{rng.choice((word(), digits(2)))}@{word()}{rng.choice(('', digits(1)))}.{rng.choice(('com', 'org', 'example.net', 'de'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    other = (
        lambda: digits(rng.randint(1, 6)), lambda: digits(rng.randint(7, 20)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f'"{"".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40)))}"',
        lambda: f"{digits(3)}.{rng.randint(256, 999)}.{digits(2)}.{digits(1)}", lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"id={digits(rng.randint(8, 18))}", lambda: f"{digits(8)}-{digits(4)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)} {digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(4)} {digits(4)}",
    )
    text, spans = word(), []
    for _ in range(rng.randint(1, 3)):
        text += " " if rng.random() < 0.9 else " " + word() + " "
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            s = made[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = rng.choice(other)()
        text += s + rng.choice(("", "", ".", ","))
    return text + " " + word(), spans


def train(sentences: int = TRAIN_SENTENCES, rounds: int = TRAIN_ROUNDS, seed: int = 11) -> SemiMarkov:
    """Maximum likelihood with a Gaussian prior, by adaptive gradient steps; gradients come from forward-backward sums.

    The steps end once one gains less than ``LEAST_GAIN`` of what the likelihood still lacks, or after ``rounds`` of them.
    """
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = _sentence(rng)
        gold = {(s, e): KINDS.index(k) for k, s, e in spans}
        for start, end in islands(text):
            for part, n in atoms(text, start, end):  # a sentence's islands have one part
                i, j = part.segments(0, n)
                if len(i):
                    found = list(zip(i.tolist(), j.tolist(), strict=True))
                    data.append((n, found, part.features(i, j), [gold.get((part.bounds[a], part.bounds[b])) for a, b in found]))
    weights, follow = np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1, len(KINDS)))
    size = [np.full_like(weights, 1e-6), np.full_like(follow, 1e-6)]
    before = -np.inf
    for _ in range(rounds):
        grad = [-0.02 * weights, -0.02 * follow]
        now = -0.01 * float((weights**2).sum() + (follow**2).sum())
        for n, found, x, gold in data:
            now += _gradient(n, found, x, gold, x @ weights.T, follow, grad)
        if abs(now - before) < LEAST_GAIN * abs(now):
            break
        before = now
        for p, g, s in zip((weights, follow), grad, size, strict=True):
            s += g * g
            p += 0.7 * g / np.sqrt(s)
    return SemiMarkov(weights, follow)


def _gradient(n: int, found, x: np.ndarray, gold, scores: np.ndarray, follow: np.ndarray, grad: list[np.ndarray]) -> float:
    """Add the observed minus the expected features of one island; returns the logarithm of its likelihood."""
    states = len(KINDS) + 1
    alpha, beta = np.full((n + 1, states), -np.inf), np.full((n + 1, states), -np.inf)
    alpha[0, 0] = 0
    beta[n] = 0
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for c, (i, j) in enumerate(found):
        ending[j].append(c)
        starting[i].append(c)
    total = np.logaddexp.reduce
    with np.errstate(all="ignore"):
        for j in range(1, n + 1):
            alpha[j, 0] = total(alpha[j - 1])
            if ending[j]:
                alpha[j, 1:] = total([total(alpha[found[c][0]][:, None] + follow, axis=0) + scores[c] for c in ending[j]], axis=0)
        for i in range(n - 1, -1, -1):
            beta[i] = beta[i + 1, 0]
            if starting[i]:
                onward = total([scores[c] + beta[found[c][1], 1:] for c in starting[i]], axis=0)
                beta[i] = np.logaddexp(beta[i], total(follow + onward, axis=1))
        z = total(alpha[n])
        before, likelihood = 0, -float(z)
        for c, (i, j) in enumerate(found):
            joint = np.exp(alpha[i][:, None] + follow + scores[c] + beta[j, 1:] - z)
            share = joint.sum(0)
            if gold[c] is not None:
                share = share - np.eye(len(KINDS))[gold[c]]
            grad[0] -= share[:, None] * x[c]
            grad[1] -= joint
        for c in sorted((c for c in range(len(found)) if gold[c] is not None), key=lambda c: found[c]):
            after = before if last_end_is(found[c][0], before, found, gold) else 0
            grad[1][after, gold[c]] += 1
            likelihood += float(scores[c, gold[c]] + follow[after, gold[c]])
            before = gold[c] + 1
    return likelihood


def last_end_is(i: int, before: int, found, gold) -> bool:
    """Whether a gold segment ends right where atom i begins."""
    return bool(before) and any(gold[c] is not None and found[c][1] == i for c in range(len(found)))


@lru_cache(1)
def trained() -> SemiMarkov:
    return train()


def find_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and then kind."""
    base = base_spans(text)
    taken = [(s, e) for _, s, e in base]
    more = [x for low, high in islands(text) for x in model.decode(text, low, high)]
    if taken and more:
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate([e for _, e in taken])
        more = [x for x in more if (k := int(np.searchsorted(starts, x[2]))) == 0 or reach[k - 1] <= x[1]]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_in_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts of base spans by kind, ``base_sha256`` and ``spans``.

    A null text counts as empty; a null doc_id is kept; repeated rows give repeated rows; an empty table gives none; other columns
    are ignored, whatever their names. Of spans that tie, the search takes fewer. An id of another than an integer type is a
    TypeError. Narrow: no shuffle.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES, "pii"):
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                base, every = find_spans(text.as_py() or "", model)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return with_long_id(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """Put a mark such as <EMAIL> for each span; of overlapping spans, the first names the whole of them."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans redacted in ``text`` and, if there is such a column, ``n_chars`` counted anew.

    Null and empty texts stay so; all other columns stay, whatever their names and types, as do repeated rows; an empty table
    gives no rows.
    """
    model = trained()
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    rows = docs.toDF(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, columns[at], SLICE_BYTES, "pii"):
            texts = [None if x is None else redact(x, find_spans(x, model)[1]) for x in (v.as_py() for v in batch.column(at))]
            yield batch.set_column(at, columns[at], pa.array(texts, batch.schema.field(at).type))

    out = rows.mapInArrow(run, T.StructType(list(rows.schema)))
    if "n_chars" in docs.columns:
        n = columns[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.length(columns[at]).cast(rows.schema[n].dataType))
    return out.toDF(*docs.columns)

"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes (operator 6)."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.flat import FOLD, SPACED, Words, slices, words

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 outside, then the first word of each kind (1, 3, 5, 7) and the further ones (2, 4, 6, 8).
LABELS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From one @ to the next: the local part is the run before it, the domain a match right behind; linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            found.append((start, last))
        at = text.find("@", last)
    return found


def _addresses(text: str) -> list[tuple[int, int]]:
    """Maximal dotted runs, four numbers at a time; a group with a number above 255 is dropped whole."""
    found = []
    for run in _DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start: leftmost matches of each kind that pass its test."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_ROLE = np.full(256, 7, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"@", b".", b"-", b"+()[]")):
    _ROLE[list(_set)] = _i
_BUCKET = np.digitize(np.arange(41), [1, 2, 3, 4, 5, 8, 12, 16, 20, 32])
#: Words that tell what a number or an address behind them is, of at most 8 letters; a mark may follow them.
CUES = (
    ("tel", "phone", "call", "fax", "mobile", "dial", "cell", "telefon", "telefono", "rufen", "llame", "appelez", "ring", "sms"),
    ("card", "visa", "karte", "tarjeta", "carte", "credit", "debit"),
    ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel"),
    ("isbn", "rows", "order", "no", "nr", "page", "pages", "pp", "part", "item", "invoice", "of", "version", "id", "code", "table", "section", "year", "years", "serie", "model", "batch"),
)
_CUE_BYTES, _CUE_KIND = (
    np.array(x)
    for x in zip(*sorted((int.from_bytes((w + mark).encode().ljust(8, b"\0"), "little"), k + 1) for k, group in enumerate(CUES) for w in group for mark in ("", ":", ".", ",") if len(w + mark) <= 8))
)
_CUE_BYTES = _CUE_BYTES.astype(np.uint64)
#: Sizes of the feature groups: the roles that occur, digits, length, dots, first and last role, digits before and behind, the words
#: `at` or `dot` near, cues one and two words before.
_SIZES = (256, 11, 11, 5, 64, 121, 32, 5, 5)
_STARTS = np.r_[0, np.cumsum(_SIZES)[:-1]]


def shapes(x: Words) -> np.ndarray:
    """(words, groups): indexes of each word's shape features, from byte roles, spelt marks and cues, its own and its neighbours'."""
    n = len(x.starts)
    if not n:
        return np.zeros((0, len(_SIZES)), np.int64)
    role = np.where(SPACED[x.buf], _ROLE[x.buf], 8).astype(np.uint8)
    bits = np.bitwise_or.reduceat(np.where(role < 8, np.left_shift(np.uint8(1), role & 7), 0).astype(np.uint8), x.starts).astype(np.int64)
    some = lambda r: np.add.reduceat((role == r).astype(np.int32), x.starts)
    digits = _BUCKET[np.minimum(some(2), 40)]
    length = x.ends - x.starts
    size = _BUCKET[np.minimum(length, 40)]
    same = x.doc[1:] == x.doc[:-1] if n > 1 else np.zeros(0, bool)
    prior = lambda v, k=1: np.r_[np.zeros(min(k, n), np.int64), np.where(x.doc[k:] == x.doc[: n - k], v[: n - k], 0)] if k < n else np.zeros(n, np.int64)
    behind = lambda v: np.r_[np.where(same, v[1:], 0), 0]
    first, last = role[x.starts].astype(np.int64), role[x.ends - 1].astype(np.int64)
    short = np.flatnonzero((length <= 8) & (digits == 0))
    core = np.zeros((n, 8), np.uint8)
    core[short] = FOLD[x.buf[np.minimum(x.starts[short, None] + np.arange(8), len(x.buf) - 1)]] * (np.arange(8) < length[short, None])
    code = core.view(np.uint64).ravel()
    spelt = np.zeros(n, np.int64)
    for word, bit in ((b"at", 1), (b"(at)", 1), (b"[at]", 1), (b"dot", 2), (b"(dot)", 2), (b"[dot]", 2)):
        spelt[code == np.frombuffer(word.ljust(8, b"\0"), np.uint64)[0]] = bit
    found = np.minimum(np.searchsorted(_CUE_BYTES, code), len(_CUE_BYTES) - 1)
    cue = np.where(_CUE_BYTES[found] == code, _CUE_KIND[found], 0)
    one, two = prior(spelt), behind(spelt)
    near = np.minimum(spelt + 3 * one + 9 * two, 31)
    own = np.stack([bits, digits, size, np.minimum(some(4), 4), first * 8 + last, prior(digits) * 11 + behind(digits), near, prior(cue), prior(cue, 2)], 1)
    return own + _STARTS


@dataclass
class Field:
    """weights: (features, LABELS); moves: (LABELS, LABELS), from row to column."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, x: Words) -> np.ndarray:
        f = shapes(x)
        out = self.weights[f[:, 0]].copy() if len(f) else np.zeros((0, LABELS), np.float32)
        for g in range(1, f.shape[1]):
            out += self.weights[f[:, g]]
        return out

    def settled(self, score: np.ndarray, x: Words) -> np.ndarray:
        """Which words are outside on a best path, whatever the labels beyond are.

        A quiet word loses more with any label than a move between labels can win (c), and a lone one more than a run's two ends can
        win, so a run of labels among quiet words is never better than none. A run that comes in from a word that is not quiet
        can be cut where the stretch of quiet words begins, once the surpluses (gap - c) up to here pay for the cut; so on the
        other side, and so in the middle of a run that comes from one side and leaves at the other.
        """
        t, n = self.moves, len(score)
        still = t[0, 0]
        most = lambda m: max(float(m.max()), 0.0)
        c = most(t[1:, 1:] - still)
        leave, enter = most(t[1:, 0] - still), most(t[0, 1:] - still)
        left, right = most(t[1:, 1:] - t[1:, :1]) + leave, most(t[1:, 1:] - t[:1, 1:]) + enter
        gap = score[:, 0].astype(np.float64) - score[:, 1:].max(1)
        quiet = (gap > c) & (gap > leave + enter)
        surplus = np.where(quiet, gap - c, 0.0)
        begins = np.r_[True, (~quiet[:-1]) | (x.doc[1:] != x.doc[:-1])]  # a stretch of quiet words, or a word that is not
        begins[1:] |= ~quiet[1:]
        at = np.flatnonzero(begins)
        stretch = np.cumsum(begins) - 1
        run = np.cumsum(surplus)
        before = np.r_[0.0, run][at][stretch]
        whole = np.add.reduceat(surplus, at)[stretch]
        ends = np.r_[at[1:], n] - 1
        opens, closes = (at == x.first[x.doc[at]])[stretch], (ends + 1 == x.first[x.doc[ends] + 1])[stretch]
        upto = run - before
        slack = 1e-3  # for rounding
        ok = (opens | (upto >= left + slack)) & (closes | (whole - upto + surplus >= right + slack))
        return quiet & ok & (opens | closes | (whole >= left + right + slack))


    def decode(self, x: Words) -> np.ndarray:
        """Viterbi labels of all words of a slice. Settled words cut a text into sequences, of any length, which begin and end at
        label 0 there; they are decoded side by side, the longest first. The result is that of whole texts."""
        out = np.zeros(len(x.starts), np.int8)
        every = self.scores(x)
        at = np.flatnonzero(~self.settled(every, x)) if len(every) else np.zeros(0, np.int64)
        if not len(at):
            return out
        score = every[at]
        new = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(x.doc[at]) > 0)])
        first, size = new, np.diff(np.r_[new, len(at)])
        head, tail = at[first], at[first + size - 1]
        score[first[head > x.first[x.doc[head]]]] += self.moves[0]
        score[(first + size - 1)[tail + 1 < x.first[x.doc[tail] + 1]]] += self.moves[:, 0]
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        running = np.searchsorted(-size, -np.arange(size[0]), "left")  # how many sequences have a word at each place
        best, back = score[first], np.zeros(score.shape, np.int8)
        for t in range(1, size[0]):
            n = running[t]
            to = best[:n, :, None] + self.moves
            back[first[:n] + t] = to.argmax(1)
            best[:n] = to.max(1) + score[first[:n] + t]
        label, found = best.argmax(1), np.zeros(len(at), np.int8)
        for t in range(size[0] - 1, -1, -1):
            n = running[t]
            found[first[:n] + t] = label[:n]
            label[:n] = back[first[:n] + t, label[:n]]
        out[at] = found
        return out


def labelled_table(seed: int = 11) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences as (word, label), made from patterns with drawn names and digits; finds stand alone, two or
    three in a row as in lists of contacts, or behind a cue; decoys look like finds and are none."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(rng.choice(["an", "er", "lo", "mi", "ta", "ke", "ro", "su", "el", "vi"], rng.integers(2, 4)))
    plain = lambda: [(w, 0) for w in rng.choice(["the", "of", "and", "note", "Re", "die", "que", "les", "to", "of.", "line,", "Anea", "at", "dot", "be", "é", "with***", "|", "ALL!!", "please", "with"], rng.integers(1, 6))]
    octet = lambda: str(rng.integers(1, 256))
    cue = lambda k: str(rng.choice(CUES[k])) + str(rng.choice(["", "", ":", "."]))

    def tagged(words_: str, kind: int, lead: str = ""):
        return [(w, 0) for w in lead.split()] + [(w, kind and 2 * kind - (not i)) for i, w in enumerate(words_.split())]

    bare = lambda: rng.choice([f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(4)} {digits(6)}", f"{digits(3)}.{digits(3)}.{digits(4)}", digits(10)])
    forms = [
        lambda: tagged(f"{name()}.{name()}@{name()}.com", 1),
        lambda: tagged(f"{name()}{digits(2)}@mail.{name()}.org,", 1),
        lambda: tagged(f"{name()} (at) {name()} dot com", 1),
        lambda: tagged(f"{name()} [at] {name()}.net", 1),
        lambda: tagged(f"{name()}.{name()} (at) {name()} dot {name()} dot org", 1),
        lambda: tagged(f"{name()} dot {name()} at {name()} dot {rng.choice(['com', 'org', 'net', 'de'])}", 1),
        lambda: tagged(f"{name()} at {name()} dot {rng.choice(['com', 'org', 'net', 'fr'])}", 1, cue(2)),
        lambda: tagged(".".join(octet() for _ in range(4)), 2),
        lambda: tagged(".".join(octet() for _ in range(4)) + ":80", 2),
        lambda: tagged("4" + digits(15), 3),
        lambda: tagged(f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", 3),
        lambda: tagged(f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", 3, cue(1) if rng.random() < 0.5 else ""),
        lambda: tagged(f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", 4),
        lambda: tagged(f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", 4),
        lambda: tagged(f"({digits(3)}) {digits(3)}-{digits(4)}", 4),
        lambda: tagged(f"{digits(3)}-{digits(3)}-{digits(4)}", 4),
        lambda: tagged(f"{digits(3)}.{digits(3)}.{digits(4)}", 4),
        lambda: tagged(str(bare()), 4, cue(0)),
        lambda: tagged(str(bare()), 4, cue(0) + " " + str(rng.choice(["me", "us", "at", "under", "now"]))),
    ]
    decoys = [
        lambda: tagged(digits(rng.integers(1, 7)), 0),
        lambda: tagged(digits(11), 0),
        lambda: tagged("Version 2.0.", 0),
        lambda: tagged(f"{digits(1)}.{digits(1)}.", 0),
        lambda: tagged(f"password={''.join(rng.choice(list('0123456789abcdef'), 16))}", 0),
        lambda: tagged(f"AKIA{''.join(rng.choice(list('ABCDEFGHJKLMNPQR23456789'), 16))}", 0),
        lambda: tagged(f'"{"".join(rng.choice(list("0123456789abcdef"), 40))}"', 0),
        lambda: tagged(f"http://www.{name()}.com/{digits(3)}", 0),
        lambda: tagged(f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}", 0),
        lambda: tagged(f"${digits(3)}.{digits(2)} {digits(2)}% {digits(3)},{digits(3)}", 0),
        lambda: tagged("meet at the dot line", 0),
        lambda: tagged(f"meet {name()} at {name()} and {name()}", 0),
        lambda: tagged(f"@{name()} {name()}-{name()}", 0),
        lambda: tagged(f"{cue(3)} " + " ".join(digits(rng.integers(2, 5)) for _ in range(rng.integers(2, 6))), 0),
        *[lambda: tagged(f"{cue(3)} {bare()}", 0)] * 3,
        *[lambda: tagged(f"{cue(3)} {digits(3)}-{digits(3)}-{digits(4)}", 0)] * 3,
        lambda: tagged(f"{cue(3)} {cue(3)} {bare()}", 0),
        *[lambda: tagged(f"{cue(3)} {cue(3)} {digits(3)}-{digits(3)}-{digits(4)}", 0)] * 2,
        lambda: tagged(f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", 0),
        lambda: tagged(str(rng.choice([f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(4)} {digits(6)}", digits(10)])), 0),
        lambda: tagged(" ".join(digits(5) for _ in range(rng.integers(2, 5))), 0),
        lambda: tagged(f"{cue(3)} {digits(3)}-{digits(3)}-{digits(rng.integers(2, 5))}", 0),
        lambda: tagged(f"{cue(3)} {digits(3)}-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", 0),
        lambda: tagged(f"{''.join(rng.choice(list('ABCDEFGH'), 2))}-{digits(4)}-{digits(4)}", 0),
        lambda: tagged(f"{digits(4)} {digits(4)} {digits(4)}", 0),
        lambda: tagged(f"{cue(0)} (at) {digits(1)}", 0),
        lambda: tagged(" ".join(digits(3) for _ in range(rng.integers(3, 8))), 0),
        plain,
    ]
    out = []
    for _ in range(16):
        for form in [*forms, *decoys]:
            out.append([*plain(), *form(), *plain()])
        for _ in range(12):
            row = rng.integers(0, len(forms), rng.integers(2, 4))
            out.append([*plain(), *(w for i in row for w in forms[i]()), *plain()])
    return out


def _flat(sentences: list[list[str]]) -> Words:
    raw = [" ".join(s).encode() for s in sentences]
    return words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], SPACED)


def train(table: list[list[tuple[str, int]]], steps: int = 100, rate: float = 0.12, decay: float = 0.002) -> Field:
    """Maximum likelihood with a squared penalty: forward-backward expectations over the whole table, Adam steps."""
    x = _flat([[w for w, _ in s] for s in table])
    f, size = shapes(x), np.diff(x.first)
    rows, span = len(table), int(size.max())
    row, col = x.doc, np.arange(len(f)) - np.repeat(x.first[:-1], size)
    y = np.array([label for s in table for _, label in s])
    mask = np.arange(span) < size[:, None]
    full = np.zeros((rows, span), np.int64)
    full[row, col] = y
    seen = np.zeros((LABELS, LABELS))
    np.add.at(seen, (full[:, :-1][mask[:, 1:]], full[:, 1:][mask[:, 1:]]), 1)
    w, t = np.zeros((sum(_SIZES), LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    log_sum = lambda a, axis: np.log(np.exp(a - (m := a.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    for step in range(1, steps + 1):
        e = np.zeros((rows, span, LABELS), np.float32)
        e[row, col] = w[f].sum(1)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for i in range(1, span):
            a[:, i] = np.where(mask[:, i, None], log_sum(a[:, i - 1, :, None] + t, 1) + e[:, i], a[:, i - 1])
        for i in range(span - 2, -1, -1):
            b[:, i] = np.where(mask[:, i + 1, None], log_sum(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
        z = log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None])
        pairs = a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expect = (np.exp(np.minimum(pairs, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        own = p[row, col]
        own[np.arange(len(y)), y] -= 1
        gw = np.zeros_like(w)
        for g in range(f.shape[1]):
            gw += np.bincount((f[:, g, None] * LABELS + np.arange(LABELS)).ravel(), own.ravel(), gw.size).reshape(gw.shape)
        grads = [gw / rows + decay * w, (expect - seen) / rows + decay * t]
        for i, (param, g) in enumerate(zip((w, t), grads)):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w.astype(np.float32), t.astype(np.float32))


_AT = re.compile(r"@|\(at\)|\[at\]|\bat\b", re.I)
_END = re.compile(r"(?:\.|\b[\[(]?dot[\])]?\s+)[A-Za-z]{2,}\Z", re.I)


def _plausible(kind: int, s: str) -> bool:
    """A last test of what the field adds: an @ and a domain's last part in some spelling, four numbers up to 255, the card's
    check digit, or enough digits."""
    n = len(_digits(s))
    if kind == 0:
        return _AT.search(s) is not None and _END.search(s) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)[:4]
        return s.count(".") >= 3 and len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= n <= 19 and luhn(_digits(s)) if kind == 2 else 7 <= n <= 15


class _Taken:
    """Ranges, merged and sorted, and whether another one touches any of them."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, lo: int, hi: int) -> bool:
        i = bisect_right(self.ends, lo)
        return i == len(self.ends) or self.starts[i] >= hi


def added_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Labelled items as spans in code points, without trailing punctuation, that touch no base span."""
    out, kind = [], (labels.astype(np.int64) + 1) // 2
    goes_on = (kind[1:] == kind[:-1]) & (labels[1:] % 2 == 0)
    opens = np.flatnonzero((kind > 0) & ~np.r_[False, goes_on])
    stops = np.flatnonzero((kind > 0) & ~np.r_[goes_on, False])
    done, place, taken = 0, 0, _Taken(base)
    for i, j in zip(opens, stops):
        place, done = place + len(raw[done : starts[i]].decode()), starts[i]
        core = raw[starts[i] : ends[j]].decode().rstrip(".,;:!?\"'")
        own = int(kind[i]) - 1
        if _plausible(own, core) and taken.free(place, place + len(core)):
            out.append((own, place, place + len(core)))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (all), as text
    kind:start:end by kind and start, and n_added, the spans that the field adds.

    The base patterns are exact. The field is trained on the driver from its own labelled table of about 800 sentences. It
    decodes all words of every text: those whose features alone prove them outside (Field.settled()) cut a text into sequences
    without a bound. It adds the items that touch no base span and pass a last test.

    Defined cases: null and empty texts have no spans; rows of one doc_id each get a row; other columns are left behind.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_table()))

    def rows(batches):
        field = model.value
        for batch in batches:
            column = batch.column(1).fill_null("")
            may = pc.match_substring_regex(column, "[0-9@]").to_numpy(zero_copy_only=False)
            found, every = [[] for _ in may], [[] for _ in may]
            for i in np.flatnonzero(may):
                found[i] = every[i] = base_spans(column[int(i)].as_py())
            for lo, _, buf, off in slices(column):
                x = words(buf, off, SPACED)
                labels = field.decode(x)
                for d in np.unique(x.doc[labels > 0]):
                    own = slice(x.first[d], x.first[d + 1])
                    i = lo + int(d)
                    more = added_spans(buf[off[d] : off[d + 1]].tobytes(), x.starts[own] - off[d], x.ends[own] - off[d], labels[own], found[i])
                    every[i] = found[i] + more
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in found], pa.int64()) for kind in range(len(KINDS))]
            texts = [pa.array([_listed(s) for s in which], pa.string()) for which in (found, every)]
            n = pa.array([len(b) - len(a) for a, b in zip(found, every)], pa.int64())
            yield pa.record_batch([batch.column(0), *counts, *texts, n], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)

"""Personal data: rule spans, and a character BiLSTM with CRF transitions that adds others.

The network reads every character of every text, in overlapping windows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lstm_graph import lstm_graph, session
from .scratch import spare, table

KINDS = ("email", "ip", "card", "phone")

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start only: later starts in it fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

Span = tuple[int, int, int]


# --- rules -------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _passes(kind: int, text: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    digits = _NOT_DIGIT.sub("", text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from their at signs so that no run of letters is read twice."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _AT_DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the rules, by kind and then start: leftmost matches, failing ones dropped."""
    out = _emails(text)
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _passes(kind, m[0])]
    return out


# --- network -----------------------------------------------------------------------------

#: Labels: outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 12, 16
TRAIN_STEPS, TRAIN_BATCH, TRAIN_LENGTH = 480, 32, 72
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0@.+-_%() /:,=\n#[]'\"|"
_OTHER_LETTER, _OTHER = len(_ALPHABET), len(_ALPHABET) + 1
SYMBOLS = len(_ALPHABET) + 2


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    out = np.full(0x250, _OTHER, np.int64)
    for i in range(0x250):
        c = chr(i)
        if c.lower() in _ALPHABET and len(c.lower()) == 1:
            out[i] = _ALPHABET.index(c.lower())
        elif c.isdigit() and c.isascii():
            out[i] = _ALPHABET.index("0")
        elif c.isalpha():
            out[i] = _OTHER_LETTER
    return out


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _symbol_table()
    return np.where(points < len(known), known[np.minimum(points, len(known) - 1)], _OTHER_LETTER)


@lru_cache(maxsize=1)
def allowed_moves() -> np.ndarray:
    """Whether a label may follow another: inside only after begin or inside of its kind."""
    out = np.ones((LABELS, LABELS), bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


@dataclass
class Tagger:
    """Weights; the second direction reads from right to left."""

    embed: np.ndarray
    gates: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    moves: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.gates, self.bias, self.out, self.out_bias, self.moves]


def new_tagger(seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    near = lambda *shape: rng.normal(0, 0.3, shape)
    bias = np.zeros((2, 1, 4 * HIDDEN))
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1.0
    return Tagger(near(SYMBOLS, EMBED), near(2, EMBED + HIDDEN, 4 * HIDDEN), bias, near(2 * HIDDEN, LABELS), np.zeros(LABELS), np.zeros((LABELS, LABELS)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(net: Tagger, symbols: np.ndarray, keep: bool = False):
    """Emission scores ``[place, window, label]`` of ``symbols[window, place]``, and what back propagation needs."""
    length, count = symbols.shape[1], symbols.shape[0]
    both = np.stack([symbols.T, symbols.T[::-1]])
    inputs = net.embed[both]
    h, c = np.zeros((2, count, HIDDEN)), np.zeros((2, count, HIDDEN))
    hidden = np.empty((length, 2, count, HIDDEN))
    tape = []
    for t in range(length):
        x = np.concatenate([inputs[:, t], h], 2)
        z = x @ net.gates + net.bias
        i, f, o = _sigmoid(z[..., :HIDDEN]), _sigmoid(z[..., HIDDEN : 2 * HIDDEN]), _sigmoid(z[..., 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[..., 3 * HIDDEN :])
        before = c
        c = f * before + i * g
        squashed = np.tanh(c)
        h = o * squashed
        hidden[t] = h
        if keep:
            tape.append((x, i, f, o, g, before, squashed))
    states = np.concatenate([hidden[:, 0], hidden[::-1, 1]], 2)
    return states @ net.out + net.out_bias, (both, states, tape)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _chain(net: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Scores of moves and of first labels; forbidden ones are out of reach."""
    moves = np.where(allowed_moves(), net.moves, -1e4)
    first = np.zeros(LABELS)
    return moves, first


def marginals(net: Tagger, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each label at each place, the log partition, and both passes."""
    moves, first = _chain(net)
    length = len(scores)
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = first + scores[0]
    for t in range(1, length):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(length - 2, -1, -1):
        behind[t] = _log_sum(moves + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    return np.exp(ahead + behind - total[:, None]), total, ahead, behind


def train_step(net: Tagger, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of ``labels[window, place]`` and its gradients."""
    scores, (both, states, tape) = _forward(net, symbols, keep=True)
    gold = labels.T
    length, count = gold.shape
    posterior, total, ahead, behind = marginals(net, scores)
    moves, _ = _chain(net)
    window = np.arange(count)
    path = scores[np.arange(length)[:, None], window, gold].sum(0) + moves[gold[:-1], gold[1:]].sum(0)
    loss = float((total - path).mean())
    d_scores = posterior.copy()
    d_scores[np.arange(length)[:, None], window, gold] -= 1
    d_scores /= count
    d_moves = np.zeros_like(net.moves)
    for t in range(1, length):
        joint = ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
        d_moves += np.exp(joint).sum(0)
    np.add.at(d_moves, (gold[:-1].ravel(), gold[1:].ravel()), -1.0)
    d_moves = np.where(allowed_moves(), d_moves / count, 0)
    d_out = np.einsum("tbh,tbl->hl", states, d_scores)
    d_out_bias = d_scores.sum((0, 1))
    d_states = d_scores @ net.out.T
    d_hidden = np.stack([d_states[..., :HIDDEN], d_states[::-1, :, HIDDEN:]], 1)
    d_gates, d_bias, d_embed = np.zeros_like(net.gates), np.zeros_like(net.bias), np.zeros_like(net.embed)
    d_h, d_c = np.zeros((2, count, HIDDEN)), np.zeros((2, count, HIDDEN))
    for t in range(length - 1, -1, -1):
        x, i, f, o, g, before, squashed = tape[t]
        d_h = d_h + d_hidden[t]
        d_c = d_c + d_h * o * (1 - squashed * squashed)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g * g)], 2)
        d_gates += np.swapaxes(x, 1, 2) @ d_z
        d_bias += d_z.sum(1, keepdims=True)
        d_x = d_z @ np.swapaxes(net.gates, 1, 2)
        np.add.at(d_embed, both[:, t], d_x[..., :EMBED])
        d_h, d_c = d_x[..., EMBED:], d_c * f
    return loss, [d_embed, d_gates, d_bias, d_out, d_out_bias, d_moves]


def _example(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up text with labelled spans: forms that the rules know, others, and look-alikes without a label."""
    text, spans = "", []
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = digits(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", " ", "-", ".", "_", " - ", "/"])
        return gap.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        gap = rng.choice([" ", "-", ".", "/"])
        local = gap.join([digits(3), digits(rng.choice([3, 4])), digits(4)])
        plus = f"+{digits(rng.randint(1, 2))}{gap}{local}"
        return rng.choice([plus, f"+{digits(rng.randint(1, 2))} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{digits(2)} {local}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)}/{digits(7)}", f"({digits(3)}){gap}{digits(3)}{gap}{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{digits(2)} (0){digits(2)} {digits(3)} {digits(4)}"])

    def email() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), ("@", " . "), (" at ", " dot "), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" AT ", " DOT "), ("{at}", "{dot}")])
        user = rng.choice([word(), f"{word()}{dot if dot.strip() != '.' else '.'}{word()}", f"{word()}{digits(2)}", f"{word()}+{word()}", f"{word()}_{word()}"])
        host = rng.choice([word(), word(), f"{word()}-{word()}", f"{word()}{dot}{word()}"])
        return f"{user}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'example', 'de', 'fr', 'io', 'co' + dot + 'uk'])}"

    def ip() -> str:
        return rng.choice([".", " . ", " dot ", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def likeness() -> str:
        """What looks like one of the kinds and is none."""
        return rng.choice(
            [
                digits(rng.randint(1, 7)), digits(rng.randint(17, 30)), f"{digits(1)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f"@{word()}",
                f"v{digits(1)}.{digits(1)}.{digits(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{digits(3)},{digits(3)}", digits(10), f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(2)}.{digits(2)}.20{digits(2)}",
                f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{word()} at {word()} {word()}", f"the dot on {word()}", f"at the dot {word()}", f"{word()}.{word()}", f"20{digits(2)}-20{digits(2)}", f"{digits(3)} {word()} {digits(4)}", f"{digits(1)},{digits(3)},{digits(3)}",
                f"97{rng.choice('89')}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(2)}-{digits(5)}", f"#{digits(6)}", f"{digits(4)}-{digits(6)}-{digits(2)}", f"{digits(2)} dot {word()}", f"meet at {digits(2)}",
            ]
        )

    while len(text) < TRAIN_LENGTH:
        r = rng.random()
        if r < 0.36:
            kind = rng.randrange(4)
            value = (email, ip, card, phone)[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        elif r < 0.64:
            text += likeness()
        else:
            text += " ".join(word() for _ in range(rng.randint(1, 4)))
        text += rng.choice([" ", " ", " ", ", ", ". ", "\n", ": ", "### ", " | "])
    return text, spans


def label_row(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        if start < length:
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


@lru_cache(maxsize=2)
def train(seed: int = 7, steps: int = TRAIN_STEPS) -> Tagger:
    """A tagger trained by Adam on made-up labelled spans; the same for the same arguments."""
    rng, net = random.Random(seed), new_tagger(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        rows = [_example(rng) for _ in range(TRAIN_BATCH)]
        symbols = np.stack([symbols_of(text[:TRAIN_LENGTH]) for text, _ in rows])
        labels = np.stack([label_row(TRAIN_LENGTH, spans) for _, spans in rows])
        _, gradients = train_step(net, symbols, labels)
        norm = np.sqrt(sum((g * g).sum() for g in gradients))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), gradients, first, second):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _window_starts(length: int) -> np.ndarray:
    if length <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, length - WINDOW, STRIDE), length - WINDOW)


#: Windows that go through the network at a time. There are always as many, so that a window's figures don't depend on its neighbours.
BATCH = 384
#: Of these, as many at a time through the LSTM, as its gates for whole windows lie in memory.
LSTM_BATCH = 96
#: Characters whose posteriors are held at a time.
PART = 1 << 19
#: Posteriors are floored at ``FLOOR`` for decoding: no place is worth more than ``LEAD``, so what gains more by being outside is outside.
FLOOR, LEAD = 1e-9, 21.0
#: A place is quiet if the posterior of all spans is at most ``QUIET`` in every window. No span goes over ``PAD`` quiet places, as PAD * log((1 - QUIET) / QUIET) > LEAD.
QUIET, PAD = 0.1, 10


def _single(net: Tagger) -> tuple:
    """The network in single precision for :func:`posteriors`: a session that gives emission scores less that of the outside, and factors of moves."""
    moves, _ = _chain(net)
    model = lstm_graph(net.embed, net.gates, net.bias, net.out - net.out[:, :1], net.out_bias - net.out_bias[0])
    return session(model), np.exp(moves).astype(np.float32)


def posteriors(weights: tuple, symbols: np.ndarray) -> np.ndarray:
    """The posteriors ``[place, label, window]`` that :func:`_forward` and :func:`marginals` give for ``symbols[place, window]``, with windows side by side in memory."""
    network, moves = weights
    length, count = symbols.shape
    scores = np.empty((length, LABELS, count), np.float32)
    for k in range(0, count, LSTM_BATCH):
        (some,) = network.run(None, {"symbols": symbols[:, k : k + LSTM_BATCH].astype(np.int32, order="C")})
        scores[:, :, k : k + LSTM_BATCH] = some.swapaxes(1, 2)
    np.clip(scores, -30, 30, out=scores)
    np.exp(scores, out=scores)
    # Scaled at every second place, which single precision bears after the clip.
    ahead, total = np.empty_like(scores), np.empty((length, count), np.float32)
    a = scores[0]
    for t in range(length):
        if t:
            np.matmul(moves.T, ahead[t - 1], out=ahead[t])
            a = np.multiply(ahead[t], scores[t], out=ahead[t])
        if t % 2 == 0 or t == length - 1:
            a.sum(0, out=total[t])
            np.divide(a, total[t], out=ahead[t])
    b = np.ones_like(a)
    for t in range(length - 2, -1, -1):
        scores[t + 1] *= b
        np.matmul(moves, scores[t + 1], out=b)
        if (t + 1) % 2 == 0 or t + 1 == length - 1:
            b /= total[t + 1]
        ahead[t] *= b
    return ahead


def _groups(lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Texts, long ones in parts, as ``(text, start, end)`` in groups of about ``PART`` characters."""
    group, size = [], 0
    for i, n in enumerate(lengths):
        for a in range(0, n, PART):
            b = min(n, a + PART)
            group.append((i, a, b))
            size += max(b - a, WINDOW)
            if size >= PART:
                yield group
                group, size = [], 0
    if group:
        yield group


def _beliefs(weights: tuple, codes: list[np.ndarray], group: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each part of the group the places at most ``PAD`` from one that isn't quiet, and their mean posteriors.

    All windows that touch the part are read whole. Where they overlap their posteriors are
    averaged, places near a window's middle weighing more.
    """
    at, first, laid, windows = 0, [], [], []
    for i, a, b in group:
        starts = _window_starts(len(codes[i]))
        starts = starts[(starts < b + PAD) & (starts + WINDOW > a - PAD)]
        lo, hi = int(starts[0]), min(len(codes[i]), int(starts[-1]) + WINDOW)
        first.append(at - lo)
        laid.append((at, codes[i][lo:hi]))
        windows.append(starts + (at - lo))
        at += max(hi - lo, WINDOW) + PAD
    flat, real = np.full(at, _ALPHABET.index(" "), np.uint8), np.zeros(at, bool)
    for place, own in laid:
        flat[place : place + len(own)] = own
        real[place : place + len(own)] = True
    starts = np.concatenate(windows)
    count = len(starts)
    starts = np.append(starts, np.zeros(-count % BATCH, np.int64))
    loud, kept = np.zeros(at, bool), []
    steps = np.arange(WINDOW)[:, None]
    for k in range(0, len(starts), BATCH):
        places = starts[k : k + BATCH] + steps
        found = posteriors(weights, flat[places])
        loud[places[found[:, 0] < 1 - QUIET]] = True
        kept.append((places[:, : count - k], found))
    loud &= real
    near = loud.copy()
    for d in range(1, PAD + 1):
        near[d:] |= loud[:-d]
        near[:-d] |= loud[d:]
    near &= real
    number, shown = np.cumsum(near) - 1, np.flatnonzero(near)
    belief, weight = np.zeros((len(shown), LABELS)), np.zeros(len(shown))
    ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
    for places, found in kept:
        t, w = np.nonzero(near[places])
        rows = number[places[t, w]]
        np.add.at(belief, rows, found[t, :, w] * ramp[t, None])
        np.add.at(weight, rows, ramp[t])
    belief /= weight[:, None]
    for (i, a, b), offset in zip(group, first):
        x, y = np.searchsorted(shown, [a + offset, b + offset])
        yield i, shown[x:y] - offset, belief[x:y]


def best_labels(belief: list[np.ndarray]) -> list[np.ndarray]:
    """The most likely lawful label sequence for each ``belief[place, label]``, those of like length side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(belief)
    order = sorted(range(len(belief)), key=lambda k: len(belief[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(belief[order[end]]) <= 2 * len(belief[order[at]]) and len(belief[order[end]]) * (end + 1 - at) <= PART // 8:
            end += 1
        some, at = order[at:end], end
        length = len(belief[some[-1]])
        score = np.full((length, LABELS, len(some)), -1e4)
        score[:, 0] = 0
        for n, k in enumerate(some):
            score[: len(belief[k]), :, n] = np.log(belief[k] + FLOOR)
        best = score[0].copy()
        best[2::2] = -1e4
        # Whatever a label inside its kind does not follow, the best of all labels precedes.
        top, goes_on = np.empty((length, len(some)), np.int64), np.empty((length, len(KINDS), len(some)), bool)
        for t in range(1, length):
            best.argmax(0, out=top[t])
            np.greater_equal(best[2::2], best[1::2], out=goes_on[t])
            own = np.maximum(best[2::2], best[1::2])
            best = best.max(0) + score[t]
            np.add(own, score[t, 2::2], out=best[2::2])
        labels, rows = np.empty((length, len(some)), np.int64), np.arange(len(some))
        labels[-1] = best.argmax(0)
        for t in range(length - 1, 0, -1):
            now = labels[t]
            inside = (now > 0) & (now % 2 == 0)
            labels[t - 1] = np.where(inside, now - ~goes_on[t, np.maximum(now - 1, 0) // 2, rows], top[t])
        for n, k in enumerate(some):
            out[k] = labels[: len(belief[k]), n]
    return out


def _decoded(belief: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """:func:`best_labels` of each stretch of places.

    In a run of places that are likeliest outside, a span that comes from before the run and goes
    on to a place loses the lead of the places before it to a span that begins there, if that lead
    is more than beginning there costs; likewise a span that goes on behind the run. A place where
    both hold is outside in the best sequence, so stretches fall apart there. Where the likeliest
    labels of a piece are lawful as they are, they are its best sequence.
    """
    labels = belief.argmax(1)
    lead = np.log(belief[:, 0] + FLOOR) - np.log(belief[:, 1:].max(1) + FLOOR)
    cost = np.log(((belief[:, 2::2] + FLOOR) / (belief[:, 1::2] + FLOOR)).max(1)) + 1e-6
    ahead = lead > 0
    sums = np.cumsum(np.where(ahead, lead, 0.0))
    before = sums - np.where(ahead, lead, 0.0)
    opens, closes = np.zeros(len(labels), bool), np.zeros(len(labels), bool)
    opens[starts], closes[np.append(starts[1:], len(labels)) - 1] = True, True
    left = before - np.maximum.accumulate(np.where(ahead, np.where(opens, before, 0.0), sums))
    right = np.minimum.accumulate(np.where(ahead & ~closes, np.inf, sums)[::-1])[::-1] - sums
    behind = np.minimum.accumulate(np.where(ahead & ~closes, len(labels), np.arange(len(labels)))[::-1])[::-1]
    sure = np.flatnonzero(ahead & (left > np.maximum(cost, 0)) & (ahead[behind] | (right > np.maximum(cost, 0)[behind])))
    starts = np.unique(np.concatenate([starts, sure, sure[sure + 1 < len(labels)] + 1]))
    lawful = np.append(True, allowed_moves()[labels[:-1], labels[1:]])
    lawful[starts] = (labels[starts] == 0) | (labels[starts] % 2 == 1)
    ends = np.append(starts[1:], len(belief))
    pieces = [slice(starts[k], ends[k]) for k in np.unique(np.searchsorted(starts, np.flatnonzero(~lawful), "right") - 1)]
    for piece, own in zip(pieces, best_labels([belief[p] for p in pieces])):
        labels[piece] = own
    return labels


def tag_zones(net: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans of each text. Every character is read, in overlapping windows that are decoded to label
    posteriors and averaged; one global decoding of the text's averages reconciles them.

    The decoding is that of the whole text: places further than ``PAD`` from any that isn't quiet
    are outside in the best sequence, so only the others are gone through.
    """
    weights = _single(net)
    codes = [symbols_of(t).astype(np.uint8) for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    texts_of: list[np.ndarray] = []
    places: list[np.ndarray] = []
    belief: list[np.ndarray] = []
    groups = list(_groups([len(c) for c in codes]))
    for group in groups:
        for i, where, what in _beliefs(weights, codes, group):
            texts_of.append(np.full(len(where), i))
            places.append(where)
            belief.append(what)
        last, _, end = group[-1]
        if group is not groups[-1] and (end < len(codes[last]) or sum(map(len, places)) < PART):
            continue
        of, where, what = np.concatenate(texts_of), np.concatenate(places), np.concatenate(belief)
        texts_of, places, belief = [], [], []
        if not len(of):
            continue
        starts = np.flatnonzero(np.append(True, (np.diff(where) != 1) | (np.diff(of) != 0)))
        labels = _decoded(what, starts)
        begins = np.flatnonzero(labels % 2 == 1)
        # A span ends before the next label that doesn't go on, or with its stretch.
        stops = np.sort(np.concatenate([np.flatnonzero((labels == 0) | (labels % 2 == 1)), starts, [len(labels)]]))
        ends = stops[np.searchsorted(stops, begins, "right")] - 1
        for i, label, a, b in zip(of[begins].tolist(), labels[begins].tolist(), where[begins].tolist(), where[ends].tolist()):
            out[i].append(((label - 1) // 2, a, b + 1))
    return out


_AT, _DOT = r"(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| at )", r"(?: ?\. ?| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )"
_WRITTEN_EMAIL = re.compile(rf"[\w.%+-]+(?:{_DOT}[\w-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.IGNORECASE)
_WRITTEN_DOT = re.compile(_DOT, re.IGNORECASE)


def _plausible(kind: int, text: str) -> bool:
    """What a span of the network must say: an at sign and a dot, four numbers below 256, or enough digits, of a card with the right check digit."""
    if kind == 0:
        return bool(_WRITTEN_EMAIL.fullmatch(text))
    if kind == 1:
        parts = _WRITTEN_DOT.split(text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = _NOT_DIGIT.sub("", text)
    if any(c.isalpha() for c in text):
        return False
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def find_spans(net: Tagger, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its rule spans, and all spans: the rules', and the network's that touch none of them.

    A span of the network counts if its characters are those of its kind and no letter or digit
    continues it. Null and empty texts have none. Offsets are code points, the end exclusive.
    """
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    work = [i for i, text in enumerate(texts) if text]
    for i, spans in zip(work, tag_zones(net, [texts[i] for i in work])):
        text, base = texts[i], base_spans(texts[i])
        out[i] = (base, base)
        more = []
        taken = bytearray(len(text) if spans else 0)
        for _, x, y in base if spans else ():
            taken[x:y] = b"\1" * (y - x)
        for kind, s, e in spans:
            while s < e and text[s] in " \n":
                s += 1
            while s < e and text[e - 1] in " \n.,-":
                e -= 1
            alone = not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
            if s < e and alone and _plausible(kind, text[s:e]) and not any(taken[s:e]):
                more.append((kind, s, e))
        if more:
            out[i] = (base, sorted([*base, *more]))
    return out


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or group of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, text_col: str = "text", seed: int = 7) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone`` (rule spans), ``base_sha256`` and ``spans``.

    ``spans`` lists ``kind:start:end`` of rule and network spans by kind, as in ``KINDS``, and
    start; ``base_sha256`` is the hash of that list for the rule spans. Columns of these names
    are replaced, others kept. A null text counts as empty; long texts are searched whole;
    repeated rows get the same answer each; an empty table gives no rows.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(seed))

    @F.arrow_udf("struct<n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string>")
    def run(column: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        for at in range(0, len(column), 1024):
            for base, spans in find_spans(net.value, column[at : at + 1024].to_pylist()):
                counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(spans)))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    own = spare(docs, "personal_data")
    found = docs.withColumn(own, run.asNondeterministic()(F.col(text_col)))
    return found.withColumns({c: F.col(f"{own}.{c}") for c in names}).drop(own)


def redact_personal_data(docs: DataFrame, text_col: str = "text", seed: int = 7) -> DataFrame:
    """``docs`` with every span of personal data in the text replaced by its kind in brackets; null stays null."""
    net = docs.sparkSession.sparkContext.broadcast(train(seed))

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        for at in range(0, len(column), 1024):
            part = column[at : at + 1024]
            values = part.to_pylist()
            found = find_spans(net.value, values)
            if any(spans for _, spans in found):
                part = pa.array([redact(v, spans) if spans else v for v, (_, spans) in zip(values, found)], column.type)
            out.append(part)
        return pa.concat_arrays(out) if out else column

    return docs.withColumn(text_col, run(F.col(text_col)))


def op7_pii(spark, sf_dir):
    """Personal data in all ``documents``, by :func:`find_personal_data`."""
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

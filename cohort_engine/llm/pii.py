"""Personal data: fixed patterns, and a character tagger trained on what they find and on forms they miss."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.windows import first_k
from .common import keyed, over_texts, ship

KINDS = ("email", "ip", "card", "phone")
# The patterns, each applied where a match of it can begin.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
ANCHOR = re.compile(r"[0-9@]")

SPLIT = re.compile(r"[0-9]+[\x20().-]+[0-9][\x20().0-9-]*[0-9]")  # digits in groups

WINDOW, STEP = 96, 48  # characters of a window, and from one to the next
TRAIN_DOCS = 8_000  # documents that training windows are taken from, about
TRAIN_WINDOWS = 200  # windows a kind (and without any) that are trained on, at most
# Forms that training windows are made with; # is any digit. The first two kinds have no pattern.
FORMS = {3: ("(###) ###-####", "###-###-####", "0### ### ####", "###.###.####", "0## #### ####", "(0###) ######"),
         2: ("####.####.####.####",)}
OTHERS = ("####-##-##", "##.##.####", "##/##/####", "####-####", "#,###,###", "##:##:##", "###.##", "#.#.##", "## ###", "#### ####")
SURE = 0.5  # least probability of each tag of an added span


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the patterns' matches, and of matches that a check refused.

    Matches are the leftmost that do not overlap, for each kind. An address can only begin
    at the start of the characters before its @, a number only at the start of its digits or
    its plus, so only these places are tried, each once.
    """
    found, refused = [], []
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            after = m.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", after)
    next_ip = next_card = 0
    for run in DIGITS.finditer(text):
        start = run.start()
        if start >= next_ip and (m := IP.match(text, start)):
            next_ip = m.end()
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (found if ok else refused).append((start, 1, next_ip))
        if start >= next_card and (m := CARD.match(text, start)):
            next_card = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            (found if 14 <= len(digits) <= 19 and luhn(digits) else refused).append((start, 2, next_card))
    after, at = 0, text.find("+")
    while at >= 0:
        after = at + 1
        if m := PHONE.match(text, at):
            after = m.end()
            ok = 10 <= sum(c.isdigit() for c in m[0]) <= 15
            (found if ok else refused).append((at, 3, after))
        at = text.find("+", after)
    return sorted(found), refused


LETTERS = 128  # code of any character outside ASCII


def codes(text: str) -> np.ndarray:
    """Code of each character: itself in ASCII (0 is free for padding), else one for all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, np.maximum(points, 1), LETTERS).astype(np.uint8)


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an @. Every span of every kind
    has one, so no other window can hold a span that begins and ends in it."""
    places = {m.start() // STEP for m in ANCHOR.finditer(text)}
    return sorted({max(0, p + d) * STEP for p in places for d in (-1, 0)})


def cut_windows(text: str, starts: list[int]) -> np.ndarray:
    all_codes = np.concatenate([codes(text), np.zeros(WINDOW, np.uint8)])
    return all_codes[np.asarray(starts)[:, None] + np.arange(WINDOW)] if starts else np.zeros((0, WINDOW), np.uint8)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """A bidirectional LSTM over characters with a CRF over the tags outside, begin and inside of
    each kind. Windows are rows of character codes; arrays run over time first."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, size: int = 16, hidden: int = 24, seed: int = 3):
        draw = np.random.default_rng(seed)

        def start(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.hidden = hidden
        self.p = {"embed": start(LETTERS + 1, size), "out": start(2 * hidden, self.TAGS), "bias": np.zeros(self.TAGS, np.float32),
                  "step": np.zeros((self.TAGS, self.TAGS), np.float32)}
        for side in "fb":
            self.p |= {"x" + side: start(size, 4 * hidden), "h" + side: start(hidden, 4 * hidden), "b" + side: np.zeros(4 * hidden, np.float32)}
            self.p["b" + side][hidden:2 * hidden] = 1
        self.refuse = np.zeros((self.TAGS, self.TAGS), np.float32)  # steps into a tag inside that continue nothing
        for to in range(2, self.TAGS, 2):
            self.refuse[[i for i in range(self.TAGS) if i not in (to, to - 1)], to] = -1e4

    def lstm(self, x, side, keep=False):
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, pre = h, x @ self.p["x" + side] + self.p["b" + side]
        out, kept = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ self.p["h" + side]
            gates, g = sigmoid(z[:, :3 * n]), np.tanh(z[:, 3 * n:])
            before, c = (h, c), gates[:, n:2 * n] * c + gates[:, :n] * g
            tc = np.tanh(c)
            h = gates[:, 2 * n:] * tc
            out[t] = h
            if keep:
                kept.append((gates, g, *before, tc))
        return out, kept

    def lstm_back(self, x, d_out, side, kept, grad):
        n, w = self.hidden, self.p["h" + side]
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        dz_all = np.empty((*x.shape[:2], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            gates, g, h0, c0, tc = kept[t]
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad["h" + side] += h0.T @ dz
            dh, dc = dz @ w.T, dc * f
        flat = dz_all.reshape(-1, 4 * n)
        grad["x" + side] += x.reshape(-1, x.shape[2]).T @ flat
        grad["b" + side] += flat.sum(0)
        return dz_all @ self.p["x" + side].T

    def scores(self, windows, keep=False):
        x = self.p["embed"][windows.T]
        f, kf = self.lstm(x, "f", keep)
        b, kb = self.lstm(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (x, both, kf, kb)

    def marginals(self, e):
        """Probability of each tag, and summed expected steps: forward and backward sums,
        scaled to one at each place."""
        weight, step, n = np.exp(e - e.max(2, keepdims=True)), np.exp(self.p["step"] + self.refuse), len(e)
        weight[0, :, 2::2] = 0
        a, b, scale = np.empty_like(weight), np.ones_like(weight), np.empty((*weight.shape[:2], 1), weight.dtype)
        for t in range(n):
            a[t] = weight[t] if t == 0 else (a[t - 1] @ step) * weight[t]
            scale[t] = a[t].sum(1, keepdims=True)
            a[t] /= scale[t]
        ahead = weight / scale
        for t in range(n - 2, -1, -1):
            b[t] = (b[t + 1] * ahead[t + 1]) @ step.T
        tags = self.TAGS
        return a * b, step * (a[:-1].reshape(-1, tags).T @ (b[1:] * ahead[1:]).reshape(-1, tags))

    def best(self, e):
        """The most likely tags (Viterbi)."""
        step, n = self.p["step"] + self.refuse, len(e)
        v, back = e[0].copy(), np.empty(e.shape, np.int8)
        v[:, 2::2] -= 1e4
        for t in range(1, n):
            s = v[:, :, None] + step
            back[t] = s.argmax(1)
            v = s.max(1) + e[t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[-1] = v.argmax(1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), 1)[:, 0]
        return tags.T

    def gradient(self, windows, tags):
        e, (x, both, kf, kb) = self.scores(windows, keep=True)
        p, steps = self.marginals(e)
        gold, n = tags.T, windows.shape[0]
        d = p
        np.put_along_axis(d, gold[:, :, None], np.take_along_axis(d, gold[:, :, None], 2) - 1, 2)
        np.subtract.at(steps, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["step"] = steps
        grad["out"], grad["bias"] = both.reshape(-1, both.shape[2]).T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))
        back = d @ self.p["out"].T
        dx = self.lstm_back(x, back[:, :, :self.hidden], "f", kf, grad)
        dx = dx + self.lstm_back(x[::-1], back[::-1, :, self.hidden:], "b", kb, grad)[::-1]
        np.add.at(grad["embed"], windows.T, dx)
        return {k: g / n for k, g in grad.items()}

    def fit(self, windows, tags, rounds: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 5):
        draw, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for r in range(rounds):
            order = draw.permutation(len(windows))
            for at in range(0, len(order), batch):
                t += 1
                some = order[at:at + batch]
                for k, g in self.gradient(windows[some], tags[some]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate / (1 + r / 4) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
        return self

    def spans(self, windows, batch: int = 256) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of the spans in each window, whose tags are all SURE."""
        out = []
        for at in range(0, len(windows), batch):
            e, _ = self.scores(windows[at:at + batch])
            tags = self.best(e)
            some = np.flatnonzero(tags.any(1))
            sure = {}
            if len(some):
                p, _ = self.marginals(e[:, some])
                sure = {w: p[:, k] for k, w in enumerate(some)}
            for w, row in enumerate(tags):
                got, start = [], None
                for t, tag in enumerate([*row.tolist(), 0] if w in sure else []):
                    if start is not None and tag != row[start] + 1:
                        if min(sure[w][k, row[k]] for k in range(start, t)) >= SURE:
                            got.append((start, (int(row[start]) - 1) // 2, t))
                        start = None
                    if tag % 2:
                        start = t
                out.append(got)
        return out


def tagged(text: str, spans: list[tuple[int, int, int]], starts: list[int]) -> np.ndarray:
    """Tags of the windows of a text; of spans that overlap, the first counts."""
    tags, end = np.zeros(len(text) + WINDOW, np.uint8), 0
    for start, kind, stop in spans:
        if start >= end:
            tags[start:stop], tags[start], end = 2 + 2 * kind, 1 + 2 * kind, stop
    out = tags[np.asarray(starts)[:, None] + np.arange(WINDOW)]
    cut = (out[:, 0] > 0) & (out[:, 0] % 2 == 0)  # a span that began before the window begins with it
    for w in np.flatnonzero(cut):
        out[w, 0] -= 1
    return out


def varied(windows: np.ndarray, tags: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The windows, and once more with other digits and with phone numbers that lack the
    country code, so that the tagger learns forms rather than numbers."""
    draw, windows_2, tags_2 = np.random.default_rng(seed), windows.copy(), tags.copy()
    digits = (windows_2 >= 48) & (windows_2 < 58)
    windows_2[digits] = draw.integers(48, 58, digits.sum())
    for w in np.flatnonzero((tags_2 == 7).any(1)):
        row, tag = windows_2[w], tags_2[w]
        start = int(np.flatnonzero(tag == 7)[0])
        gap = next((t for t in range(start, WINDOW - 1) if row[t] == 32 and tag[t] == 8), None)
        if gap is not None:
            n = gap + 1 - start
            row[start:] = np.append(row[gap + 1:], np.zeros(n, np.uint8))
            tag[start:] = np.append(tag[gap + 1:], np.zeros(n, np.uint8))
            tag[start] = 7
    return np.concatenate([windows, windows_2]), np.concatenate([tags, tags_2])


def filled(form: str, kind: int, draw) -> str:
    """A form with random digits; those of a card pass its check."""
    while True:
        text = "".join(str(draw.integers(10)) if c == "#" else c for c in form)
        if kind != 2 or luhn("".join(c for c in text if c.isdigit())):
            return text


def put(window: np.ndarray, tags: np.ndarray, start: int, stop: int, text: str, kind: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The window with `text` in the place of [start, stop), tagged as a span of `kind` or as none."""
    own = np.zeros(len(text), tags.dtype)
    if kind is not None:
        own[:], own[0] = 2 + 2 * kind, 1 + 2 * kind
    row = np.concatenate([window[:start], codes(text), window[stop:], np.zeros(WINDOW, np.uint8)])[:WINDOW]
    return row, np.concatenate([tags[:start], own, tags[stop:], np.zeros(WINDOW, tags.dtype)])[:WINDOW]


def made(windows: np.ndarray, tags: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows of forms that the patterns miss.

    Each form of FORMS takes the place of the pattern's span in windows of its kind, and stands
    between the words of windows without a span; there OTHERS, dates and other numbers, stand as none.
    """
    draw, out = np.random.default_rng(seed), []
    first = {kind: [(w, int(np.flatnonzero(t == 1 + 2 * kind)[0])) for w, t in enumerate(tags) if (t == 1 + 2 * kind).any()] for kind in FORMS}
    plain = [w for w, t in enumerate(tags) if not t.any() and (windows[w] == 32).any()]
    for kind, forms in FORMS.items():
        for form in forms:
            for w, start in (first[kind][i] for i in draw.permutation(len(first[kind]))[:TRAIN_WINDOWS // 4]):
                stop = start + 1 + int(np.argmax(np.append(tags[w][start + 1:] != 2 + 2 * kind, True)))
                out.append(put(windows[w], tags[w], start, stop, filled(form, kind, draw), kind))
    for kind, form in [(k, f) for k, forms in FORMS.items() for f in forms] + [(None, f) for f in OTHERS]:
        for i in draw.integers(len(plain), size=TRAIN_WINDOWS // (5 if kind is None else 1) if plain else 0):
            window = windows[plain[i]]
            spaces = np.flatnonzero(window == 32) + 1
            if draw.integers(2):  # a text that begins a few words before
                window = np.append(window[draw.choice(spaces):], np.zeros(WINDOW, np.uint8))[:WINDOW]
                spaces = np.flatnonzero(window == 32)[:8] + 1
            start = int(draw.choice(spaces)) if len(spaces) else 0
            out.append(put(window, tags[plain[i]], start, start, filled(form, kind, draw) + draw.choice([" ", ", ", ". "]), None))
            if kind is not None:
                stop = min(WINDOW, start + len(form))
                out[-1][1][start:stop] = 2 + 2 * kind
                out[-1][1][start:start + 1] = 1 + 2 * kind
    if not out:
        return windows[:0], tags[:0]
    return np.stack([w for w, _ in out]), np.stack([t for _, t in out])


def unclear(window: np.ndarray, tags: np.ndarray) -> bool:
    """Whether a window holds digits in groups that may be a phone or card number in a form without
    a pattern. To train on it would teach that such forms are none."""
    rest = np.where(tags > 0, ord("x"), window).astype(np.uint8).tobytes().decode("latin-1")
    return any(7 <= sum(c.isdigit() for c in m[0]) <= 19 for m in SPLIT.finditer(rest))


def train(docs: DataFrame) -> Tagger | None:
    """Fit on windows of about TRAIN_DOCS documents (of `keyed`), chosen by a hash, that hold a
    digit or an @. Labels are the patterns' spans and those of the forms put in their place; unclear
    windows are left out.

    One pass reads the documents. A task gives the TRAIN_WINDOWS windows of least hash a kind, and as
    many without a span, and of all tasks' these the same come to the driver, as codes. None if there are none.
    """
    share = min((1 << 62) - 1, int((1 << 62) * TRAIN_DOCS / max(docs.count(), 1)))

    def scan(batches):
        best: dict[int, dict] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                starts = window_starts(text)
                for w, t in zip(cut_windows(text, starts), tagged(text, base_spans(text)[0], starts)):
                    if not unclear(w, t):
                        own = best.setdefault(int(t.max() + 1) // 2, {})
                        own[hashlib.blake2b(w.tobytes(), digest_size=8).hexdigest()] = w.tobytes(), t.tobytes()
            for kind, own in best.items():
                best[kind] = dict(sorted(own.items())[:TRAIN_WINDOWS])
        rows = [(h, kind, *x) for kind, own in best.items() for h, x in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                                             ["h", "kind", "codes", "tags"])

    ship(docs.sparkSession)
    draw = F.xxhash64(F.lit("pii"), "k_id", "k_text").bitwiseAND((1 << 62) - 1)
    some = docs.filter(draw <= share).select("text").filter(F.col("text").rlike(ANCHOR.pattern))
    found = some.mapInArrow(scan, "h string, kind int, codes binary, tags binary").dropDuplicates(["kind", "h"])
    rows = sorted(first_k(found, "kind", ["h"], TRAIN_WINDOWS).collect(), key=lambda r: (r["kind"], r["h"]))
    if not rows:
        return None
    windows, tags = (np.stack([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("codes", "tags"))
    both = [varied(windows, tags.astype(np.int64)), made(windows, tags.astype(np.int64))]
    return Tagger().fit(*(np.concatenate(x) for x in zip(*both)))


def plausible(text: str, kind: int) -> bool:
    digits = sum(c in "0123456789" for c in text)
    if kind == 2 and not luhn("".join(c for c in text if c in "0123456789")):
        return False
    return ("@" in text[1:-1] if kind == 0 else text.count(".") == 3 and digits >= 4 if kind == 1
            else 14 <= digits <= 19 if kind == 2 else 9 <= digits <= 15)


def reconcile(text: str, starts: list[int], found: list[list[tuple[int, int, int]]], base, refused) -> list[tuple[int, int, int]]:
    """One list of spans from those of overlapping windows.

    A span that touches the edge of a window is joined with the same kind's spans over it from
    the next window. Longer spans go before shorter, then earlier ones; what overlaps a span
    that went before or a pattern's match is left out, and so is a match that a check of the
    same kind refused. A run of digits that is no card may still be a phone number.
    """
    pieces = sorted((s + at, k, e + at, s == 0 and at > 0, e == WINDOW and at + e < len(text))
                    for at, spans in zip(starts, found) for s, k, e in spans)
    joined: list[list] = []
    for s, k, e, left, right in pieces:
        for other in joined[-4:]:
            if other[1] == k and s < other[2] and (left or right or other[3] or other[4] or (s, e) == (other[0], other[2])):
                other[2], other[4] = max(other[2], e), right if e >= other[2] else other[4]
                break
        else:
            joined.append([s, k, e, left, right])
    taken, wrong, out = [(s, e) for s, _, e in base], set(refused), []
    for s, k, e, left, right in sorted(joined, key=lambda x: (x[0] - x[2], x[0])):
        if not left and not right and e <= len(text) and (s, k, e) not in wrong and plausible(text[s:e], k) and all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            out.append((s, k, e))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_email`, `n_ip`, `n_card`, `n_phone` (matches of the patterns), `base` (these
    matches as kind:start:end), `spans` (they and the tagger's), `n_added` per row.

    Positions are code points, ends exclusive. A null text counts as empty. Rows are
    independent, so repeated ones get equal answers, and rows of a null id are rows like any other. Of the
    tagger's spans that overlap, the longest stays, then the first. Whole texts are searched in overlapping
    windows; other columns are not read and an empty table gives no rows.
    """
    texts = keyed(docs, id_col, text_col)
    model = train(texts)

    def scan(batch):
        texts = [t or "" for t in batch.column(3).to_pylist()]
        base = [base_spans(t) for t in texts]
        starts = [window_starts(t) if model is not None else [] for t in texts]
        windows = np.concatenate([cut_windows(t, s) for t, s in zip(texts, starts)])
        found, at, rows = model.spans(windows) if model is not None else [], 0, []
        for t, (b, refused), s in zip(texts, base, starts):
            more = reconcile(t, s, found[at:at + len(s)], b, refused) if s else []
            at += len(s)
            rows.append((*(sum(k == kind for _, k, _ in b) for kind in range(len(KINDS))), listed(b), listed([*b, *more]), len(more)))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]),
                                          pa.array(columns[5]), pa.array(columns[6], pa.int64())],
                                         ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"])

    return over_texts(texts, scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")

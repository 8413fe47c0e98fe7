"""A linear-chain conditional random field in numpy: features of token shapes, training by gradient, Viterbi in batches.

Texts are laid end to end with marks between them, cut into tokens by one regular expression, and each different token is looked
at once: what it contributes to the scores of labels, at each place around a position, is a row of a table. Scores of a batch are
sums of rows; the best paths of all its lines are found together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Blanks before it, and letters, digits, a line end or a sign: every character is in one token, but for blanks at the end.
TOKEN = re.compile(r"[^\S\n]*(?:[^\W\d_]+|\d+|\n|[^\w\s]|_)")
REACH, CHUNK_REACH = 4, 2
#: Tokens of a line that are decoded as one sequence; a longer line is cut after sentences.
LONG = 4096
_EDGE = "\x00"
_BETWEEN = " " + f"{_EDGE} " * REACH

# Words that tell the parts of addresses and names, and words that often stand beside details or things alike.
STREETS = set("street st road rd lane ln avenue ave boulevard blvd drive dr way close court ct terrace place pl square crescent row hill gardens grove walk mews parade highway parkway".split())
SHORT_STREETS = set("st rd ave blvd ln ct pl dr".split())
UNITS = set("flat apt apartment unit suite room floor".split())
TITLES = set("mr mrs ms miss dr prof professor sir dame lady lord rev captain".split())
PARTICLES = set("van von de der den del della di da la le du bin ibn al ter ten mac o".split())
WORDS = {
    "street": STREETS, "short": SHORT_STREETS, "unit": UNITS, "title": TITLES, "particle": PARTICLES,
    "phone": set("phone telephone tel mobile mob cell fax call calls called calling ring rang rings dial dialled text texted sms whatsapp hotline helpline number line".split()),
    "mail": set("email mail e inbox mailto cc write contact reply account".split()),
    "identity": set("id passport identity ssn social security insurance ni national tax taxpayer licence license card document visa nino".split()),
    "thing": set("order invoice receipt consignment isbn issn doi serial flight train bus ticket raffle lottery draw case docket version build release commit model part article sku stock asset barcode tracking track parcel shipment pallet booking reservation ref reference policy claim membership customer voucher coupon permit plate chassis engine plot lot batch sample survey code pin meter sensor container file catalogue patent standard route channel frequency port chapter volume vol page pages gate platform seat version item grid form notice contract project section edition reading readings score error bond warrant bill".split()),
    "body": set("council trust union society chamber board guild institute office association authority agency university college bank party commission ministry federation orchestra company group club committee foundation services partners media ltd limited inc plc bakery sons prize cup trophy award gazette times post ledger herald".split()),
    "team": set("united rovers city town wanderers athletic rangers fc albion county hotspur".split()),
    "vessel": set("ferry ship boat trawler tug yacht steamer lifeboat vessel barge freighter tanker ss mv hms storm hurricane horse aboard docked sank sailed passengers voyage".split()),
    "place": set("park bridge hall hospital school library museum stadium market airport bay valley island lake river mount port fort theatre church cathedral centre memorial wing academy clinic arena pavilion ward garden house estate college station hotel harbour pier abbey castle farm beach forest north south east west upper lower great little new old saint".split()),
    "say": set("said says told asked added warned wrote named called according met thanked knows spoke replied".split()),
    "kin": set("mother father brother sister aunt uncle cousin son daughter wife husband neighbour friend driver owner tenant teacher nurse mayor judge coach officer spokesman spokeswoman plumber suspect victim witness patient attn c dear signed regards".split()),
    "common": set(
        "a an the this that these those all any both each every few many more most much no none other some such several own same i you he she it we they me him her us them my your his its our their who whom whose which what when where why how "
        "be am is are was were been being have has had having do does did done doing will would can could may might must shall should not nor and or but if because as until while of at by for with about against between into through during "
        "before after above below to from up down in out on off over under again further then once here there than too very just also still yet already ever never always often sometimes soon later earlier since within without across along "
        "around behind beside beyond near next per via one two three four five six seven eight nine ten first second third last another early late go goes went gone come comes came get gets got make makes made take takes took give gives gave "
        "see sees saw seen know knew think thinks thought want wants need needs seem seems remain remains become becomes became keep keeps leave leaves left put set say find finds found new old good bad big small long short high low people man woman day year week month time way today yesterday tomorrow".split()
    ),
    "when": set("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()),
}
_CHUNK = [
    ("url", re.compile(r"[<(\"“]*(?:https?://|www\.)", re.I)),
    ("handle", re.compile(r"[(\"“.]*@\w")),
    ("hash", re.compile(r"[(\"“]*#\w")),
    ("mail", re.compile(r"\S*[\w.+-]@[\w-]+\.\w")),
    ("at", re.compile(r"[(\[{<]\s*at\s*[)\]}>]", re.I)),
    ("dot", re.compile(r"[(\[{<]\s*dot\s*[)\]}>]", re.I)),
    ("long", re.compile(r"\W*[A-Za-z]{1,2}\d{6,}[A-Za-z]?\b")),
    ("code", re.compile(r"\W*[A-Za-z]{1,3}[-/]?\d{2,}")),
    ("thousands", re.compile(r"\W*\d{1,3}(?:,\d{3})+\b")),
    ("number", re.compile(r"\W*\d")),
    ("word", re.compile(r"\W*\w")),
]
CHUNK_TYPES = ["edge", "sign", *(n for n, _ in _CHUNK)]
#: Classes of runs: digits of a run of numbers and the signs in it; capitalised words in a row, and whether a sentence begins so.
#: The first token of a run has classes of its own.
N_DIGITS, N_CAPITALS = 34, 24
_IN_NUMBERS = set("()+-./‐‑–")
_IN_NAMES = set("-’'.")


def chunk_type(chunk: str) -> int:
    if chunk == _EDGE:
        return 0
    for name, pattern in _CHUNK:
        if pattern.match(chunk):
            return CHUNK_TYPES.index(name)
    return 1


class _Chunks(dict):
    def __missing__(self, chunk: str) -> int:
        k = chunk_type(chunk)
        if len(self) < 200_000:
            self[chunk] = k
        return k


def shape(tok: str) -> str:
    if tok.isdigit():
        return f"d{min(len(tok), 12)}"
    if tok[0].isalpha():
        s = "X" if tok.isupper() else "x" if tok.islower() else "Xx" if tok[0].isupper() else "xX"
        return s + (str(len(tok)) if len(tok) < 3 else "+")
    return "sign"


class Base:
    """Base features of a token by itself; known words are those that many sentences of the labelled table have beside details."""

    def __init__(self, known: Iterable[str], given: Iterable[str]):
        self.known, self.given = {w: None for w in known}, frozenset(given)
        self.index: dict[str, int] = {}
        self.fixed = False

    def names(self, tok: str) -> list[str]:
        if tok == _EDGE:
            return ["edge"]
        w = tok.lower()
        out = ["shape=" + shape(tok)]
        if tok[0].isalpha():
            out.append("letters")
            out += [what for what, group in WORDS.items() if w in group]
            case = shape(tok).rstrip("0123456789")
            if w in self.given:
                out += ["given", "given&" + case]
            elif w not in WORDS["common"]:
                out.append("other&" + case)
                if w in self.known:
                    out.append("given&known")
            if len(tok) > 1 and tok.isupper():
                out.append("capitals")
        elif tok.isdigit():
            out.append("digits")
            if tok[0] == "0":
                out.append("zero")
        else:
            out.append("sign=" + tok)
        if w in self.known:
            out.append("word=" + w)
        elif tok[0].isalpha():
            out.append("new" + ("&title" if tok[0].isupper() else ""))
        return out

    def ids(self, tok: str) -> tuple[int, ...]:
        if self.fixed:
            return tuple(self.index[n] for n in self.names(tok) if n in self.index)
        return tuple(self.index.setdefault(n, len(self.index)) for n in self.names(tok))


class Lexicon(dict):
    """Number of each different token (blanks before it included), and in columns what is known of it."""

    COLUMNS = ("length", "lead", "group", "edge", "line", "digits", "in_number", "capital", "in_name", "stop")

    def __init__(self, base: Base):
        super().__init__()
        self.base = base
        self.groups: dict[tuple[int, ...], int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((0, len(self.COLUMNS)), np.int32)

    def __missing__(self, part: str) -> int:
        tok = part.lstrip() or "\n"
        group = self.groups.setdefault(self.base.ids(tok), len(self.groups))
        letters = tok[0].isalpha()
        digits = len(tok) if tok.isdigit() else 0
        self.rows.append((
            len(part), len(part) - len(tok), group, tok == _EDGE, tok == "\n", digits, digits > 0 or tok in _IN_NUMBERS,
            letters and not tok[0].islower() and tok[0].lower() != tok[0], tok in _IN_NAMES or letters and tok.lower() in PARTICLES, tok in ".!?:;\n" or tok == _EDGE,
        ))
        self[part] = k = len(self.rows) - 1
        return k

    def columns(self) -> dict[str, np.ndarray]:
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int32)])
        return {c: self.table[:, k] for k, c in enumerate(self.COLUMNS)}


def _runs(on: np.ndarray, breaks: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place inside a run of `on` (which also ends before a break): the sum of `value` over it, and its first place."""
    first = on.copy()
    first[1:] &= ~on[:-1] | breaks[1:]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
    total = np.add.reduceat(np.where(on, value, 0), at)
    run = np.maximum(np.cumsum(first) - 1, 0)
    return np.where(on, total[run], 0), np.where(on, at[run], 0)


class Tokens:
    """The tokens of some texts: their places, groups and surroundings as arrays; `real` are those that aren't edges."""

    def __init__(self, texts: list[str], lexicon: Lexicon, chunks: _Chunks):
        clean = [t.replace(_EDGE, " ") for t in texts]
        joined = _BETWEEN + "".join(t + _BETWEEN for t in clean)
        parts = TOKEN.findall(joined)
        pid = np.fromiter(map(lexicon.__getitem__, parts), np.int64, len(parts))
        c = {k: v[pid] for k, v in lexicon.columns().items()}
        edge, line = c["edge"] > 0, c["line"] > 0
        end = np.cumsum(c["length"], dtype=np.int64)
        size = np.fromiter(map(len, clean), np.int64, len(clean))
        start = len(_BETWEEN) + np.concatenate(([0], np.cumsum(size + len(_BETWEEN))))[:-1]
        self.text = (np.cumsum(edge) // REACH - 1).astype(np.int64)
        self.real = np.flatnonzero(~edge)
        self.end = end - start[np.clip(self.text, 0, max(0, len(start) - 1))] if len(start) else end
        self.begin = self.end - (c["length"] - c["lead"])
        spaced = c["lead"] > 0
        spaced[1:] |= line[:-1]
        spaced[0] = True
        after = np.concatenate((spaced[1:], [True]))
        self.space = spaced + 2 * after
        self.group = c["group"]
        opens = spaced & ~line
        types = np.fromiter(map(chunks.__getitem__, joined.split()), np.int64)
        self.chunk = np.cumsum(opens) - 1
        self.types = np.concatenate((np.zeros(CHUNK_REACH, np.int64), types, np.zeros(CHUNK_REACH, np.int64)))
        place = np.arange(len(pid))
        number, first = _runs(c["in_number"] > 0, line | edge | (c["lead"] > 1), c["digits"])
        self.digits = np.minimum(number, N_DIGITS // 2 - 1) * 2 + ((first == place) & (number > 0))
        capital = c["capital"] > 0
        inside = capital | (c["in_name"] > 0)
        words, first = _runs(inside, line | edge, capital.astype(np.int64))
        before = np.concatenate(([True], c["stop"][:-1] > 0))
        self.capitals = np.where(inside, (np.minimum(words, N_CAPITALS // 4 - 1) * 2 + before[first]) * 2 + (first == place), 0)
        self.line, self.stop = line, (c["stop"] > 0) & after

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Where sequences begin among the real tokens, and their sizes: the lines of each text, very long ones cut after sentences."""
        if not len(self.real):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        t, line = self.text[self.real], self.line[self.real]
        cut = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | line[:-1])))
        size = np.diff(np.concatenate((cut, [len(self.real)])))
        if size.max() > LONG:
            more, stops = [], np.flatnonzero(self.stop[self.real]) + 1
            for lo, n in zip(cut[size > LONG], size[size > LONG]):
                at, end = int(lo), int(lo + n)
                while end - at > LONG:
                    k = int(np.searchsorted(stops, at + LONG, side="right")) - 1
                    at = int(stops[k]) if k >= 0 and stops[k] > at else at + LONG
                    more.append(at)
            cut = np.union1d(cut, np.array(more, np.int64))
            size = np.diff(np.concatenate((cut, [len(self.real)])))
        return cut, size


def _sums(k: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by k."""
    return np.stack([np.bincount(k, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)


class Crf:
    """Weights; scores of labels for tokens; training on labelled sequences; decoding."""

    #: Different tokens that are remembered.
    MOST = 300_000

    def __init__(self, base: Base):
        self.base = base
        self.n = len(LABELS)
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of tokens, as when the list of given names changes."""
        self.lexicon, self.chunks, self.rows = Lexicon(self.base), _Chunks(), np.zeros((2 * REACH + 1, 0, self.n), np.float32)

    def tokens(self, texts: list[str]) -> Tokens:
        if len(self.lexicon) > self.MOST:
            self.forget()
        return Tokens(texts, self.lexicon, self.chunks)

    # decoding

    def emissions(self, t: Tokens, idx: np.ndarray) -> np.ndarray:
        have = self.rows.shape[1]
        new = list(self.lexicon.groups)[have:]
        if new:
            more = np.stack([self.w_tok[:, list(f)].sum(1) for f in new], 1)
            self.rows = np.ascontiguousarray(np.concatenate([self.rows, more], 1))
        e = self.w_space.take(t.space[idx], 0)
        e += self.w_digits.take(t.digits[idx], 0)
        e += self.w_capitals.take(t.capitals[idx], 0)
        for o in range(2 * REACH + 1):
            e += self.rows[o].take(t.group[idx + (o - REACH)], 0)
        for o in range(2 * CHUNK_REACH + 1):
            e += self.w_chunk[o].take(t.types[t.chunk[idx] + o], 0)
        return e

    def labels(self, t: Tokens) -> np.ndarray:
        """The best label of each real token."""
        begin, size = t.sequences()
        order, begin, size, steps = _by_step(begin, size)
        if not len(order):
            return np.empty(0, np.int8)
        out = np.empty(len(order), np.int8)
        out[order] = self.viterbi(self.emissions(t, t.real[order]), steps)
        return out

    def viterbi(self, e: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Best labels of sequences whose rows of scores lie step by step: first those of all first tokens, then all second ones.

        steps: where each step begins, and the end. Sequences are in descending order of length.
        """
        best = np.ascontiguousarray(e.T)
        best[:, : steps[1]] += self.start[:, None]
        trans = np.ascontiguousarray(self.trans[:, :, None])
        for s in range(1, len(steps) - 1):
            lo, hi = steps[s], steps[s + 1]
            before = best[:, steps[s - 1] : steps[s - 1] + hi - lo]
            best[:, lo:hi] += (before[:, None, :] + trans).max(0)
        rows = np.ascontiguousarray(best.T)
        back = np.ascontiguousarray(self.trans.T)
        out = rows.argmax(1)  # right where a sequence ends
        for s in range(len(steps) - 3, -1, -1):
            n = steps[s + 2] - steps[s + 1]  # sequences that go on
            lo = steps[s]
            out[lo : lo + n] = (rows[lo : lo + n] + back[out[steps[s + 1] : steps[s + 2]]]).argmax(1)
        return out.astype(np.int8)

    # training

    def fit(self, texts: list[str], labels: list[list[tuple[int, int, str]]], epochs: int = 10, batch: int = 256, rate: float = 0.08, decay: float = 4e-6, seed: int = 3) -> Crf:
        """Maximise the conditional likelihood by Adam; labels: of each text, the spans (begin, end, kind)."""
        t = Tokens(texts, self.lexicon, self.chunks)
        y_all = spans_to_labels(t, labels)
        self.base.fixed = True
        nb, groups = len(self.base.index), list(self.lexicon.groups)
        many = len(groups)
        of_class = np.repeat(np.arange(many), [len(f) for f in groups])  # feature of_feature[k] belongs to class of_class[k]
        of_feature = np.array([k for f in groups for k in f])
        n, no, nc = self.n, 2 * REACH + 1, 2 * CHUNK_REACH + 1
        sizes = {"tok": (no, nb, n), "chunk": (nc, len(CHUNK_TYPES), n), "space": (4, n), "digits": (N_DIGITS, n), "capitals": (N_CAPITALS, n), "trans": (n, n), "start": (n,)}
        p, m, v = ({k: np.zeros(s, np.float32) for k, s in sizes.items()} for _ in range(3))
        forbid = np.zeros((n, n), np.float32)
        for j, lab in enumerate(LABELS):
            if lab[0] == "I":
                for i, prev in enumerate(LABELS):
                    if prev[2:] != lab[2:]:
                        forbid[i, j] = -30
        first = np.array([-30 if lab[0] == "I" else 0 for lab in LABELS], np.float32)
        begin, size_of = t.sequences()
        g = np.random.default_rng(seed)
        step, averaged, total = 0, 0, {k: np.zeros(s, np.float64) for k, s in sizes.items()}
        for epoch in range(epochs):
            for part in np.array_split(g.permutation(len(begin)), max(1, len(begin) // batch)):
                part = part[np.argsort(-size_of[part], kind="stable")]
                size = size_of[part]
                most = int(size[0])
                at = begin[part][:, None] + np.arange(most)
                on = np.arange(most) < size[:, None]
                at = np.where(on, at, 0)
                y, flat = y_all[at], t.real[at[on]]
                e = p["space"][t.space[flat]] + p["digits"][t.digits[flat]] + p["capitals"][t.capitals[flat]]
                rows = [_sums(of_class, p["tok"][o][of_feature], many) for o in range(no)]
                for o in range(no):
                    e += rows[o][t.group[flat + o - REACH]]
                for o in range(nc):
                    e += p["chunk"][o][t.types[t.chunk[flat] + o]]
                full = np.zeros((len(part), most, n), np.float32)
                full[on] = e
                tr, st = p["trans"] + forbid, p["start"] + first
                et = np.exp(np.minimum(tr, 30))
                alpha, beta = np.zeros_like(full), np.zeros_like(full)
                alpha[:, 0] = full[:, 0] + st
                for i in range(1, most):
                    a = alpha[:, i - 1]
                    mx = a.max(1, keepdims=True)
                    alpha[:, i] = np.where(on[:, i, None], np.log(np.exp(a - mx) @ et + 1e-30) + mx + full[:, i], a)
                end = alpha[:, -1]
                mx = end.max(1)
                z = np.log(np.exp(end - mx[:, None]).sum(1)) + mx
                for i in range(most - 2, -1, -1):
                    bb = beta[:, i + 1] + full[:, i + 1]
                    mx = bb.max(1, keepdims=True)
                    beta[:, i] = np.where(on[:, i + 1, None], np.log(np.exp(bb - mx) @ et.T + 1e-30) + mx, 0)
                gamma = np.exp(alpha + beta - z[:, None, None])
                d = -gamma
                np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) + 1, 2)
                d[~on] = 0
                gt = np.zeros((n, n), np.float32)
                for i in range(1, most):
                    ok = on[:, i]
                    a, bb = alpha[ok, i - 1], beta[ok, i] + full[ok, i]
                    ma, mb = a.max(1, keepdims=True), bb.max(1, keepdims=True)
                    gt -= ((np.exp(a - ma) * np.exp(np.minimum(ma + mb - z[ok, None], 80))).T @ np.exp(bb - mb)) * et
                    np.add.at(gt, (y[ok, i - 1], y[ok, i]), 1)
                df = d[on]
                grad = {"trans": gt, "start": d[:, 0].sum(0), "space": _sums(t.space[flat], df, 4), "digits": _sums(t.digits[flat], df, N_DIGITS), "capitals": _sums(t.capitals[flat], df, N_CAPITALS)}
                grad["tok"] = np.stack([_sums(of_feature, _sums(t.group[flat + o - REACH], df, many)[of_class], nb) for o in range(no)])
                grad["chunk"] = np.stack([_sums(t.types[t.chunk[flat] + o], df, len(CHUNK_TYPES)) for o in range(nc)])
                step += 1
                for k in p:
                    q = grad[k] / len(part) - decay * p[k] * 10
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.99 * v[k] + 0.01 * q * q
                    p[k] += rate * (1 - 0.8 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                    if 2 * epoch >= epochs:  # the weights are the mean over the second half of the steps
                        total[k] += p[k]
                averaged += 2 * epoch >= epochs
        p = {k: (w / max(1, averaged)).astype(np.float32) for k, w in total.items()}
        self.w_tok, self.w_chunk, self.w_space, self.w_digits, self.w_capitals = (p[k] for k in ("tok", "chunk", "space", "digits", "capitals"))
        self.trans, self.start = p["trans"] + forbid, p["start"] + first
        self.forget()
        return self


def _by_step(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of sequences step by step, longest sequences first: their places, the sequences, and where each step begins."""
    longest = np.argsort(-size, kind="stable")
    begin, size = begin[longest], size[longest]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    steps = np.concatenate(([0], np.cumsum(live)))
    step = np.repeat(np.arange(most), live)
    order = begin[np.arange(len(step)) - steps[step]] + step if most else np.empty(0, np.int64)
    return order, begin, size, steps


def spans_to_labels(t: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """A label for each real token."""
    y = np.zeros(len(t.real), np.int64)
    text, begin = t.text[t.real], t.begin[t.real]
    edges = np.searchsorted(text, np.arange(len(spans) + 1))
    for k, own in enumerate(spans):
        b = begin[edges[k] : edges[k + 1]]
        for lo, hi, kind in own:
            i, j = edges[k] + np.searchsorted(b, [lo, hi])
            y[i:j] = LABELS.index("I-" + kind)
            y[i : min(i + 1, j)] = LABELS.index("B-" + kind)
    return y

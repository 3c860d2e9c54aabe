"""Personal data: base patterns and a linear-chain conditional random field.

The base patterns (e-mail, IPv4, card, phone) are exact and always count. A
CRF over word-shape features adds spans in forms that the patterns miss,
such as phones without ``+`` and spelled-out e-mail addresses. It is trained
on a small labelled table made by rule (:func:`labelled_table`), by maximum
conditional likelihood (forward-backward gradients), and decoded by Viterbi
in numpy batches. A decoded span is reported only if it passes the exact
check of its kind and does not overlap a base span.

Decoding cuts the token sequence where ``O`` is certain: a token whose ``O``
score leads every other tag by more than twice the spread of the transition
scores is ``O`` in the best path whatever its neighbours are. Only the runs
between such tokens enter the Viterbi recursion, side by side, so decoding is
exact. The model is constrained to ``O`` for words without digits, signs and
brackets that stand between two such words.

Input cases: a null text is the empty text (no spans); very long texts are
processed in blocks of whole texts; null ids, repeated rows and extra columns
are kept apart per row; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.textops import U64, Block, blocks, mix64, small_batches

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_REVERSED = re.compile(r"[A-Za-z0-9._%+-]+")
# possessive and left-bounded: the same matches as the plain pattern, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind index, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        # the longest run of local characters before the sign, after the last match
        while start > done:
            piece = text[max(done, start - 64): start][::-1]
            run = _LOCAL_REVERSED.match(piece)
            if run is None:
                break
            start -= run.end()
            if run.end() < len(piece):
                break
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Exact spans in code points, by start and then kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- features

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 @, 5 ., 6 -, 7 +, 8 (, 9 ), 10 [], 11 closing punctuation
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c, _k in zip(b"@.-+()[],;:!?\"'", (4, 5, 6, 7, 8, 9, 10, 10, 11, 11, 11, 11, 11, 11, 11)):
    _CLASS[_c] = _k
_CLASS[128:] = 1  # bytes of letters beyond ASCII

_TELLING = np.isin(_CLASS, (3, 4, 7, 8, 9, 10))  # digits, signs and brackets

BUCKETS = 1 << 14
#: Feature templates: own shape, own class set with digit count, the shape of
#: either neighbour.
N_TEMPLATES = 4
_NOBODY = U64(1) << U64(40)  # in place of a neighbour, at the ends of a text


def _bucket(template: int, value: np.ndarray) -> np.ndarray:
    return (mix64(value * U64(16) + U64(template)) % U64(BUCKETS)).astype(np.int32)


def token_features(block: Block, every: bool = False):
    """(start, end, text index, at, features) of the words of a block:
    ``at`` numbers the words that have a telling byte or stand beside one that
    has (all words with ``every``), features is (len(at), N_TEMPLATES).

    The shape of a word with a telling byte is its runs of equal byte classes;
    digit runs keep their length (at most 6), others do not. The shape of a
    plain word is its class set."""
    start, end, text = block.words()
    n = len(start)
    if n == 0:
        return start, end, text, start, np.zeros((0, N_TEMPLATES), dtype=np.int32)
    telling = np.zeros(len(block.data) + 1, dtype=np.int32)
    np.cumsum(_TELLING[block.data], out=telling[1:])
    tells = telling[end] > telling[start]
    prev_same = np.r_[False, text[1:] == text[:-1]]
    next_same = np.r_[prev_same[1:], False]
    near = tells.copy()
    near[1:] |= tells[:-1] & prev_same[1:]
    near[:-1] |= tells[1:] & next_same[:-1]
    at = np.arange(n) if every else np.flatnonzero(near)
    if not len(at):
        return start, end, text, at, np.zeros((0, N_TEMPLATES), dtype=np.int32)
    need = np.unique(np.r_[at, np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)])
    s, e = start[need], end[need]
    # the bytes of the needed words, end to end
    size = e - s
    first = np.cumsum(size) - size
    cls = _CLASS[block.data[np.arange(size.sum()) + np.repeat(s - first, size)]]
    owner = np.repeat(np.arange(len(need)), size)
    new = np.r_[True, cls[1:] != cls[:-1]]
    new[first] = True
    run_at = np.flatnonzero(new)
    run_len = np.diff(np.r_[run_at, len(cls)])
    run_cls, run_owner = cls[run_at].astype(U64), owner[run_at]
    symbol = run_cls * U64(8) + np.where(run_cls == 3, np.minimum(run_len, 6), 1).astype(U64)
    bits = np.bitwise_or.reduceat(U64(1) << run_cls, np.searchsorted(run_owner, np.arange(len(need))))
    begin = np.searchsorted(run_at, first)
    n_runs = np.diff(np.r_[begin, len(run_at)])
    shape = np.zeros(len(need), dtype=U64)
    for j in range(12):  # runs beyond the twelfth only enter through the class set
        has = np.flatnonzero(n_runs > j)
        if not len(has):
            break
        shape[has] = mix64(shape[has] * U64(131) + symbol[begin[has] + j] + U64(1))
    shape = np.where(tells[need], shape | U64(1) << U64(41), bits)
    n_digits = np.minimum(np.bincount(owner[cls == 3], minlength=len(need)), 20).astype(U64)
    here = np.searchsorted(need, at)
    beside = lambda d, same: np.where(
        same[at], shape[np.searchsorted(need, np.clip(at + d, 0, n - 1))], _NOBODY)
    values = (shape[here], bits[here] * U64(32) + n_digits[here], beside(-1, prev_same), beside(1, next_same))
    return start, end, text, at, np.stack([_bucket(i, v) for i, v in enumerate(values)], axis=1)


# ------------------------------------------------------------------ the CRF

TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))


@dataclass(frozen=True)
class CRF:
    emit: np.ndarray  # (BUCKETS, tags)
    move: np.ndarray  # (tags, tags), from row to column
    begin: np.ndarray  # (tags,)

    def scores(self, feats: np.ndarray) -> np.ndarray:
        out = self.emit[feats[:, 0]].copy()
        for j in range(1, feats.shape[1]):
            out += self.emit[feats[:, j]]
        return out

    @property
    def reach(self) -> float:
        """The most that the neighbours' tags can do for a tag against O."""
        return 2 * float(max(np.ptp(self.move), np.ptp(self.begin), abs(self.move).max(), abs(self.begin).max()))

    def decode(self, feats: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best tag of every word, given the features of the words ``at``
        (all others are bound to O); words of different texts do not interact."""
        tags = np.zeros(len(text), dtype=np.int8)
        if len(at) == 0:
            return tags
        e = self.scores(feats)
        certain = e[:, 0] - e[:, 1:].max(axis=1) > self.reach
        keep = np.flatnonzero(~certain)
        if not len(keep):
            return tags
        open_at = at[keep]
        cut = np.r_[True, (np.diff(open_at) > 1) | (text[open_at[1:]] != text[open_at[:-1]])]
        first, last = np.flatnonzero(cut), np.flatnonzero(np.r_[cut[1:], True])
        order = np.argsort(last - first, kind="stable")
        # runs of like length side by side, so padding stays small
        for part in np.array_split(order, max(1, len(order) // 4096)):
            self._viterbi(e[keep], open_at, text, first[part], last[part], tags)
        return tags

    def _viterbi(self, e, at, text, first, last, tags) -> None:
        n = len(text)
        length = last - first + 1
        steps = int(length.max())
        head, tail = at[first], at[last]
        from_o = (head > 0) & (text[np.maximum(head, 1) - 1] == text[head])
        to_o = (tail < n - 1) & (text[np.minimum(tail + 1, n - 1)] == text[tail])
        best = e[first] + np.where(from_o[:, None], self.move[0], self.begin)
        back = np.zeros((steps, len(first), len(TAGS)), dtype=np.int8)
        for t in range(1, steps):
            live = length > t
            cand = best[live][:, :, None] + self.move
            back[t, live] = cand.argmax(axis=1)
            best[live] = cand.max(axis=1) + e[first[live] + t]
        tag = (best + np.where(to_o[:, None], self.move[:, 0], 0.0)).argmax(axis=1)
        rows = np.arange(len(first))
        for t in range(steps - 1, -1, -1):
            live = length > t
            tags[at[first[live] + t]] = tag[live]
            if t:
                tag = np.where(live, back[t, rows, tag], tag)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train_crf(table: list[tuple[str, list[tuple[int, int, str]]]], *, rounds: int = 60, step: float = 0.3,
              l2: float = 1e-3) -> CRF:
    """Fit by full-batch Adam on the conditional log-likelihood. ``table``:
    (text, spans), a span being (start, end, kind) in code points."""
    n_tags = len(TAGS)
    seqs = []
    for text, spans in table:
        raw = pa.array([text])
        for block in blocks(raw):
            start, end, _, _, feats = token_features(block, every=True)
            cp = block.code_points_before()
            gold = np.zeros(len(start), dtype=np.int64)
            for a, b, kind in spans:
                inside = np.flatnonzero((cp[start] < b) & (cp[end] > a))
                gold[inside] = 2 + 2 * KINDS.index(kind)
                gold[inside[0]] = 1 + 2 * KINDS.index(kind)
            seqs.append((feats, gold))
    length = np.array([len(g) for _, g in seqs])
    width = int(length.max())
    feats = np.zeros((len(seqs), width, N_TEMPLATES), dtype=np.int64)
    gold = np.zeros((len(seqs), width), dtype=np.int64)
    for i, (f, g) in enumerate(seqs):
        feats[i, : len(f)], gold[i, : len(g)] = f, g
    mask = np.arange(width) < length[:, None]
    used, dense = np.unique(feats[mask], return_inverse=True)  # learn only the buckets that occur
    local = np.zeros_like(feats)
    local[mask] = dense.reshape(-1, N_TEMPLATES)
    shapes = {"emit": (len(used), n_tags), "move": (n_tags, n_tags), "begin": (n_tags,)}
    w = {k: np.zeros(s) for k, s in shapes.items()}
    m1, m2 = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    rows = np.arange(len(seqs))
    total = float(mask.sum())
    for r in range(1, rounds + 1):
        e = w["emit"][local].sum(axis=2)
        alpha = np.zeros((len(seqs), width, n_tags))
        beta = np.zeros((len(seqs), width, n_tags))
        alpha[:, 0] = e[:, 0] + w["begin"]
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], _log_sum(alpha[:, t - 1][:, :, None] + w["move"], 1) + e[:, t],
                                   alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None],
                                  _log_sum(w["move"][None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
        z = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        grad = {"emit": np.zeros(shapes["emit"]), "move": np.zeros(shapes["move"]), "begin": node[:, 0].sum(axis=0)}
        wrong = node
        wrong[rows[:, None], np.arange(width), gold] -= mask
        for j in range(N_TEMPLATES):
            np.add.at(grad["emit"], local[:, :, j][mask], wrong[mask])
        np.subtract.at(grad["begin"], gold[:, 0], 1.0)
        for t in range(1, width):
            live = mask[:, t]
            pair = np.exp(alpha[live, t - 1][:, :, None] + w["move"] + (e[live, t] + beta[live, t])[:, None, :]
                          - z[live, None, None])
            grad["move"] += pair.sum(axis=0)
            np.subtract.at(grad["move"], (gold[live, t - 1], gold[live, t]), 1.0)
        for k in w:
            g = grad[k] / total + l2 * w[k] / 100
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] -= step * (m1[k] / (1 - 0.9 ** r)) / (np.sqrt(m2[k] / (1 - 0.999 ** r)) + 1e-8)
    emit = np.zeros((BUCKETS, n_tags))
    emit[used] = w["emit"]
    return CRF(emit, w["move"], w["begin"])


def labelled_table(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: sentences of invented words in which personal
    data stands in the base forms and in forms beyond them, or not at all."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ("an", "the", "re", "tion", "of", "lich", "ment", "dos", "que", "a", "in", "schön", "été", "ñas")
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def filler() -> str:
        w = word()
        form = int(rng.integers(12))
        return (w.capitalize() if form == 0 else w + pick(",.;!?") if form == 1 else digits(int(rng.integers(1, 5)))
                if form == 2 else w + pick(("###", "&&&", "%%%")) if form == 3 else "|" if form == 4 else
                f'"{digits(3)}{w}{digits(4)}"' if form == 5 and rng.random() < 0.3 else "at" if form == 6 else
                f"{digits(2)}.{digits(1)}" if form == 7 and rng.random() < 0.3 else w)

    def card() -> str:
        body = digits(15)
        last = next(d for d in "0123456789" if luhn(body + d))
        d = body + last
        return pick((d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}",
                     f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
                     f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"001 {a} {b} {c}",
                     " ".join(f"0{digits(9)}"[i:i + 2] for i in range(0, 10, 2)), f"0{a} {b}{c}", f"0{a}/{b}{c}"))

    def email() -> str:
        user, host = word().encode("ascii", "ignore").decode() or "a", "mail" + digits(1)
        return pick((f"{user}.{digits(2)}@{host}.example.com", f"{user}@{host}.org", f"{user} [at] {host} [dot] com",
                     f"{user} (at) {host} (dot) org", f"{user}[at]{host}[dot]com"))

    ip = lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        words, spans, at = [], [], 0
        for _ in range(int(rng.integers(4, 14))):
            if rng.random() < 0.16:
                kind = pick(KINDS)
                value = makers[kind]()
                spans.append((at, at + len(value), kind))
            else:
                value = filler()
            words.append(value + pick(("", "", "", ".", ",")))
            at += len(words[-1]) + 1
        out.append((" ".join(words), spans))
    return out


# ------------------------------------------------------------ found spans

_SPELLED = re.compile(r"([A-Za-z0-9._%+-]+)\s*[\[(]\s*at\s*[\])]\s*([A-Za-z0-9-]+(?:\s*(?:\.|[\[(]\s*dot\s*[\])])\s*[A-Za-z0-9-]+)+)")
_NATIONAL = re.compile(r"(?<![0-9])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,2}[\x20.-][0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])")
_GROUPED = re.compile(r"\(?[0-9](?:[\x20()./-]{0,2}[0-9])+")
_DIGIT_RUN = re.compile(r"[0-9](?:[\x20.-]?[0-9])+")
_CARD_FORM = re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[\x20.-][0-9]{4}){3}|[0-9]{12,19})(?![0-9])")


def valid_spans(kind: str, value: str) -> list[tuple[int, int]]:
    """Where in a decoded span the kind's exact forms stand: spelled-out
    addresses, runs of 9 to 15 digits in groups, and runs of 12 to 19 digits
    with a right check digit. Every valid network address is a base span."""
    if kind == "email":
        return [m.span() for m in _SPELLED.finditer(value)]
    out = []
    if kind == "phone":
        for run in _GROUPED.finditer(value):
            n = len(_NOT_DIGIT.sub("", run[0]))
            # a run without groups is as likely a plain number; a longer one can hold several
            if n > 15:
                out += [m.span() for m in _NATIONAL.finditer(value, *run.span())]
            elif n >= 9 and not run[0].isdigit():
                out.append(run.span())
    if kind == "card":
        good = lambda m: 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)
        for run in _DIGIT_RUN.finditer(value):
            # several numbers can stand in one run
            out += [run.span()] if good(run) else [m.span() for m in _CARD_FORM.finditer(value, *run.span()) if good(m)]
    return out


def crf_spans(block: Block, texts: list[str], crf: CRF, taken: list[list[Span]]) -> list[list[Span]]:
    """The further spans of each text: decoded, checked, clear of base spans."""
    start, end, text, at, feats = token_features(block)
    tags = crf.decode(feats, at, text)
    out: list[list[Span]] = [[] for _ in texts]
    tagged = np.flatnonzero(tags)
    if not len(tagged):
        return out
    cp = block.code_points_before()
    kind = (tags[tagged] - 1) // 2
    joins = np.r_[False, (np.diff(tagged) == 1) & (kind[1:] == kind[:-1]) & (tags[tagged[1:]] % 2 == 0)
                  & (text[tagged[1:]] == text[tagged[:-1]])]
    head = np.flatnonzero(~joins)
    tail = np.r_[head[1:], len(tagged)] - 1
    for h, t in zip(head.tolist(), tail.tolist()):
        i = int(text[tagged[h]])
        base = int(cp[block.offsets[i]])
        a, b = int(cp[start[tagged[h]]]) - base, int(cp[end[tagged[t]]]) - base
        for x, y in valid_spans(KINDS[kind[h]], texts[i][a:b]):
            x, y = a + x, a + y
            if not any(u < y and x < v for u, _, v in taken[i]):
                out[i].append((x, int(kind[h]), y))
    return out


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by ``[KIND]``; overlapping spans are
    masked as one, under the kind of the first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, crf: CRF | None = None,
             with_masked: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, base counts per kind,
    ``base_sha256``, ``n_crf`` (further spans), ``spans`` and, with
    ``with_masked``, the masked text. A narrow map: nothing is shuffled; the
    model (``crf``, default: trained on :func:`labelled_table`) is the only
    thing sent to the executors."""
    model = crf or train_crf(labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast((model.emit.astype(np.float32), model.move, model.begin))
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType),
              *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
              T.StructField("base_sha256", T.StringType()), T.StructField("n_crf", T.LongType()),
              T.StructField("spans", T.StringType())]
    if with_masked:
        fields.append(T.StructField("masked", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = CRF(*shared.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                raw, off = block.data.tobytes(), block.offsets.tolist()
                texts = [raw[a:b].decode() for a, b in zip(off, off[1:])]
                base = [base_spans(t) for t in texts]
                more = crf_spans(block, texts, crf, base)
                every = [sorted(b + m) for b, m in zip(base, more)]
                cols = [batch.column(0).slice(block.first, block.n_texts)]
                cols += [pa.array([sum(k == i for _, k, _ in b) for b in base], pa.int64()) for i in range(len(KINDS))]
                cols += [pa.array([hashlib.sha256(write_spans(b).encode()).hexdigest() for b in base]),
                         pa.array([len(m) for m in more], pa.int64()), pa.array([write_spans(x) for x in every])]
                if with_masked:
                    cols.append(pa.array([mask(t, x) for t, x in zip(texts, every)]))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def mask_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", *,
                   crf: CRF | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with personal data masked in the text,
    and the length column, where there is one, set to the masked text's. A
    null text stays null."""
    model = crf or train_crf(labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast((model.emit.astype(np.float32), model.move, model.begin))

    @F.pandas_udf(T.StringType())
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        crf = CRF(*shared.value)
        for series in texts:
            out = []
            for block in blocks(pa.array(series, pa.large_string(), from_pandas=True)):
                raw, off = block.data.tobytes(), block.offsets.tolist()
                own = [raw[a:b].decode() for a, b in zip(off, off[1:])]
                base = [base_spans(t) for t in own]
                out += [mask(t, b + m) for t, b, m in zip(own, base, crf_spans(block, own, crf, base))]
            yield pd.Series(out, dtype=object).where(series.notna().to_numpy(), None)

    done = small_batches(docs).withColumn(text_col, masked(F.col(text_col)))
    if length_col and length_col in docs.columns:
        done = done.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return done

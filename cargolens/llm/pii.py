"""Personal data: four base patterns, and a linear-chain conditional random field over word shapes.

Base matches are leftmost and not overlapping for each kind and then validated (address parts up to
255, 16 to 19 digits that pass Luhn, 8 to 15 digits); one that fails is dropped. The CRF labels the
words of each line (O or one of the kinds) from shape features of the word and its neighbours. It is
trained by maximum likelihood on ``labelled_table()``, a few hundred short labelled sentences made by
rule, and decoded by Viterbi in numpy. A word that prefers O by more than any transitions can win
back is O on every best path, so lines are cut there and only the pieces between are searched, in batches
of bounded size; lines without a digit or an at sign, which no valid span lacks, are not decoded. Memory
is in proportion to the longest line, about 200 bytes a word. Its spans are trimmed of
surrounding punctuation, validated as above and added where they touch no base span; base spans stay.

Offsets are code points. Null and empty texts have no span; of two labels with equal scores the first
listed wins; repeated rows give the same row again; an
empty table gives no rows; extra columns stay in :func:`scan`, and ``base``, ``added`` are replaced."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns: fixed values; for email the part behind the at sign.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_HINT = re.compile("[0-9@]")
#: Words that are decoded at once, and words of the parts that a long line is cut into.
CELLS, SPAN = 100_000, 512
SPANS = "struct<base:array<struct<kind:int,start:int,end:int>>,added:array<struct<kind:int,start:int,end:int>>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))) % 10 == 0


def valid(kind: int, s: str) -> bool:
    digits = "".join(_DIGIT.findall(s))
    if kind == 0:
        return s.count("@") == 1 and bool(_DOMAIN.fullmatch(s.split("@")[1])) and s[0] != "@"
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-9:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


# --- the field ---------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Letters to a or A, digits to 9, runs over four of a sign to four; other signs stay."""
    out, last, n = [], "", 0
    for c in word[:64]:
        s = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        n = n + 1 if s == last else 1
        last = s
        if n <= 4:
            out.append(s)
    return "".join(out)


def attributes(s: str, n_digits: int) -> list[str]:
    """Features of a word from its shape."""
    short = re.sub(r"(.)\1+", r"\1", s)
    bare = short.strip("!?.,;:\"'()$#*&%|")
    out = [f"s={s}", f"c={short}", f"b={bare}", f"d={min(n_digits, 20) // 2}"]
    out += [f"has{c}" for c in "@.+-()9" if c in s]
    if not ("9" in s or "@" in s):
        out.append("plain")
    return out


def labelled_table(sentences: int = 360, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The training table: (words, labels), label 0 for O and 1 + kind else; made by rule, without any real data."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = number(15)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def piece() -> tuple[list[str], int]:
        kind = rng.randint(0, 3)
        if kind == 0:
            return [f"{word()}{rng.choice(['', '.', '_', '+'])}{number(rng.randint(0, 2))}@{word()}{rng.choice(['', number(1)])}.{rng.choice(['example.com', 'org', 'net'])}"], 1
        if kind == 1:
            return [".".join(str(rng.randint(0, 255)) for _ in range(4))], 2
        if kind == 2:
            c = card()
            return ([c] if rng.random() < 0.5 else [c[i : i + 4] for i in range(0, 16, 4)]), 3
        a, b, c = number(3), number(3), number(4)
        return rng.choice([[f"+1 ({a}) {b}-{c}"], [f"({a}) {b}-{c}"], [f"+49 {a} {b}{c}"], [f"{a}-{b}-{c}"], [f"+1-{a}-{b}-{c}"]])[0].split(" "), 4

    def other() -> str:
        return rng.choice([word, word, word, word().title, lambda: number(rng.randint(1, 5)), lambda: f"{number(2)}.{number(2)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: word().upper() + "!!", lambda: f"v{number(1)}.{number(1)}.{number(1)}", lambda: number(rng.randint(20, 40)), lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'])()

    out = []
    for _ in range(sentences):
        words, labels = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 5)):
                words.append(other())
                labels.append(0)
            p, kind = piece()
            p[-1] += rng.choice(["", "", "", ".", ",", "!!", "***"])
            words, labels = words + p, labels + [kind] * len(p)
        for _ in range(rng.randint(0, 4)):
            words.append(other())
            labels.append(0)
        out.append((words, labels))
    return out


class Field:
    """Weights by attribute for the word itself, the word before and the word after; transitions."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.weights = np.zeros((3, 0, 5))
        self.moves = np.zeros((5, 5))
        self.ends = np.zeros(5)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.forms: dict[tuple, int] = {}
        self.scores = np.zeros((3, 0, 5))
        self.new: list[list[int]] = []

    def look(self, word: str) -> int:
        """Index of the word's form (shape and digit count); forms are few, words many."""
        s, n = shape(word), len(_DIGIT.findall(word))
        if (s, n) not in self.forms:
            self.forms[s, n] = len(self.forms)
            self.new.append([self.at[a] for a in attributes(s, n) if a in self.at])
        i = self.ids[word] = self.forms[s, n]
        return i

    def settle(self) -> None:
        if self.new:
            self.scores = np.concatenate([self.scores, np.stack([self.weights[:, a].sum(1) if a else np.zeros((3, 5)) for a in self.new], 1)], 1)
            self.new = []

    def train(self, table: list[tuple[list[str], list[int]]], steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Batch gradient of the mean log-likelihood with AdaGrad; all sentences in padded arrays."""
        feats = [[attributes(shape(w), len(_DIGIT.findall(w))) for w in ws] for ws, _ in table]
        for a in sorted({a for ws in feats for f in ws for a in f}):
            self.at[a] = len(self.at)
        n, length, size = len(table), max(len(ws) for ws, _ in table), len(self.at)
        y, mask = np.zeros((n, length), int), np.zeros((n, length), bool)
        cells: list[tuple[int, int, int, int]] = []
        for i, (ws, ys) in enumerate(table):
            y[i, : len(ys)], mask[i, : len(ws)] = ys, True
            for t in range(len(ws)):
                cells += [(0, i, t, self.at[a]) for a in feats[i][t]]
                cells += [(1, i, t, self.at[a]) for a in (feats[i][t - 1] if t else [])]
                cells += [(2, i, t, self.at[a]) for a in (feats[i][t + 1] if t + 1 < len(ws) else [])]
        side, row, pos, att = np.array(cells).T
        w, moves, ends = np.zeros((3, size, 5)), np.zeros((5, 5)), np.zeros(5)
        sums = [np.full_like(x, 1e-6) for x in (w, moves, ends)]
        gold = np.eye(5)[y] * mask[..., None]
        pairs = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1))
        for _ in range(steps):
            e = np.zeros((n, length, 5))
            np.add.at(e, (row, pos), w[side, att])
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + ends
            for t in range(1, length):
                nxt = _lse(alpha[:, t - 1, :, None] + moves, 1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                nxt = _lse((beta[:, t + 1] + e[:, t + 1])[:, None, :] + moves, 2)
                beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
            z = _lse(alpha[:, -1], 1)
            post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            edge = np.exp(alpha[:, :-1, :, None] + moves + (beta + e)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            gw = np.zeros_like(w)
            np.add.at(gw, (side, att), (gold - post)[row, pos])
            for x, g, s in zip((w, moves, ends), (gw / n - decay * w, (pairs - edge.sum((0, 1))) / n - decay * moves, (gold[:, 0] - post[:, 0]).sum(0) / n - decay * ends), sums, strict=True):
                s += g * g
                x += rate * g / np.sqrt(s)
        self.weights, self.moves, self.ends = w, moves, ends
        self.forget()
        return self

    def label(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Viterbi labels of each line's words; lines of like length go together."""
        get, look = self.ids.get, self.look
        forms = []
        for ws in lines:
            ids = list(map(get, ws))
            if None in ids:
                ids = [look(w) if i is None else i for i, w in zip(ids, ws, strict=True)]
            forms.append(np.array(ids, np.int64))
        self.settle()
        out: list[np.ndarray] = [np.zeros(len(x), np.int8) for x in forms]
        if not self.scores.shape[1]:
            return out
        # A word that prefers O by more than any transitions can win back is O on every best path: lines are cut there.
        reach = np.concatenate([self.moves.ravel(), self.ends])
        slack = 2 * (reach.max() - reach.min())
        pieces: list[tuple[int, int, int]] = []
        for i, x in enumerate(forms):
            e = self._emissions(x, 0, len(x))
            open_ = np.concatenate(([0], (e[:, 0] - e[:, 1:].max(1) <= slack) if len(x) else [], [0])).astype(np.int8)
            edge = np.flatnonzero(np.diff(open_))
            pieces += [(i, a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        pieces.sort(key=lambda p: p[2] - p[1])
        while pieces and pieces[-1][2] - pieces[-1][1] > 4 * SPAN:
            self._decode_long(forms, *pieces.pop(), out)
        k = 0
        while k < len(pieces):
            # pieces of like length together, their cells bounded; one longer piece goes alone
            end = k + 1
            while end < len(pieces) and (end + 1 - k) * (pieces[end][2] - pieces[end][1]) <= CELLS:
                end += 1
            self._decode(forms, pieces[k:end], out)
            k = end
        return out

    def _emissions(self, x: np.ndarray, a: int, b: int) -> np.ndarray:
        """Scores of the labels of words ``a`` to ``b`` of a line's forms, from the words and their neighbours."""
        e = self.scores[0][x[a:b]].copy()
        lo, hi = max(a, 1), min(b, len(x) - 1)
        e[lo - a :] += self.scores[1][x[lo - 1 : b - 1]]
        if hi > a:
            e[: hi - a] += self.scores[2][x[a + 1 : hi + 1]]
        return e

    def _decode_long(self, forms: list[np.ndarray], i: int, a: int, b: int, out: list[np.ndarray]) -> None:
        """The same for one long piece: its spans side by side, each from every label before it, then joined."""
        x = forms[i]
        e = self._emissions(x, a, b)
        e[0] += self.moves[0] if a else self.ends
        if b < len(x):
            e[-1] += self.moves[:, 0]
        n = -(-len(e) // SPAN)
        pad = n * SPAN - len(e)
        # words that aren't there take label O at no cost
        filler = np.full((pad, 5), -np.inf)
        filler[:, 0] = 0
        free = np.full(pad, True)
        e, over = np.concatenate([e, filler]).reshape(n, SPAN, 5), np.concatenate([np.full(len(e), False), free]).reshape(n, SPAN)
        score = e[:, 0][:, None, :] + self.moves[None]
        score[0] = e[0, 0]
        score[over[:, 0]] = np.where(np.arange(5) == 0, 0.0, -np.inf)
        back = np.zeros((SPAN, n, 5, 5), np.int8)
        for t in range(1, SPAN):
            moves = np.where(over[:, t, None, None], 0.0, self.moves)
            cand = score[:, :, :, None] + moves[:, None]
            back[t] = cand.argmax(2)
            score = cand.max(2) + e[:, t][:, None, :]
        best, before = score[0, 0], np.zeros((n, 5), np.int8)
        for k in range(1, n):
            cand = best[:, None] + score[k]
            before[k], best = cand.argmax(0), cand.max(0)
        last, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        last[-1] = best.argmax()
        for k in range(n - 1, 0, -1):
            first[k] = before[k, last[k]]
            last[k - 1] = first[k]
        path, found = last, np.zeros((n, SPAN), np.int8)
        for t in range(SPAN - 1, -1, -1):
            found[:, t] = path
            path = back[t][np.arange(n), first, path] if t else path
        out[i][a:b] = found.ravel()[: b - a]

    def _decode(self, forms: list[np.ndarray], pieces: list[tuple[int, int, int]], out: list[np.ndarray]) -> None:
        """Viterbi over pieces that stand between words labelled O, or a line's ends."""
        rows, length = len(pieces), max(b - a for _, a, b in pieces)
        e, size = np.zeros((rows, length, 5)), np.array([b - a for _, a, b in pieces])
        for r, (i, a, b) in enumerate(pieces):
            e[r, : b - a] = self._emissions(forms[i], a, b)
            e[r, 0] += self.moves[0] if a else self.ends
            if b < len(forms[i]):
                e[r, b - a - 1] += self.moves[:, 0]
        score, back = e[:, 0], np.zeros((length, rows, 5), np.int8)
        for t in range(1, length):
            cand = score[:, :, None] + self.moves
            on = (t < size)[:, None]
            back[t] = np.where(on, cand.argmax(1), np.arange(5))
            score = np.where(on, cand.max(1) + e[:, t], score)
        path, best = score.argmax(1), np.zeros((length, rows), np.int8)
        for t in range(length - 1, -1, -1):
            best[t] = path
            path = back[t][np.arange(rows), path] if t else path
        for r, (i, a, b) in enumerate(pieces):
            out[i][a:b] = best[: b - a, r]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


_TRIM = "!?.,;:\"'$#*&%|<>[]{}"


def _reach(base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of spans in order, and the furthest end of all spans up to each."""
    at = sorted((a, b) for _, a, b in base)
    return np.array([a for a, _ in at], np.int64), np.maximum.accumulate(np.array([b for _, b in at], np.int64)) if at else np.zeros(0, np.int64)


def field_spans(text: str, line_at: int, words: list[str], labels: np.ndarray, base: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Valid trimmed spans of a line's labelled words that touch no base span. line_at: where the line starts in the text; base: ``_reach``."""
    if not labels.any():
        return []
    out, at, places = [], line_at, []
    starts, ends = base
    for w in words:
        at = text.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    i = 0
    while i < len(words):
        j = i + 1
        if labels[i]:
            while j < len(words) and labels[j] == labels[i]:
                j += 1
            a, b = places[i][0], places[j - 1][1]
            s = text[a:b]
            a, b = a + len(s) - len(s.lstrip(_TRIM)), b - (len(s) - len(s.rstrip(_TRIM)))
            before = int(np.searchsorted(starts, b))
            if a < b and valid(labels[i] - 1, text[a:b]) and not (before and ends[before - 1] > a):
                out.append((int(labels[i]) - 1, a, b))
        i = j
    return out


def trained() -> Field:
    return Field().train(labelled_table())


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base, added) of each text."""
    if len(field.ids) > 500_000:
        field.forget()
    lines, whose = [], []
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            # a valid span has a digit or an at sign, so no other line can give one
            if _HINT.search(line) and (ws := line.split()):
                lines.append(ws)
                whose.append((d, at))
            at += len(line) + 1
    out: list[tuple[list, list]] = [(base_spans(t), []) for t in texts]
    last, base = -1, None
    for ws, (d, at), labels in zip(lines, whose, field.label(lines), strict=True):
        if labels.any():
            if d != last:
                last, base = d, _reach(out[d][0])
            out[d][1].extend(field_spans(texts[d], at, ws, labels, base))
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (kind index, start, end) by kind, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = shared.value
        rows = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found)]
        for col in batches:
            texts = [t or "" for t in col]
            found = [x for i in range(0, len(texts), 200) for x in find(texts[i : i + 200], f)]
            yield pd.DataFrame({"base": [rows(b) for b, _ in found], "added": [rows(a) for _, a in found]})

    return docs.withColumn("_s", spans("text")).select(*[c for c in docs.columns if c not in ("base", "added")], "_s.base", "_s.added")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))))
    out = scan(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    counts = [count(i) for i in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets."""
    keep = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), field)

    @F.pandas_udf("string")
    def mask(texts: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        out = []
        for t, b, a in zip(texts, base, added, strict=True):
            for kind, start, end in _outer([(x["kind"], x["start"], x["end"]) for x in [*b, *a]]):
                t = f"{t[:start]}<{KINDS[kind]}>{t[end:]}"
            out.append(t)
        return pd.Series(out, dtype=object)

    return keep.select(*[(mask("text", "base", "added") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _outer(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that don't overlap, the last first; of overlapping ones the earliest and longest, grown to cover the rest."""
    out: list[tuple[int, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out[::-1]

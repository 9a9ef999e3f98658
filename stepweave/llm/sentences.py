"""Sentence units of documents in any script, with their positions.

Layout comes first: an empty line, a line break before a list marker, headings and lines
that hold a JSON object end units whatever they say. Within a block, terminators and, in
Thai, spaces are candidates. What is quoted or bracketed stays together. The remaining
candidates are classified by a maximum-entropy model over the tokens beside them: how often
the token before ends blocks, how often the one after begins them, case, length, digits,
script. It is trained on boundaries that are certain without it: ends of blocks on the one
side, tokens that never end a block although they often have a full stop on the other.

Positions are code points from 0, the end exclusive, without surrounding white space.
Defined results: null and blank texts give no unit; a text without any boundary is one unit;
an unclosed quote or bracket holds nothing together.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.cluster import spread
from stepweave.llm.language import language

#: Documents on which the model is fitted, whole ones of up to so many characters; every document is split.
MODEL_DOCUMENTS, MODEL_CHARS = 12_000, 20_000
#: Share of sentence ends that end a block, as assumed where nothing shows it; chance of a full stop of an abbreviation to end one.
BLOCK_END, STRAY_END = 0.25, 0.004

_MARKER = re.compile(r"[ \t　]*(?:(#{1,6})[ \t]+|([-*•·▪◦‣–—])[ \t]+|(\d{1,3})[.)][ \t]+|(\d{1,3})、[ \t]*|([A-Za-z])\)[ \t]+|[(（](\d{1,3})[)）][ \t]*)(?=\S)")
_STOPS = ".!?。！？…।॥｡"
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]", "《": "》", "【": "】", '"': '"', "'": "'"}
_SHUTS = {x: re.compile("[" + re.escape(x + shut) + "]") for x, shut in _OPEN.items()}
_CLOSE = set("”“»」』’)）]》】\"'")
_CJK = r"぀-ヿ㐀-鿿豈-﫿"
_THAI = re.compile(r"[฀-๿]")
_WATCH = re.compile(r"[“„«「『‘(（\[《【\"']|[.!?。！？…।॥｡]+|(?<=[฀-๿])[ \t]+(?=\S)|(?<=[\w.)”\"])[ \t]+(?=[฀-๿])")
_NEXT = re.compile(rf"[{_CJK}]{{1,2}}|[฀-๿]{{1,4}}|\d[\d.,:]*|[^\W\d_]+|\S")
_BARE = re.compile(r"[^\W\d_]{2,}(?![.\w])")
_ORDINALS = frozenset({"de", None})
_OPENERS = re.compile(r"[\s“„«「『‘(（\[《【\"'¿¡]*")
_LAST = re.compile(r"\S+$")
_SIGN = re.compile(f"[{_CJK}]")
_NUMBER, _CODED = re.compile(r"[\d.,:/-]+"), re.compile(r"[\d_/]")


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, start after the marker, end) of the parts that layout alone separates."""
    out: list[tuple[int, int, int]] = []
    at = 0
    begin: int | None = None
    inner = 0
    number: int | None = None
    closed = True  # the line before ended a sentence, or there is none

    def end(to: int) -> None:
        nonlocal begin
        if begin is not None:
            out.append((begin, inner, to))
        begin = None

    for line in text.splitlines(keepends=True):
        stop, bare = at + len(line), line.strip()
        if not bare:
            end(at)
            closed, number = True, None
        else:
            m = _MARKER.match(line)
            value = int(m[3] or m[4] or m[6]) if m and (m[3] or m[4] or m[6]) else None
            # a number at the start of a wrapped line is no marker unless it begins a list or counts on
            is_marker = bool(m) and (value is None or value == 1 or begin is None or closed or (number is not None and value == number + 1))
            is_object = bare[0] == "{" and bare[-1] == "}" and len(bare) > 1
            if is_marker or is_object or begin is None:
                end(at)
                begin, inner = at, at + (m.end() if is_marker else 0)
                number = value if is_marker else number
            if is_object or (is_marker and m[1]):
                end(stop)
                closed = True
            else:
                closed = bare.rstrip("\"'”’»」』)）]")[-1:] in tuple(_STOPS + ":：")
        at = stop
    end(at)
    return out


def _before(text: str, start: int, at: int) -> str:
    """Type of the token that ends at a stop."""
    near = max(start, at - 40)
    m = _LAST.search(text[near:at])
    while m and not m.start() and near > start:  # a token longer than that
        near = max(start, near - 400)
        m = _LAST.search(text[near:at])
    token = m.group().lstrip("\"'“„«‘([（「¿¡") if m else ""
    if _THAI.match(token[-1:]):
        return token[-4:]
    if not token.isascii():
        token = _SIGN.split(token)[-1]
    if not token:
        return "<none>"
    if _NUMBER.fullmatch(token):
        return "<number>"
    if _CODED.search(token):
        return "<code>"
    return token


def _after(text: str, at: int, end: int) -> str:
    """Type of the token that follows a candidate."""
    m = _OPENERS.match(text, at, end)
    m = _NEXT.search(text, m.end() if m.end() < end else at, end)
    if not m:
        return "<none>"
    token = m.group()
    return "<number>" if token[0].isdigit() else token


def _shape(token: str) -> str:
    return "<" + ("N" if token[:1].isdigit() else "Upper" if token[:1].isupper() and token[1:].islower() else "UPPER" if token.isupper() else "lower" if token[:1].islower() else "other") + ">"


class BoundaryModel:
    """Counts of tokens beside block ends, and the weights of a logistic regression over them."""

    def __init__(self, texts: list[str]):
        self.ends, self.stays = Counter(), Counter()
        self.starts, self.inside, self.follows = Counter(), Counter(), Counter()
        self.bare: Counter = Counter()  # words without a stop after them: abbreviations hardly ever stand so
        self.weights: np.ndarray | None = None
        self.asked: dict[tuple[str, str], bool] = {}
        edges: list[tuple[str, str]] = []
        middle: list[tuple[str, str]] = []
        for text in texts:
            last: str | None = None
            for begin, inner, end in blocks(text):
                stop = end
                while stop > inner and (text[stop - 1].isspace() or text[stop - 1] in _CLOSE):
                    stop -= 1
                first = _after(text, inner, end)
                thai = bool(_THAI.match(text[stop - 1 : stop]))
                if stop > inner and (text[stop - 1] in _STOPS or thai):  # headings are no sentences
                    self._count(self.starts, first)
                if last is not None:
                    edges.append((last, first))
                last = None
                if stop > inner and (text[stop - 1] == "." or thai):
                    last = _before(text, inner, stop if thai else stop - 1)
                    self._count(self.ends, last)
                self.bare.update(_BARE.findall(text, inner, stop))
                for m in re.finditer(r"(?:(?<=[฀-๿])|(?P<stop>\.))[ \t\n]+(?=\S)", text[inner:stop]):
                    before = _before(text, inner, inner + m.start())
                    after = _after(text, inner + m.end(), end)
                    self._count(self.stays, before)
                    self._count(self.follows, after)
                    middle.append((before, after))
                for m in re.finditer(rf"(?<=[\w,;])[ \t\n]+(?=\S)|(?<=[{_CJK}])(?=[{_CJK}])", text[inner:stop]):
                    self._count(self.inside, _after(text, inner + m.end(), end))
        # of the stops after a token, those before a token known to begin sentences: an end that happens to stand in no block's last place
        self.before_known, self.before_any, self.before_upper = Counter(), Counter(), Counter()
        self.known = {t for t in self.starts if self.starts[t] + self.follows[t] >= 5 and self.begin_odds(t) > 3}
        for before, after in middle:
            self._count(self.before_any, before)
            self.before_upper[before] += after[:1].isupper()
            if after in self.known:
                self._count(self.before_known, before)
        self._fit(edges, middle)

    @staticmethod
    def _count(counter: Counter, token: str) -> None:
        counter[token] += 1
        counter[_shape(token)] += 1

    @staticmethod
    def _odds(token: str, edge: Counter, middle: Counter) -> float:
        """Log-likelihood ratio of 'as often at the edge of blocks as sentences are' to 'never there but by chance'."""
        key = token if edge[token] + middle[token] >= 5 else _shape(token)
        at_edge, within = edge[key], middle[key]
        if not at_edge + within:
            return 0.0
        scale = min(1.0, 40 / (at_edge + within))
        return scale * (at_edge * math.log(BLOCK_END / STRAY_END) + within * math.log((1 - BLOCK_END) / (1 - STRAY_END)))

    def end_odds(self, token: str) -> float:
        """Whether a stop after the token ends sentences."""
        return self._odds(token, self.ends, self.stays)

    def known_share(self, token: str) -> float:
        """Share of the stops after the token that a known beginning follows; one half where too little shows."""
        key = token if self.before_any[token] >= 5 else _shape(token)
        return (self.before_known[key] + 0.5) / (self.before_any[key] + 1)

    def begin_odds(self, token: str) -> float:
        """Whether the token begins sentences where it follows a stop."""
        return self._odds(token, self.starts, self.follows)

    def start_odds(self, token: str) -> float:
        n = self.starts[token] + self.inside[token]
        key = token if n >= 5 else _shape(token)
        return math.log((self.starts[key] + 0.2) / (self.inside[key] * BLOCK_END + 0.2))

    def features(self, before: str, after: str) -> list[float]:
        clip = lambda x, m: max(-m, min(m, x)) / m
        end, start, begin = clip(self.end_odds(before), 8), clip(self.start_odds(after), 4), clip(self.begin_odds(after), 8)
        lower, upper, digit = after[:1].islower(), after[:1].isupper(), after == "<number>"
        return [
            1.0, end, start, begin, min(end, begin), 2 * self.known_share(before) - 1, float(lower), float(upper), float(digit), float(before == "<number>"), float(before == "<code>"), float(len(before) == 1),
            float("." in before), float(len(before) <= 4), float(before[:1].isupper()), float(before == "<number>" and self.start_odds(after) < 0), float(bool(_THAI.match(after[:1]))),
        ]

    def _fit(self, edges: list[tuple[str, str]], middle: list[tuple[str, str]]) -> None:
        share = {t: self.known_share(t) for t in {p[0] for p in middle}}
        never = [p for p in middle if self.stays[p[0]] >= 15 and not self.ends[p[0]] and share[p[0]] < 0.1]
        edges = edges + [p for p in middle if share[p[0]] > 0.6 and p[1] in self.known]
        # tokens that may do both: a following token that often follows stops but never begins a block decides
        never += [p for p in middle if self.ends[p[0]] and self.follows[p[1]] >= 15 and not self.starts[p[1]]]
        if len(edges) < 20 or len(never) < 20:
            return
        x = np.array([self.features(*p) for p in edges + never])
        y = np.array([1.0] * len(edges) + [0.0] * len(never))
        weight = np.where(y == 1, len(y) / (2 * len(edges)), len(y) / (2 * len(never)))
        w = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + 0.5 * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def boundary(self, before: str, after: str) -> bool:
        """Whether a stop between two tokens ends a sentence; what was asked before is known."""
        known = self.asked.get((before, after))
        if known is None:
            if len(self.asked) >= 500_000:
                self.asked.clear()
            known = self.asked[before, after] = self._boundary(before, after)
        return known

    def _boundary(self, before: str, after: str) -> bool:
        if before.isalpha() and len(before) >= 2 and after[:1].isupper():
            stopped = self.before_any[before]
            # a word that also stands without a stop, or a rare long one, is no abbreviation
            if self.bare[before] >= max(1, 0.2 * stopped) or len(before) >= 4 and stopped < 5:
                return True
            # nor is a word in lower case that only capitals follow: abbreviations of that length precede numbers and small letters too
            if len(before) >= 4 and before.islower() and self.before_upper[before] >= 0.9 * stopped:
                return True
        if self.weights is None:
            return not after[:1].islower() and len(before) > 2
        return float(np.dot(self.features(before, after), self.weights)) > 0


class _Closings:
    """Where the quotes and brackets of a block close, each kind looked for once."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.begin, self.end = text, begin, end
        self.brackets: dict[str, dict[int, int]] = {}
        self.quotes: dict[str, list[int]] = {}

    def of(self, at: int) -> int:
        """The place that closes what opens at a place, or -1."""
        text, opened = self.text, self.text[at]
        if opened in "\"'‘":
            if opened in "'‘" and (at and (text[at - 1].isalnum() or text[at - 1] in "’'") or not text[at + 1 : at + 2].strip()):
                return -1
            if opened not in self.quotes:
                # a single quote before a letter is an apostrophe
                self.quotes[opened] = [m.start() for m in re.finditer(f"[{_OPEN[opened]}]", text[self.begin : self.end]) if opened == '"' or not text[self.begin + m.end() : self.begin + m.end() + 1].isalnum()]
            found = self.quotes[opened]
            i = bisect_left(found, at + 1 - self.begin)
            return found[i] + self.begin if i < len(found) else -1
        if opened not in self.brackets:
            closes, stack = self.brackets.setdefault(opened, {}), []
            for m in _SHUTS[opened].finditer(text, self.begin, self.end):
                if m.group() == opened:
                    stack.append(m.start())
                elif stack:
                    closes[stack.pop()] = m.start()
        return self.brackets[opened].get(at, -1)


def units(text: str, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text."""
    out: list[tuple[int, int]] = []

    def add(start: int, end: int) -> None:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start:
            out.append((start, end))

    for begin, inner, end in blocks(text):
        bare = text[begin:end].strip()
        if bare[:1] == "{" and bare[-1:] == "}" or bare[:1] == "#":
            add(begin, end)
            continue
        closings = _Closings(text, begin, end)
        start, said, at = begin, inner, inner  # start of the unit, of its words, and of what is unread
        while m := _WATCH.search(text, at, end):
            sign, at = m.group(), m.end()
            if sign[0] in _OPEN:
                close = closings.of(m.start())
                if close < 0:
                    continue
                at = close + 1
                inside = text[m.start() + 1 : close].rstrip()
                while text[at : at + 1] and text[at] in "\"'”’»」』)）]" and at < end:
                    at += 1
                if inside[-1:] not in tuple(_STOPS) or text[at : at + 1] in tuple(_STOPS + ",;:，；：、"):
                    continue
                space = at
                while space < end and text[space].isspace():
                    space += 1
                if space >= end:
                    break
                lead = text[said : m.start()].rstrip()
                after = _after(text, space, end)
                odds = model.start_odds(after)
                # without a space: in a script that has none, or where two texts were joined
                script = _SIGN.match(text[space]) or space == at and inside[-1] in "。！？"
                if not script and space == at and not after[:1].isupper():
                    cut = False
                elif after[:1].islower():
                    cut = (lead[-1:] in tuple(":：") or not lead) and odds > 1 and model.begin_odds(after) > 0
                elif lead[-1:] in tuple(":：,，、"):
                    cut = True
                elif not lead:
                    cut = odds > 0 if script else after[:1].isupper() or odds > 0
                else:
                    cut = odds > (2 if script else 1)
                if cut:
                    add(start, at)
                    start = said = at = space
                continue
            stop = m.start()
            if sign.isspace():
                before, after = _before(text, said, stop), _after(text, at, end)
                if text[stop - 1] in _STOPS or not _THAI.match(text[stop - 1]):
                    continue
                if model.end_odds(before) > 0 and model.boundary(before, after):
                    add(start, stop)
                    start = said = at
                continue
            # a stop, with the closing signs after it
            while at < end and text[at] in "\"'”’»」』)）]" and text[at] in _CLOSE:
                at += 1
            space = at
            while space < end and text[space].isspace():
                space += 1
            if space >= end:
                break
            follows_cjk = bool(_SIGN.match(text[space]))
            after = _after(text, space, end)
            if sign[-1] in "。！？।॥｡":
                cut = True
            elif sign[-1] in "!?":
                cut = (space > at or follows_cjk or after[:1].isupper()) and text[space] not in ",;:，；：、" and not (after[:1].islower() and model.start_odds(after) < 0)
            elif sign[-1] == "…" or len(sign) > 1:
                cut = (space > at or after[:1].isupper()) and (after[:1].isupper() or not after[:1].islower() and model.start_odds(after) > 0 or model.start_odds(after) > 1)
            else:
                before = _before(text, said, stop)
                if space == at:
                    # two texts joined without a space; not within names of files, versions or numbers
                    cut = (follows_cjk or after[:1].isupper() and after[1:2].islower() and before[:1] != "<" and before[-2:].islower()) and len(before) > 1 and (before[:1] != "<" or before == "<number>" or before == "<code>") and model.end_odds(before) > 0
                elif text[space] in ",;:，；：、-–":
                    cut = False
                else:
                    cut = model.boundary(before, after)
                    if not cut and before == "<number>" and after[:1].isupper():
                        # a number before a capital is an ordinal only where there are any, and never a time or a fraction
                        number = _LAST.search(text, max(said, stop - 20), stop)
                        cut = bool(number) and (not number.group().isdigit() or language(text[said:stop]) not in _ORDINALS)
            if cut:
                add(start, at)
                start = said = at = space
        add(start, end)
    return out


def fit(documents: DataFrame) -> BoundaryModel:
    """The model, from the MODEL_DOCUMENTS documents of up to MODEL_CHARS characters with the smallest hashed id."""
    rows = documents.where(F.length("text") <= MODEL_CHARS).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MODEL_DOCUMENTS).collect()
    return BoundaryModel([r.text for r in rows])


def sentence_units(documents: DataFrame, model: BoundaryModel | None = None) -> DataFrame:
    """doc_id, start_pos, end_pos of every unit of every document."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or fit(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for doc_id, text in zip(b.doc_id, b.text):
                for start, end in units(text, model):
                    ids.append(doc_id), starts.append(start), ends.append(end)
                if len(ids) > 200_000:
                    yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "start_pos": starts, "end_pos": ends})
                    ids, starts, ends = [], [], []
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "start_pos": pd.array(starts, dtype="int32"), "end_pos": pd.array(ends, dtype="int32")})

    return spread(texts.where("text is not null")).mapInPandas(run, "doc_id bigint, start_pos int, end_pos int")

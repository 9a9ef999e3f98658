"""Whether a text ends where it should: a stack automaton and a model of the contexts in which texts end."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Mapping

import numpy as np

TERMINATORS = ".!?。！？…｡।॥‽"
CLOSERS = "\"'”’»›)]}」』】）》〉*_`“"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "«": "»"}
_CLOSING = {v: k for k, v in _PAIRS.items()}
_TAG = re.compile(r"<(/?)([A-Za-z_][\w.-]*)(?:\s[^<>]*)?(/?)>")
_TAG_START = re.compile(r"</?(?:[A-Za-z_][\w.-]*)?(?:\s[^<>]*)?$")
_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_STOP = re.compile(r'[<"“”„(\[{（「『【《«)\]}）」』】》»]')
_BROKEN = re.compile(r"(?:�|[\ud800-\udfff]|\\(?:u[0-9a-fA-F]{0,3})?|&#?\w{0,7})$")


def open_items(text: str) -> list[str]:
    """What is still open at the end of text, outermost first: tags, brackets, quotes, a broken last character or escape.

    Within a bracketed object quotes are those of JSON, with escapes; elsewhere a straight
    quote opens and closes, and a bracket of another kind closes nothing.
    """
    stack: list[str] = []
    at, end = 0, len(text)
    while at < end:
        m = _STOP.search(text, at)
        if not m:
            break
        at, c = m.start(), m.group()
        if c == "<":
            if t := _TAG.match(text, at):
                shut, name, alone = t.groups()
                if shut:
                    if name in (x[1:] for x in stack if x[0] == "<"):
                        while stack.pop() != f"<{name}":
                            pass
                elif not alone:
                    stack.append(f"<{name}")
                at = t.end()
            elif _TAG_START.match(text, at) and len(text) - at <= 40:
                return [*stack, text[at:]]
            else:
                at += 1
        elif c == '"':
            if stack and stack[-1] in "{[":
                s = _STRING.match(text, at + 1)
                if not s:
                    return [*stack, '"']
                at = s.end()
            else:
                if stack and stack[-1] == '"':
                    stack.pop()
                else:
                    stack.append('"')
                at += 1
        elif c in "“„":
            if c == "“" and stack and stack[-1] == "„":
                stack.pop()
            else:
                stack.append(c)
            at += 1
        elif c == "”":
            if stack and stack[-1] in "“„":
                stack.pop()
            at += 1
        elif c in _PAIRS:
            stack.append(c)
            at += 1
        else:
            want = _CLOSING[c]
            if want in stack:
                while stack.pop() != want:
                    pass
            at += 1
    if _BROKEN.search(text):
        stack.append("broken character")
    return stack


_CALL = re.compile(r"(?:[A-Z][A-Z_]{2,}\([^()\n]*\)|</[\w.-]+>|[}\]])\s*$")


def ending(text: str) -> str:
    """'broken' with something still open, 'closed' after a terminator, closing tag, object or call, else 'open'."""
    text = text.rstrip()
    if open_items(text):
        return "broken"
    if _CALL.search(text):
        return "closed"
    bare = text.rstrip(CLOSERS)
    return "closed" if bare and bare[-1] in TERMINATORS else "open"


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]|_", re.UNICODE)
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")


def words(text: str) -> list[str]:
    """Words, digits and signs in order; a script without spaces gives single characters."""
    if not _SPACELESS.search(text):
        return _WORD.findall(text)
    out: list[str] = []
    for w in _WORD.findall(text):
        if _SPACELESS.search(w):
            out += re.findall(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|[^぀-ヿ㐀-鿿豈-﫿฀-๿]+", w)
        else:
            out.append(w)
    return out


def _mask(word: str) -> str:
    return "0" if word.isdigit() else "N" if word[:1].isupper() and len(word) > 1 else word


_SEGMENT = re.compile(r"[^.!?。！？…।\n]+[.!?。！？…।]?")
_TAGS = re.compile(r"</?[A-Za-z_][\w.-]*(?:\s[^<>]*)?>")


def segments(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SEGMENT.findall(_TAGS.sub("\n", text))) if s]


#: Texts to which the least numbers of TerminalContexts refer.
PER = 20_000


class TerminalContexts:
    """How segments that begin alike end in a body of texts.

    For each opening (first two words) it counts the segments with and without a
    terminator, and the last words of those without. A text that ends openly is complete if
    its opening mostly has no terminator and its last word, names and numbers masked, ended
    at least two other such segments or is a word known from elsewhere. A text of one or two
    words is complete if it stands alone at least five times and more often than it goes on.
    These numbers are rates per PER texts, as among more texts each loss occurs again.
    """

    def __init__(self, texts: list[str]):
        self.counts: Counter = Counter()
        self.scale = self.scaled(sum(bool(t and t.strip()) for t in texts))
        for text in texts:
            if not text or ending(text) == "broken":
                continue
            for s in segments(text):
                self.counts.update(self.counted(words(s)))

    @staticmethod
    def scaled(texts: int) -> float:
        """What the least numbers are multiplied by, for so many texts."""
        return max(1.0, texts / PER)

    @staticmethod
    def _opening(w: list[str]) -> str:
        if _SPACELESS.match(w[0]):
            return " ".join(w[:3])
        return f"{w[0].lower()} {_mask(w[1]) if len(w) > 1 else ''}"

    @classmethod
    def counted(cls, w: list[str]) -> list[str]:
        """What a segment of these words is counted as; words hold no spaces."""
        if not w:
            return []
        key = cls._opening(w)
        out = [f"known {x}" for x in set(w[:-1])] + [f"begun {' '.join(w[:k])}" for k in range(1, min(len(w), 4))]
        if len(w) <= 3:
            out.append(f"whole {' '.join(w)}")
        return out + ([f"closed {key}"] if w[-1] in TERMINATORS else [f"open {key}", f"last {_mask(w[-1])} {key}"])

    @classmethod
    def asked(cls, w: list[str]) -> list[str]:
        """The counts that ended() needs for these words."""
        key = cls._opening(w) if w else ""
        return [f"whole {' '.join(w)}", f"begun {' '.join(w)}", f"known {w[-1]}", f"open {key}", f"closed {key}", f"last {_mask(w[-1])} {key}"] if w else []

    @classmethod
    def ended(cls, w: list[str], counts: Mapping[str, int], scale: float) -> bool:
        """Whether a text is complete whose last segment has these words."""
        if not w:
            return True
        whole, begun, known, opened, closed, last = (counts.get(x, 0) for x in cls.asked(w))
        if len(w) <= 2 or _SPACELESS.match(w[0]) and len(w) <= 3:
            # it stands alone at least five times, and more often than it goes on
            return whole > max(4 * scale, begun) and (known > scale or not w[-1].isalpha())
        if opened <= closed:
            return whole > 4 * scale
        return last > 2 * scale or known > scale

    def complete(self, text: str) -> bool:
        found = segments(text)
        return self.ended(words(found[-1]) if found else [], self.counts, self.scale)


#: Features of a text, those that add up to its length, and texts without which there is no model.
N_FEATURES, LENGTH, LEAST_TEXTS = 13, [0, 2, 5, 6, 8, 10], 30
_FEATURE = re.compile(r"(?P<cjk>[㐀-鿿豈-﫿])|(?P<kana>[぀-ヿ฀-๿ऀ-ॿ])|(?P<word>(?:(?![぀-ヿ㐀-鿿豈-﫿฀-๿ऀ-ॿ])[^\W\d_])+)|(?P<digits>\d+)|(?P<sign>[^\w\s]|_)|(?P<line>\n)")


def token_features(text: str) -> list[float]:
    """Counts from which a tokenizer's length is estimated: signs by kind, words, their quarters, digits and their groups."""
    n = [0.0] * N_FEATURES
    structured = 0
    for m in _FEATURE.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "cjk":
            n[0] += 1
        elif kind == "kana":
            n[8] += 1
        elif kind == "word":
            n[1] += 1
            n[2] += math.ceil(len(s) / 4)
        elif kind == "digits":
            n[3] += 1
            n[4] += len(s)
            n[10] += math.ceil(len(s) / 2)
            n[11] += math.ceil(len(s) / 3)
            n[12] += math.ceil(len(s) / 4)
        elif kind == "sign":
            n[5] += 1
            structured += s in '{}[]":<>/'
        else:
            n[6] += 1
    n[7] = structured
    n[9] = 1.0
    return n


def token_share(expected: float, tokens: float) -> float:
    """Tokens that a text lacks, as a share of what it should have."""
    return (tokens - max(8.0, expected)) / max(8.0, expected)


class TokenModel:
    """Least squares of token counts on token_features, fitted four times: outliers of a fit are left out of the next.

    Rows are divided by their length, in tokens or, where there is more of it, in signs and
    parts of words: every text weighs the same, so that a few very long ones, or absurd
    counts, decide nothing.
    """

    def __init__(self, texts: list[str], tokens: list[float]):
        self.weights = None
        if len(texts) < LEAST_TEXTS:
            return
        x, y = np.array([token_features(t) for t in texts]), np.array(tokens, float)
        scaled = np.column_stack([x, y]) / np.maximum(np.maximum(8.0, y), x[:, LENGTH].sum(axis=1))[:, None]
        error = lambda w: np.abs(y - x @ w) / np.maximum(8.0, x @ w)
        self.fit(len(y), lambda w, most: scaled if w is None else scaled[error(w) < most], lambda w: float(np.median(error(w))))

    def fit(self, n: int, factor: Callable, median: Callable) -> TokenModel:
        """From n rows: factor(weights, most) gives the scaled rows with an error below most (all without weights), or a triangular factor of them; median(weights) that of all errors."""
        most = None
        for round_ in range(4):
            r = factor(self.weights, most)
            self.weights, *_ = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=np.finfo(float).eps * max(n, r.shape[1]))
            most = 4 * max(0.01, median(self.weights) * 1.4826) if round_ < 3 else None
        return self

    def excess(self, text: str, tokens: float) -> float:
        """Tokens that the text lacks, as a share of what it should have; 0 without a model."""
        return 0.0 if self.weights is None else token_share(float(np.dot(token_features(text), self.weights)), tokens)

"""The same or nearly the same goal in different splits.

A goal becomes a sequence: its content words in order, actions by their canonical names,
numbers, and between them the roles that function words give (to, in, with, ...) and the
breaks between clauses; courtesy and articles go. Goals of one sequence are one class, so
that copies are never compared with each other.

Classes that may set the same task are met over the words that a match needs, so that none
is missed. Words are alike if a slip or two make one the other; these pairs are found over
the letters that both have when one is left out, and over their sorted letters. Of the words
that another goal must have, every train class asks for the one that leads to the fewest
held-out classes, together with all its numbers; where these are more than COMMON for two of
them together, so that no frequent name, app or day alone brings goals together. Every
held-out class is met by all its words. (Winnowed fingerprints of words, which served here
before, miss goals in which slips spoil several of the rarest words.)

The shared words of a pair are its seeds: equal words are chained while they keep
their order, chains are extended over spelling slips by alignment, and the pair is kept if
the chains cover all content and every chain that stands elsewhere in the other goal is a
clause or a phrase with the same role there: clauses may move, but names may not change
places.

Defined results: a null or blank goal or null episode_id takes no part; a null or unknown
split belongs to no side; an episode in both sides is paired with others in either role,
never with itself; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.cluster import cut, small, spread
from stepweave.functions.text import SPLITS, canonical

#: Letters of a fingerprint, fingerprints of a window.
GRAM, WINDOW = 4, 8
#: Places of a variant that lacks no letter, and of sorted letters that lack one; stands for the words of a class without any that must be met.
WHOLE, LESS, NONE = -1, -2, ""
#: Held-out classes to which a word may lead alone.
COMMON = 1_000
#: Letters of a word in which slips are looked for: a longer run of letters must be equal. Words that may be left after equal ones were matched: these, or half of the goal's.
WORD, LEFT = 64, 12

# Words of courtesy and articles, which say nothing.
COURTESY = frozenset(
    # en
    "a an the please thanks thank you your ok okay hey hi hello could can would will i me my m d ll s it its is be want like need kindly just that this up go "
    # de
    "bitte danke kannst könntest würdest du mir der die das den dem des ein eine einen einem hey hallo mal ich möchte hinzu "
    # es
    "por-favor gracias oye hola puedes podrías me mi el la los las un una quiero "
    # fr
    "s'il te plaît merci peux tu le la les un une".split()
)
COURTESY_SIGNS = frozenset("请麻烦你您帮我谢吧好吗啊呢操作个了选")
# Function words that give what follows its role, by the role's name.
ROLES = {
    "with": "with using use via through mit con avec 用", "in": "in im en dans 在 中 里", "to": "to a al à au aux zu zur zum 到", "for": "for für para pour 给 为", "of": "of de del des von 的", "on": "on am auf an sur", "at": "at um", "by": "by bei por nach",
    "from": "from 从", "object": "把 将",
    "called": "called labelled labeled named titled namens llamada llamado 名称为 名为",
}
# Words between clauses.
BREAKS = frozenset("and or then first also und sowie dafür dann zuerst erst vorher y e o u antes primero luego et ou 并 且 和 先 再".split())
# Actions with the words for them.
ACTIONS = {
    "search": "find search look-up suche finde busca encuentra cherche trouve 搜索 查找", "share": "share send-round teile comparte partage 分享 转发", "open": "open launch start öffne starte abre inicia ouvre lance 打开 启动",
    "add": "add put füge trage añade agrega pon ajoute 添加到 添加 加入到 加入", "set": "set stelle setze 设置 设定",
}
# Other words for one content word, and the days of the week.
SAME = {"each": "every", "all": "every", "jeder": "jede", "jedes": "jede", "todos": "cada", "todas": "cada"}
DAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes sábado domingo lundi mardi mercredi jeudi vendredi samedi dimanche 周".split())
_ROLE_OF = {w: role for role, ws in ROLES.items() for w in ws.split()}
_ACTION_OF = {w: f"!{name}" for name, ws in ACTIONS.items() for w in ws.split()}
_SPELLINGS = {f"!{name}": [w for w in ws.split() if w.isascii() or w[0] < "⺀"] for name, ws in ACTIONS.items()}
_WORDING = tuple(sorted(w for w in (COURTESY | BREAKS | set(_ROLE_OF)) if len(w) >= 4))
# Words that show that "a" is Spanish "to", no article.
_SPANISH = frozenset("el la los las del al y en por con una un".split())
_PHRASE_OF = {w: x for w, x in [*_ACTION_OF.items(), *((w, f"~{r}") for w, r in _ROLE_OF.items())] if "-" in w or w[0] > "⺀" and len(w) > 1}
_PHRASES = re.compile("|".join(sorted((w.replace("-", r"\s+") for w in _PHRASE_OF), key=len, reverse=True)))
_TOKEN = re.compile(r"[!~][a-z]+|\d+(?:[:.,]\d+)*|[぀-ヿ㐀-鿿豈-﫿]|(?:(?![぀-ヿ㐀-鿿豈-﫿])[^\W\d_])+(?:[̀-ͯ]+)?|[,;.!?:，；。、！？：]")
_REPEATED = re.compile(r"([^\W\d_])\1+")
_SPACED = re.compile(r"(?<=[㐀-鿿豈-﫿])\s+(?=[㐀-鿿豈-﫿])")
_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+|\d{1,3}(?:\.\d{3})+")


def content(goal: str) -> tuple[str, list[str]]:
    """(the goal's sequence, its numbers sorted): content words, '~role' before what has one, '&' between clauses."""
    text = "".join(c for c in unicodedata.normalize("NFKC", goal) if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace()).casefold()
    text = re.sub("[!~]", " ", unicodedata.normalize("NFC", text))
    text = _SPACED.sub("", text.replace("por favor", " "))
    text = _PHRASES.sub(lambda m: f" {_PHRASE_OF[re.sub(r'\s+', '-', m[0])]} ", text)
    out: list[str] = []
    numbers: list[str] = []
    tokens = _TOKEN.findall(text)
    spanish = not _SPANISH.isdisjoint(tokens)
    for t in tokens:
        if t[0].isdigit():
            t = re.sub("[.,]", "", t) if _GROUPED.fullmatch(t) else t
            numbers.append(t)
            out.append(t)
        elif t in _ACTION_OF:
            out.append(_ACTION_OF[t])
        elif t[0] == "~" or t in _ROLE_OF and (t != "a" or spanish):
            # of several function words the last one counts
            if out and out[-1][0] == "~":
                out.pop()
            out.append(t if t[0] == "~" else f"~{_ROLE_OF[t]}")
        elif t in BREAKS or t in ",;.!?:，；。、！？：":
            if out and out[-1] != "&" and out[-1][0] != "~":
                out.append("&")
        elif t not in COURTESY and t not in COURTESY_SIGNS:
            out.append(SAME.get(t, t))
    while out and out[-1][0] in "&~":
        out.pop()
    return " ".join(out), sorted(numbers)


def contents(sequence: str) -> tuple[list[str], list[str]]:
    """(content words, what stands before each: a role, '&', '^' at the start, or '')."""
    words: list[str] = []
    before: list[str] = []
    mark = "^"
    for t in sequence.split():
        if t[0] == "~":
            mark = t
        elif t == "&":
            mark = t if mark != "^" else mark
        else:
            # "I want to" comes before the first word
            before.append("^" if not words and mark == "~to" else mark)
            words.append(t)
            mark = ""
    return words, before


def fingerprints(word: str, gram: int = GRAM, window: int = WINDOW) -> list[str]:
    """Of the word between marks, the runs of letters whose rolling hash is the smallest of a window (the first of equal ones), in order."""
    padded = f"^{word}$"
    if len(padded) <= gram:
        return [padded]
    base, mod = 257, (1 << 61) - 1
    top = pow(base, gram - 1, mod)
    h = 0
    for c in padded[:gram]:
        h = (h * base + ord(c)) % mod
    # a multiplication spreads the hash, as letters alone would favour the alphabet's start
    hashes = [h * 0x9E3779B97F4A7C15 % mod]
    for i in range(gram, len(padded)):
        h = ((h - ord(padded[i - gram]) * top) * base + ord(padded[i])) % mod
        hashes.append(h * 0x9E3779B97F4A7C15 % mod)
    kept: list[int] = []
    for start in range(max(1, len(hashes) - window + 1)):
        least = min(range(start, min(start + window, len(hashes))), key=lambda i: (hashes[i], i))
        if not kept or kept[-1] != least:
            kept.append(least)
    return [padded[i : i + gram] for i in kept]


def slips(a: str, b: str, most: int) -> bool:
    """Whether b is a with at most so many letters left out, put in or swapped with their neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = before[j - 1] if x == y else min(before[j], row[-1]) + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before2[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return False
        before2, before = before, row
    return before[-1] <= most


def _squeezed(word: str) -> str:
    """A long word with letters written several times in a row once."""
    return _REPEATED.sub(r"\1", word) if len(word) >= 5 and word[0] != "!" else word


def _same_word(a: str, b: str) -> bool:
    if a[0] == "!" or b[0] == "!":
        # an action is any of its words
        return any(_same_word(x, y) for x in _SPELLINGS.get(a, [a]) for y in _SPELLINGS.get(b, [b])) if (a[0] == "!") != (b[0] == "!") else a == b
    if a[0].isdigit() or b[0].isdigit():
        return a == b
    return _slipped(a, b) or min(len(a), len(b)) >= 5 and _slipped(_squeezed(a), _squeezed(b))


def _slipped(a: str, b: str) -> bool:
    # a letter left out or put in changes the letters by one, a swap not at all
    shorter = min(len(a), len(b))
    if not 3 <= shorter <= WORD or abs(len(a) - len(b)) > 1 or len(set(a) ^ set(b)) > 2:
        return False
    if slips(a, b, 1):
        return True
    # two slips, one in either goal, only in long words; another letter at one place is no slip
    if shorter < 6 or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
        return False
    return ((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).total() <= 2 and slips(a, b, 2)


def _shortened(word: str, most: int) -> set[str]:
    """The word with up to so many letters left out: two words that slips tell apart share one."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out |= last
    return out


_NEAR_WORDING: dict[str, list[str]] = {}
for _w in _WORDING:
    for _v in _shortened(_w, 2 if len(_w) >= 5 else 1):
        _NEAR_WORDING.setdefault(_v, []).append(_w)


def _wording(word: str) -> str | None:
    """The function word that a word is a misspelling of: one slip, in a long one two."""
    if not 3 <= len(word) <= 16:
        return None
    near = sorted({w for v in _shortened(word, 2 if len(word) >= 5 else 1) for w in _NEAR_WORDING.get(v, ())})
    return next((w for w in near if _same_word(word, w) or min(len(word), len(w)) >= 5 and slips(word, w, 2)), None)


def _is_wording(word: str) -> bool:
    return _wording(word) is not None


def _heard(words: list[str], left: set[int], before: list[str]) -> list[str]:
    """before, with the roles and breaks of misspelt function words, which are left over as content."""
    out = list(before)
    for i in sorted(left):
        meant = _wording(words[i])
        if meant and i + 1 < len(words) and not out[i + 1]:
            out[i + 1] = f"~{_ROLE_OF[meant]}" if meant in _ROLE_OF else "&" if meant in BREAKS else out[i]
    return out


def _is_sign(word: str) -> bool:
    return len(word) == 1 and word > "⺀"


def matched(a: list[str], b: list[str], before_a: list[str], before_b: list[str]) -> dict[int, int]:
    """Place in b of every word of a that has one: equal words, those first that go on with the chain or have the same role, then misspelt ones."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    pair: dict[int, int] = {}
    taken: set[int] = set()
    last = -2
    for i, w in enumerate(a):
        free = [j for j in places.get(w, ()) if j not in taken]
        if free:
            last = min(free, key=lambda j: (j != last + 1, before_a[i] != before_b[j], j))
            pair[i] = last
            taken.add(last)
    left = [j for j in range(len(b)) if j not in taken]
    # slips spoil a few words; goals of which more differ are other ones
    if len(left) > max(LEFT, len(b) // 2) or len(a) - len(pair) > max(LEFT, len(a) // 2):
        return pair
    for i, w in enumerate(a):
        if i in pair:
            continue
        near = [j for j in left if _same_word(w, b[j])]
        if near:
            j = min(near, key=lambda j: (j - 1 != pair.get(i - 1, -9), j + 1 != pair.get(i + 1, -9), j))
            pair[i] = j
            left.remove(j)
    return pair


def consistent(a: list[str], pair: dict[int, int], before_a: list[str], before_b: list[str]) -> bool:
    """Whether every chain that moved is a phrase with one role in both goals, or, these apart, a clause."""
    order = sorted(pair)
    while True:
        place = {j: n for n, j in enumerate(sorted(pair[i] for i in order))}
        chains: list[list[int]] = []
        for i in order:
            if chains and place[pair[i]] == place[pair[chains[-1][-1]]] + 1:
                chains[-1].append(i)
            else:
                chains.append([i])
        if len(chains) < 2:
            return True
        # the day and the time of day need no role if they are the only ones
        days, times = [i for i in order if a[i] in DAYS], [i for i in order if ":" in a[i]]
        alone = {x[0] for x in (days, times) if len(x) == 1}
        moved = {i for c in chains if c[0] in alone or before_a[c[0]] == before_b[pair[c[0]]] and before_a[c[0]][:1] == "~" for i in c}
        if not moved:
            break
        order = [i for i in order if i not in moved]
    for n, c in enumerate(chains):
        in_a = not n or before_a[c[0]] in ("^", "&")
        in_b = not place[pair[c[0]]] or before_b[pair[c[0]]] in ("^", "&")
        if a[c[0]][0] != "!" and not (in_a and in_b):
            return False
    return True


def aligned(a: str, b: str) -> tuple[float, float] | None:
    """Covered shares of the letters of two sequences that set the same task, else None."""
    (wa, ra), (wb, rb) = contents(a), contents(b)
    pair = matched(wa, wb, ra, rb)
    there = set(pair.values())
    left_a, left_b = [w for i, w in enumerate(wa) if i not in pair], [w for j, w in enumerate(wb) if j not in there]
    signs_a, signs_b = [x for x in left_a if _is_sign(x)], [x for x in left_b if _is_sign(x)]
    # in a script without spaces a slip leaves out or repeats a sign
    if signs_a and signs_b or len(signs_a) + len(signs_b) > 1:
        return None
    for left, other in ((left_a, wb), (left_b, wa)):
        # a word written twice says no more than once
        if not all(_is_sign(x) or x in other and not x[0].isdigit() or _is_wording(x) for x in left):
            return None
    if not consistent(wa, pair, _heard(wa, set(range(len(wa))) - pair.keys(), ra), _heard(wb, set(range(len(wb))) - there, rb)):
        return None
    size = lambda ws: max(1, sum(map(len, ws)))
    return 1 - size(left_a) / size(wa) if left_a else 1.0, 1 - size(left_b) / size(wb) if left_b else 1.0


def goals(episodes: DataFrame) -> DataFrame:
    """episode_id, source, split (canonical), side ('train' or 'held'), words (the sequence), numbers of every episode with a goal and a side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [content(g) for g in b.goal]
            yield b[["episode_id", "source", "split"]].assign(words=[w for w, _ in both], numbers=[" ".join(n) for _, n in both])

    rows = spread(episodes.select("episode_id", "source", canonical(F.col("split"), SPLITS).alias("split"), "goal").where("split is not null and goal is not null and episode_id is not null"))
    made = rows.mapInPandas(run, "episode_id string, source string, split string, words string, numbers string")
    return made.where("words <> ''").withColumn("side", F.when(F.col("split") == "train", "train").otherwise("held"))


def forms(word: str) -> set[str]:
    """What is compared of a word: itself, or an action's words, and each without letters written several times in a row."""
    return {f for x in _SPELLINGS.get(word, [word]) for f in (x, _squeezed(x))}


def variants(word: str) -> set[tuple[str, int]]:
    """(variant, place): of two words of which _same_word holds, one variant is the same, its places different or both WHOLE.

    With a slip or two one form is the other, or both are the same without a letter of
    different places (a letter put in, left out, both, or a swap); two swaps, or a swap and
    a letter, leave the sorted letters the same, or the same without one. The place of
    letters in a row is that of the first.
    """
    out = set()
    for f in forms(word):
        out.add((f, WHOLE))
        if 3 <= len(f) <= WORD + 1:
            out |= {(f[:k] + f[k + 1 :], k) for k in range(len(f)) if not k or f[k] != f[k - 1]}
            if len(f) >= 6:
                x = "".join(sorted(f))
                out |= {(f"#{x}", WHOLE), *((f"#{x[:k]}{x[k + 1 :]}", LESS) for k in range(len(x)))}
    return out


def keys(found: list[tuple[bool, int, str, list[str]]], common: int = COMMON) -> list[str]:
    """What a train class asks for, so that every class of the same task has one of these words or pairs of words. found: (sure, classes it leads to, word, words like it) of its distinct words.

    Words that are sure stand in the other goal too, or like ones: the one that leads to the
    fewest classes is asked, or, if these are more than common, two of them together. Of
    signs one may be left out, so that either of two is asked. A class that has neither asks
    for all of its words and for the classes that have neither (NONE).
    """
    sure, signs = sorted(x for x in found if x[0]), sorted(x for x in found if _is_sign(x[2]))
    if len(sure) > 1 and sure[0][1] > common:
        return sorted({" ".join(sorted((x, y))) for x in sure[0][3] for y in sure[1][3]})
    asked = sure[:1] or signs[:2] if NONE not in (x[2] for x in found) else found
    return sorted({w for x in asked for w in x[3]})


def class_pairs(classes: DataFrame, common: int = COMMON) -> DataFrame:
    """Pairs of different classes, one with train, one with held-out goals, that set the same task: words_a (train), words_b, numbers, coverage_a, coverage_b."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for b in batches:
            rows = []
            for at, numbers, in_train, in_held, sequence in zip(b["class"], b.numbers, b.in_train, b.in_held, b.words):
                own = {w for w in contents(sequence)[0] if not w[0].isdigit()}
                for w in own - known.keys():
                    # a misspelt "please" may be left out
                    known[w] = not _is_sign(w) and not _is_wording(w)
                if not any(known[w] for w in own) and sum(map(_is_sign, own)) < 2:
                    own.add(NONE)
                rows += [(at, numbers, in_train, in_held, w, w != NONE and known[w]) for w in own]
                if len(known) > 500_000:
                    known.clear()
            yield pd.DataFrame(rows, columns=["class", "numbers", "in_train", "in_held", "word", "sure"])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, v, k) for w in b.word for v, k in variants(w)], columns=["word", "variant", "place"])

    def like(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[_same_word(x, y) for x, y in zip(b.word, b.like)]]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(at, numbers, w) for at, numbers, found in zip(b["class"], b.numbers, b.found) for w in keys([(x["sure"], x["n"], x["word"], list(x["like"])) for x in found], common)]
            yield pd.DataFrame(rows, columns=["class", "numbers", "word"])

    classes = classes.withColumn("class", F.xxhash64("words", "numbers"))
    each = cut(spread(classes).mapInPandas(split, "class bigint, numbers string, in_train boolean, in_held boolean, word string, sure boolean"))
    vocabulary = cut(each.groupBy("word").agg(F.count_if("in_held").alias("n")))
    spelled = cut(vocabulary.select("word").mapInPandas(spell, "word string, variant string, place int").select("word", "place", F.xxhash64("variant").alias("variant")))
    other = spelled.select(F.col("word").alias("like"), F.col("place").alias("there"), "variant")
    near = spelled.join(other, "variant").where(f"word < like and (place <> there or place = {WHOLE})").select("word", "like").distinct().repartition(2 * classes.sparkSession.sparkContext.defaultParallelism).mapInPandas(like, "word string, like string")
    near = cut(near)
    near = near.unionByName(near.select(F.col("like").alias("word"), F.col("word").alias("like"))).unionByName(vocabulary.select("word", F.col("word").alias("like")))
    near = cut(near.join(vocabulary.withColumnRenamed("word", "like"), "like").groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("like").alias("like")))
    listed = each.where("in_train").join(near, "word").groupBy("class", "numbers").agg(F.collect_list(F.struct("sure", "n", "word", "like")).alias("found"))
    key = F.xxhash64("word", "numbers").alias("key")
    asked = listed.mapInPandas(ask, "class bigint, numbers string, word string").select(F.col("class").alias("class_a"), key)
    # words like one that leads to many classes are met in pairs too
    often = small(near.where(F.col("n") > common).select(F.explode("like").alias("word")).distinct())
    several = each.where("in_held").join(often, "word").groupBy("class", "numbers").agg(F.collect_set("word").alias("words"))
    pairs = several.withColumn("other", F.explode("words")).withColumn("word", F.explode("words")).where("word <= other").withColumn("word", F.concat_ws(" ", "word", "other"))
    held = each.where("in_held").select("class", "numbers", "word").unionByName(pairs.select("class", "numbers", "word")).select(F.col("class").alias("class_b"), key)
    met = asked.join(held, "key").where("class_a <> class_b").select("class_a", "class_b").distinct()
    a = classes.where("in_train").select(F.col("class").alias("class_a"), F.col("words").alias("words_a"), "numbers")
    b = classes.where("in_held").select(F.col("class").alias("class_b"), F.col("words").alias("words_b"), F.col("numbers").alias("numbers_b"))
    near = met.join(a, "class_a").join(b, "class_b").where("words_a <> words_b and numbers = numbers_b").select("words_a", "words_b", "numbers")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [aligned(x, y) for x, y in zip(p.words_a, p.words_b)]
            kept = [f is not None for f in found]
            yield p[kept].assign(coverage_a=[f[0] for f in found if f], coverage_b=[f[1] for f in found if f])

    return near.mapInPandas(verify, "words_a string, words_b string, numbers string, coverage_a double, coverage_b double")


def linked(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: episode_id, side, split, source, words, numbers, each once; pairs of their classes: words_a, words_b, numbers, coverage_b)."""
    rows = cut(goals(episodes).groupBy("episode_id", "side", "split", "words", "numbers").agg(F.min("source").alias("source")))
    classes = cut(rows.groupBy("words", "numbers").agg(F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "held").alias("in_held")))
    same = classes.where("in_train and in_held").select(F.col("words").alias("words_a"), F.col("words").alias("words_b"), "numbers", F.lit(1.0).alias("coverage_b"))
    return rows, same.unionByName(class_pairs(classes).drop("coverage_a"))


def overlaps(episodes: DataFrame) -> DataFrame:
    """train_id, held_id, split and source of the held-out episode, coverage of its content by the train goal."""
    rows, pairs = linked(episodes)
    train = rows.where("side = 'train'").select(F.col("episode_id").alias("train_id"), F.col("words").alias("words_a"), "numbers").distinct()
    held = rows.where("side = 'held'").select(F.col("episode_id").alias("held_id"), F.col("words").alias("words_b"), "numbers", "split", "source")
    return pairs.join(train, ["words_a", "numbers"]).join(held, ["words_b", "numbers"]).where("train_id <> held_id").select("train_id", "held_id", "split", "source", F.col("coverage_b").alias("coverage"))


def found(episodes: DataFrame) -> DataFrame:
    return overlaps(episodes).select(F.least("train_id", "held_id").alias("episode_a"), F.greatest("train_id", "held_id").alias("episode_b")).distinct()


def report(episodes: DataFrame) -> DataFrame:
    """Per held-out split and source: goals of held-out episodes that have a partner in train, and the pairs, from the sizes of the classes.

    A pair is a held-out episode's goal with a train episode's; an episode delivered with
    goals of several classes counts with each of them.
    """
    rows, pairs = linked(episodes)
    pairs = cut(pairs)
    sizes = rows.where("side = 'train'").select("episode_id", F.col("words").alias("words_a"), "numbers").distinct().groupBy("words_a", "numbers").agg(F.count("*").alias("n"))
    partners = pairs.join(sizes, ["words_a", "numbers"]).groupBy("words_b", "numbers").agg(F.sum("n").alias("partners"))
    # an episode in both sides is no partner of itself
    of_train = rows.where("side = 'train'").select("episode_id", F.col("words").alias("words_a"), "numbers").distinct()
    both = rows.where("side = 'held'").select("episode_id", F.col("words").alias("words_b"), "numbers", "split", "source").join(of_train, ["episode_id", "numbers"]).join(pairs.select("words_a", "words_b", "numbers"), ["words_a", "words_b", "numbers"])
    itself = both.groupBy("words_b", "numbers", "split", "source", "episode_id").agg(F.count("*").alias("own")).groupBy("words_b", "numbers", "split", "source", "own").agg(F.count("*").alias("n_own"))
    held = rows.where("side = 'held'").select(F.col("words").alias("words_b"), "numbers", "split", "source").groupBy("words_b", "numbers", "split", "source").agg(F.count("*").alias("n_held"))
    whole = held.join(partners, ["words_b", "numbers"]).select("split", "source", F.col("n_held").alias("n_episodes"), (F.col("n_held") * F.col("partners")).alias("n_pairs"))
    less = itself.join(partners, ["words_b", "numbers"]).select("split", "source", F.when(F.col("partners") == F.col("own"), -F.col("n_own")).otherwise(0).alias("n_episodes"), (-F.col("own") * F.col("n_own")).alias("n_pairs"))
    return whole.unionByName(less).groupBy("split", "source").agg(F.sum("n_episodes").alias("n_episodes"), F.sum("n_pairs").alias("n_pairs")).where("n_pairs > 0")

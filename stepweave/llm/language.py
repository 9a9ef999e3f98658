"""Language of a short text: scripts, and dictionaries of function words."""

from __future__ import annotations

import re

# Frequent function words and the verbs of short step descriptions, by language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on is are was it this that for with by be at from so i will into before after as not next now which must no there open then whether using my last first one had has have what any do does please".split(),
    "de": "der die das ein eine einen einem einer und oder zu in auf ist sind war es dies für mit von dem den des im am nicht ich jetzt wird muss noch bevor als nach aus bei sich schon also deshalb bis um dann öffne tippe letzte nichts bitte".split(),
    "es": "el la los las un una y o de a en es son está era esto que para con por del al no ahora lo se ya más hay antes así como debo todavía siguiente última solo otra paso sigue tuvo hace eso esta mi le abre".split(),
    "fr": "le la les un une des et ou de à en est sont était ce cette que pour avec par du au aux ne pas je il elle sur dans se déjà plus avant comme encore dois qui prochaine étape donc ouvre dernière puis".split(),
    # of these only words that the four above do not have
    "it": "il lo gli di che è non del della nel nella sul alla dello degli delle sono ma anche più questo questa poi già devo ancora quindi perché così tocco apro".split(),
    "pt": "não uma os ao dos das pelo pela você está são já também mas muito isso esta este ainda então depois agora foi tem preciso abro toco".split(),
    "nl": "het een van dat niet ik te met voor aan zijn er naar nog maar ook dit wordt deze daarom omdat moet".split(),
    "sv": "och att det är som för på inte jag med till har av detta nu måste".split(),
    "pl": "nie się że jest dla już oraz jeszcze który muszę teraz przed".split(),
    "tr": "ve bir bu için değil çok ile olarak daha şimdi önce".split(),
}
_ONLY = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}
# Letters that only one of these languages has.
LETTERS = {"de": set("äöüß"), "es": set("ñáíóú"), "fr": set("çèêàùîôœ"), "pt": set("ãõ"), "sv": set("å"), "pl": set("łąęśćżźń"), "tr": set("ğış")}
_SCRIPTS = (("ja", re.compile(r"[぀-ゟ゠-ヺー-ヿ]")), ("zh", re.compile(r"[㐀-鿿]")), ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ko", re.compile(r"[가-힣]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("el", re.compile(r"[Ͱ-Ͽ]")))
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


def language(text: str) -> str | None:
    """The code of the language that most of the text is in; None where too little tells."""
    scripts = {code: 0 if text.isascii() else len(p.findall(text)) for code, p in _SCRIPTS}
    if scripts["ja"]:
        scripts["ja"] += scripts.pop("zh")
    code, most = max(scripts.items(), key=lambda x: x[1])
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _WORD.findall(text.lower()):
        for lang in (langs := _ONLY.get(w, ())):
            votes[lang] += 1 / len(langs)
        if not w.isascii():
            for lang, letters in LETTERS.items():
                if not letters.isdisjoint(w):
                    votes[lang] += 0.5
    if most >= 2 and most >= 3 * sum(votes.values()):
        return code
    (best, score), (_, second) = sorted(votes.items(), key=lambda x: -x[1])[:2]
    return best if score >= 1 and score > 1.3 * second else None

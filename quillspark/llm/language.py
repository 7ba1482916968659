"""The language of a text by its function words and script; enough to tell the languages of a corpus apart."""

from __future__ import annotations

import re

from quillspark.llm.words import folded, words

# Frequent function words of each language, without accents.
FUNCTION_WORDS = {
    "en": "the and to of i my me it was in that is for with you this on not so at be he she we they are just she but what when from have had her his about if by",
    "fr": "le la les de des du un une et je mon ma mes que qui ne pas pour avec dans est sur au aux ce cette il elle nous vous depuis suis ai mais ou en plus me moi sont",
    "de": "der die das und ich ist nicht ein eine einen mit mein meine mir mich zu den dem des auf fur von war hat habe es sich so wie auch wenn seit bin aber doch im am nur uber",
    "es": "el la los las de y que en un una mi mis me con por para no se es lo su al del desde como mas yo soy estoy pero cuando muy sobre ha hay este esta",
    "pt": "o a os as de e que em um uma meu minha me com por para nao se e do da no na desde como mais eu sou estou mas quando muito sobre ao pelo pela isso esta foi",
    "it": "il lo la gli le di e che in un una mio mia mi con per non si del della da come piu io sono ma quando molto su al nel alla questo questa ho era",
    "nl": "de het een en ik is niet mijn me met van op te dat voor was zijn er maar als om aan bij naar ook dan nog hij ze we je heb had wel",
    "pl": "i w na nie to jest sie z do ze moj moja mnie jak ale co po od za przez bylo byl byla tak dla czy juz jestem mam tylko",
    "sv": "och att det som en ett jag ar inte pa med for den min mitt mig av till om sa har var men nar hon han vi de kan",
}
LANGUAGES = list(FUNCTION_WORDS)
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _text in FUNCTION_WORDS.items():
    for _w in set(_text.split()):
        _WEIGHT.setdefault(_w, {})[_lang] = 1.0
for _own in _WEIGHT.values():
    for _lang in _own:
        _own[_lang] = 1.0 / len(_own)
_RANGES = (("ru", 0x400, 0x4FF), ("el", 0x370, 0x3FF), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7AF), ("ar", 0x600, 0x6FF), ("he", 0x590, 0x5FF), ("hi", 0x900, 0x97F), ("th", 0xE00, 0xE7F))
_OTHER = re.compile("[\u0370-\uffff]")


def scores(tokens: list[str]) -> dict[str, float]:
    """Weight of each language's function words among the tokens; a word of several languages counts in part."""
    out: dict[str, float] = {}
    for t in tokens:
        for lang, w in _WEIGHT.get(t, {}).items():
            out[lang] = out.get(lang, 0.0) + w
    return out


def language(text: str | None, least: float = 1.0, lead: float = 1.2) -> str | None:
    """The language of the text; None if it is null, has too few function words or no language leads."""
    return language_of(words(text), text, least, lead)


def language_of(tokens: list[str], text: str | None, least: float = 1.0, lead: float = 1.2) -> str | None:
    """The language of a text with these words.  A text mostly of letters of one other script is named by that script."""
    if not text:
        return None
    if _OTHER.search(text):
        letters = [ord(c) for c in folded(text) if c.isalpha()]
        for lang, low, high in _RANGES:
            if letters and sum(low <= c <= high for c in letters) > 0.5 * len(letters):
                return lang
    found = scores(tokens)
    if not found:
        return None
    top = max(found, key=lambda k: (found[k], k))
    second = max((v for k, v in found.items() if k != top), default=0.0)
    return top if found[top] >= least and found[top] >= lead * second else None

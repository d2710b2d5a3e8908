"""Word patterns of a language that tell what in a line is a note, and how they are matched."""

from __future__ import annotations

# Patterns by language and kind, over folded text (umlauts in two letters).
LEXICONS = {
    "de": {
        "countable_nouns": ("paprika", "paprikaschote(n)?", "paprikaschoten", "zwiebel(n)?", "tomate(n)?", "limette(n)?", "zitrone(n)?", "orange(n)?", "knoblauchzehe(n)?", "kardamom(kapsel(n)?)?", "nelke(n)?", "lorbeer(blatt|blaetter|blatter)", "tortilla(s)?", "maistortilla(s)?", "shiitake( pilz| pilze)?", "chili(s)?", "chilischote(n)?", "pak choi", "pakchoy"),
        "uncountable_nouns": ("wasser", "oel", "olivenoel", "butter", "mehl", "reis", "bruehe", "fond", "milch"),
        "adjectives": ("frisch(e|er|es)?", "klein(e|er|es)?", "gross(e|er|es)?", "mittelgross(e|er|es)?", "rot(e|er|es)?", "weiss(e|er|es)?", "gruen(e|er|es)?", "gelb(e|er|es)?", "schwarz(e|er|es)?", "gehackt", "fein gehackt", "grob gehackt", "fein geschnitten", "grob geschnitten", "gewuerfelt", "gepresst", "gerieben"),
        "purpose_phrases": ("zum [a-z]{2,}(en)?", "fuer [a-z]{2,}(en)?", "zur [a-z]{2,}(en)?"),
        "fraction_words": ("halb(e|er|es|en)?",),
    },
    "en": {
        "countable_nouns": ("onion(s)?", "shallot(s)?", "garlic clove(s)?", "clove(s)?", "cardamom pod(s)?", "bay leaf(leaves)?", "lime(s)?", "lemon(s)?", "orange(s)?", "tortilla(s)?", "chili pepper(s)?", "chilli(es)?", "spring onion(s)?", "scallion(s)?", "shiitake mushroom(s)?", "mushroom(s)?"),
        "uncountable_nouns": ("water", "oil", "olive oil", "butter", "flour", "rice", "stock", "broth", "milk"),
        "adjectives": ("fresh", "small", "medium", "large", "green", "red", "white", "yellow", "black", "chopped", "finely chopped", "coarsely chopped", "diced", "minced", "pressed", "grated", "crushed"),
        "purpose_phrases": ("for [a-z ]+", "to [a-z ]+"),
        "fraction_words": ("half", "half of"),
    },
}
#: Words of tolerance, which say nothing of a quantity.
TOLERANCES = ("ca", "circa", "etwa", "ungefähr", "ungefaehr", "approx")
#: Colours that name a kind (white pepper, black olives) rather than describe one: they stay with their noun.
KIND_COLOURS = ("weiss(e|er|es)?", "schwarz(e|er|es)?", "white", "black")
#: Phrases that are a note wherever a line ends with them.
CLOSING_PHRASES = ("nach geschmack", "nach belieben", "nach bedarf", "bei bedarf", "zum abschmecken", "falls vorhanden", "wenn moeglich", "aus der dose", "aus dem glas", "to taste")
KINDS = ("countable_nouns", "uncountable_nouns", "adjectives", "purpose_phrases", "fraction_words", "unit_aliases")

Lexicon = dict[str, tuple[str, ...]]


def merged(*lexicons: Lexicon) -> Lexicon:
    """The patterns of all, kind by kind, each once and where it comes first."""
    kinds = dict.fromkeys(kind for lexicon in lexicons for kind in lexicon)
    return {kind: tuple(dict.fromkeys(p for lexicon in lexicons for p in lexicon.get(kind, ()))) for kind in kinds}


def lexicon(locale: str, overlay: Lexicon | None = None) -> Lexicon:
    """The patterns of a locale (``de``, ``de_AT``), then those of English, then an overlay's; a language without any is English."""
    language = locale[:2].lower()
    return merged(dict.fromkeys(KINDS, ()), LEXICONS.get(language, {}), LEXICONS["en"], overlay or {})


def any_of(patterns: tuple[str, ...]) -> str:
    """One expression for any of the patterns, longer ones first, that matches umlauts as they are or folded."""
    text = "|".join(sorted(patterns, key=len, reverse=True))
    for two, one in (("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ss", "ß")):
        text = text.replace(two, f"(?:{two}|{one})")
    return "(?:" + text.replace("[a-z ]", r"[\p{L}\s]").replace("[a-z]", r"\p{L}").replace(" ", r"\s+") + ")"

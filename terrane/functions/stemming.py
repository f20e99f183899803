"""English stems by Porter's algorithm (1980), on lower-case words of a-z; other words are their own stems."""

from __future__ import annotations

VOWELS = "aeiou"
#: Fixed endings of the steps: what is replaced, by what, where the stem before has a measure above 0.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in VOWELS or letter == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def replaced(word: str, endings: list[tuple[str, str]]) -> str:
    """The longest ending that fits is replaced, if its stem has a measure above 0."""
    fits = [(old, new) for old, new in endings if word.endswith(old)]
    if not fits:
        return word
    old, new = max(fits, key=lambda e: len(e[0]))
    stem = word[: -len(old)]
    return stem + new if measure(stem) > 0 else word


def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = 0
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in shape(word[:-2]):
        cut = 2
    elif word.endswith("ing") and "v" in shape(word[:-3]):
        cut = 3
    if cut:
        word = word[:-cut]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and short_end(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    endings = [e for e in STEP_4 if word.endswith(e)]
    if endings:
        end = max(endings, key=len)
        base = word[: -len(end)]
        if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not short_end(base):
            word = base
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word

"""Word stems by M. F. Porter's published algorithm ("An algorithm for suffix stripping", 1980, with its author's later
corrections), for the distinct words of a vocabulary."""

from __future__ import annotations

# The endings of the published steps 2, 3 and 4, in its order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words of fewer and of more bytes stay as they are, as in the full-text index that this one agrees with.
SHORTEST, LONGEST = 3, 64



def shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swapped(word: str, endings: tuple[tuple[str, str], ...]) -> str:
    """The longest ending that fits, replaced where something measures before it."""
    for ending, new in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(ending):
            left = word[: -len(ending)]
            return left + new if measure(left) > 0 else word
    return word


def stem(word: str) -> str:
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    # Plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            left = word.removesuffix(ending)
            if left != word and "v" in shape(left):
                if left.endswith(("at", "bl", "iz")):
                    left += "e"
                elif len(left) > 1 and left[-1] == left[-2] and shape(left)[-1] == "c" and left[-1] not in "lsz":
                    left = left[:-1]
                elif measure(left) == 1 and _short(left):
                    left += "e"
                word = left
                break
            if left != word:
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swapped(_swapped(word, STEP_2), STEP_3)
    for ending in sorted(STEP_4, key=lambda e: -len(e)):
        if word.endswith(ending):
            left = word[: -len(ending)]
            if measure(left) > 1 and (ending != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    # A final e, and a double l.
    if word.endswith("e"):
        left = word[:-1]
        if measure(left) > 1 or (measure(left) == 1 and not _short(left)):
            word = left
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word

"""Pure-Python counts and formulas of the reading level (no Spark in this module)."""

from __future__ import annotations

import math
import re
from collections import Counter

# Everyday words that tell the languages apart.
FUNCTION_WORDS = {
    "en": frozenset("the and of to in is was with for that it you we are at on or be as by not from this which".split()),
    "da": frozenset("og det er en et den til på af med for i som ikke vi at der var har han kan de fra ved mod".split()),
    "de": frozenset("der die und das ist ein eine in zu den mit von für nicht wir auf dem des es im war sich sie auch".split()),
}
LANGUAGES = tuple(FUNCTION_WORDS)
# Conjunctions that open an independent clause.
CONJUNCTIONS = {"en": "and but so then", "da": "og men så", "de": "und aber dann"}
VOWELS = {"en": "aeiouy", "da": "aeiouyæøåöäüé", "de": "aeiouyäöüé"}
# Hyphenation patterns besides the rule that a syllable opens at the last consonant before a vowel.
# A digit weighs the place between two letters, the highest one counts, odd ones allow a hyphen; "." is the word's end.
PATTERNS = {
    "en": (
        "i1a i1o e1o i1u ide1a u1a u1o y1a y1i i1e. ti2o si2o ci2o gi2o xi2o ti2a ci2a ti2ou ci2ou gi2ou qu2a qu2o gu2a "
        "2e. 2e2s. 2e2d. 3te2d. 3de2d. 3se2s. 3ze2s. 3ce2s. 3ge2s. 3xe2s. c3he2s. s3he2s. "
        "3ble. 3cle. 3dle. 3fle. 3gle. 3kle. 3ple. 3tle. 3zle. 3bles. 3cles. 3dles. 3gles. 3ples. 3tles. 3zles. 3kles. 3fles."
    ).split(),
    "da": "i1a i1o i1u e1a e1o u1a u1e u1o i1e y1e o1a æ1e ø1e å1e ti2o si2o".split(),
    "de": "i1a i1o i1u e1a e1o u1a u1o ä1ä qu2a qu2o".split(),
}

#: A listed word is hard if the labelled texts that hold it stand above this level on average.
HARD_GRADE = 3.3
#: Entries a worker remembers of words and of marks; beyond, it starts anew.
REMEMBERED = 200_000

_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
_URL = re.compile(r"\(?\bhttps?://\S+")
_BULLET = re.compile(r"^[ \t]*(?:[-*•–]|\d{1,3}[.)])[ \t]+")
_BULLET_STARTS = frozenset(" \t-*•–0123456789")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?…]+(?:[\"'”’)\]]|$)")
_PART = re.compile(r"[;:]$")
_OPENING = {lang: frozenset(words.split()) for lang, words in CONJUNCTIONS.items()}
# what a mark between two blanks is to the count of clauses
PLAIN, SIGN, OPENS, ENDS, ENDS_ALONE, PARTS = range(6)


class _Remembering(dict):
    """A dictionary that works out what it lacks and never holds more than ``REMEMBERED`` entries."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, key: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value = self.work(key)
        return value

def plain(text: str) -> str:
    """The running text: tags become line ends, links and bullets go."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "://" in text:
        text = _URL.sub(" ", text)
    lines = text.split("\n")
    return "\n".join([_BULLET.sub("", line) if line[:1] in _BULLET_STARTS else line for line in lines])


def _weights(pattern: str) -> tuple[str, dict[int, int]]:
    """A pattern's letters and the weight before each of them."""
    letters, at = "", {}
    for ch in pattern:
        if ch.isdigit():
            at[len(letters)] = int(ch)
        else:
            letters += ch
    return letters, at


_PARSED = {lang: [_weights(p) for p in patterns] for lang, patterns in PATTERNS.items()}


def hyphens(word: str, lang: str) -> list[int]:
    """Places where ``word`` (lower case) may be parted into syllables: before a consonant and its vowel, and as the patterns say.

    A syllable has a vowel, so there is no place before the first or after the last one.
    """
    vowels = VOWELS[lang]
    nuclei = [i for i, ch in enumerate(word) if ch in vowels]
    if not nuclei:
        return []
    weight = [0] * (len(word) + 2)
    for i in range(1, len(word)):
        if word[i] in vowels and word[i - 1] not in vowels:
            weight[i - 1] = 1
    dotted = word + "."
    for letters, at in _PARSED[lang]:
        start = dotted.find(letters)
        while start >= 0:
            for offset, value in at.items():
                # weights before a vowel speak of the place its syllable opens at
                place = start + offset
                if offset < len(letters) and letters[offset] in vowels and place and dotted[place - 1] not in vowels:
                    place -= 1
                weight[place] = max(weight[place], value)
            start = dotted.find(letters, start + 1)
    return [i for i in range(nuclei[0] + 1, nuclei[-1] + 1) if weight[i] % 2]


def syllables(word: str, lang: str) -> int:
    return len(hyphens(word, lang)) + 1


def _kind(mark: str, lang: str) -> int:
    words = _WORD.findall(mark)
    if _END.search(mark):
        return ENDS if words else ENDS_ALONE
    if not words:
        return PARTS if _PART.search(mark) else SIGN
    if words[0] in _OPENING[lang]:
        return OPENS
    return PARTS if _PART.search(mark) else PLAIN


def _measures(word: str, lang: str) -> tuple[int, int, bool, bool, bool]:
    """Letters, syllables, three syllables or more, four or more, more than six letters."""
    n = syllables(word, lang)
    return len(word), n, n >= 3, n >= 4, len(word) > 6


_words_of = _Remembering(_WORD.findall)
_kinds = {lang: _Remembering(lambda mark, lang=lang: _kind(mark, lang)) for lang in LANGUAGES}
_measured = {lang: _Remembering(lambda word, lang=lang: _measures(word, lang)) for lang in LANGUAGES}


def language(words: dict[str, int], hint: str | None) -> str:
    """By the function words of the whole text (word -> times); the hint decides only where they do not."""
    seen = {lang: sum(map(words.__getitem__, known.intersection(words))) for lang, known in FUNCTION_WORDS.items()}
    best = max(LANGUAGES, key=lambda lang: seen[lang])
    hinted = (hint or "").lower()[:2]
    if hinted in seen and seen[hinted] >= seen[best]:
        return hinted
    return best


def clauses(body: str, lang: str) -> int:
    """Sentences, those of several independent clauses counted by clauses (Gunning's rule).

    A sentence ends with its mark or its line; a clause is a run of three words or more between conjunctions,
    semicolons and colons.
    """
    kinds, n = _kinds[lang], 0
    for line in body.split("\n"):
        found = run = 0
        worded = False
        for mark in line.split():
            kind = kinds[mark]
            if kind == PLAIN:
                run += 1
                continue
            if kind == SIGN:
                continue
            worded |= run > 0 or kind in (OPENS, ENDS)
            found += run + (kind in (ENDS, PARTS)) >= 3
            run = 0
            if kind in (ENDS, ENDS_ALONE):
                n += max(worded, found)
                found, worded = 0, False
        n += max(worded or run > 0, found + (run >= 3))
    return max(1, n)


def word_counts(text: str) -> tuple[str, dict[str, int]]:
    """The running text in lower case and its words with their times."""
    body = plain(text).lower()
    words: dict[str, int] = {}
    for mark, times in Counter(body.split()).items():
        for word in _words_of[mark]:
            words[word] = words.get(word, 0) + times
    return body, words


def counts(text: str, hint: str | None, graded: dict[str, float]) -> dict | None:
    """What the formulas need, from the whole text; None for a text without a word.

    ``graded`` (word -> level) is the list of word difficulty; words off it say nothing, and a text without any listed
    word has its words of four syllables and more as hard ones.
    """
    body, words = word_counts(text)
    if not words:
        return None
    lang = language(words, hint)
    measured = _measured[lang]
    total = letters = syllabic = poly = longest = long = listed = hard = 0
    for word, times in words.items():
        size, n, three, four, over_six = measured[word]
        total += times
        letters += size * times
        syllabic += n * times
        if three:
            poly += times
            if four:
                longest += times
        if over_six:
            long += times
        if word in graded:
            listed += times
            if graded[word] > HARD_GRADE:
                hard += times
    return {
        "lang": lang,
        "sentences": clauses(body, lang),
        "words": total,
        "letters": letters,
        "syllables": syllabic,
        "polysyllables": poly,
        "long_words": long,
        "hard_share": hard / listed if listed else longest / total,
    }


def _length(c: dict) -> float:
    return c["words"] / c["sentences"]


# The coefficients of the published formulas.  Those of the first group take sentence length and
# syllables or letters; those of the second one sentence length and the share of words outside a list of easy words.
def flesch_kincaid(c: dict) -> float:
    return 0.39 * _length(c) + 11.8 * c["syllables"] / c["words"] - 15.59


def reading_ease(c: dict) -> float:
    """Flesch's ease, turned round so that it rises with difficulty."""
    return -(206.835 - 1.015 * _length(c) - 84.6 * c["syllables"] / c["words"])


def smog(c: dict) -> float:
    return 1.043 * math.sqrt(30 * c["polysyllables"] / c["sentences"]) + 3.1291


def gunning_fog(c: dict) -> float:
    return 0.4 * (_length(c) + 100 * c["polysyllables"] / c["words"])


def coleman_liau(c: dict) -> float:
    return 0.0588 * 100 * c["letters"] / c["words"] - 0.296 * 100 * c["sentences"] / c["words"] - 15.8


def automated_index(c: dict) -> float:
    return 4.71 * c["letters"] / c["words"] + 0.5 * _length(c) - 21.43


def lix(c: dict) -> float:
    return _length(c) + 100 * c["long_words"] / c["words"]


def dale_chall(c: dict) -> float:
    share = 100 * c["hard_share"]
    return 0.1579 * share + 0.0496 * _length(c) + (3.6365 if share > 5 else 0.0)


def dale_chall_recalculated(c: dict) -> float:
    """Powers, Sumner and Kearl's coefficients."""
    return 3.2672 + 0.0596 * _length(c) + 0.1155 * 100 * c["hard_share"]


def dale_chall_cloze(c: dict) -> float:
    """Chall and Dale's later cloze score, turned round so that it rises with difficulty."""
    return -(64 - 0.95 * 100 * c["hard_share"] - 0.69 * _length(c))


def spache(c: dict) -> float:
    return 0.121 * _length(c) + 0.082 * 100 * c["hard_share"] + 0.659


#: Formulas of sentence length, syllables and letters only.
CLASSIC = {f.__name__: f for f in (flesch_kincaid, reading_ease, smog, gunning_fog, coleman_liau, automated_index, lix)}
#: Formulas for texts whose difficulty lies in their words as much as in their length.
WITH_LIST = {f.__name__: f for f in (flesch_kincaid, smog, coleman_liau, dale_chall, dale_chall_recalculated, dale_chall_cloze, spache)}


def boundaries(values: list[float], levels: list[float]) -> list[float]:
    """For each pair of neighbouring levels the value that parts them with the fewest errors; never falling."""
    order = sorted(range(len(values)), key=lambda i: values[i])
    vs, ls = [values[i] for i in order], [levels[i] for i in order]
    out: list[float] = []
    for cut in (1.5, 2.5, 3.5, 4.5):
        errors = sum(level < cut for level in ls)  # all above: the low ones are wrong
        best, where = errors, [0]
        for i, level in enumerate(ls, 1):
            errors += 1 if level >= cut else -1
            if i < len(ls) and vs[i] == vs[i - 1]:
                continue
            if errors < best:
                best, where = errors, [i]
            elif errors == best:
                where.append(i)
        i = where[len(where) // 2]
        low = vs[i - 1] if i else vs[0] - 1.0
        high = vs[i] if i < len(vs) else vs[-1] + 1.0
        out.append(max((low + high) / 2, *out) if out else (low + high) / 2)
    return out


def level(value: float, parts: list[float]) -> float:
    """The level between 1 and 5 at ``value``: 1.5, 2.5, 3.5, 4.5 at the boundaries, linear between them."""
    marks = (1.5, 2.5, 3.5, 4.5)
    width = max(1e-9, (parts[-1] - parts[0]) / 3)
    if value <= parts[0]:
        return max(1.0, 1.5 - (parts[0] - value) / width)
    if value > parts[-1]:
        return min(5.0, 4.5 + (value - parts[-1]) / width)
    for i in range(3):
        if value <= parts[i + 1]:
            span = parts[i + 1] - parts[i]
            return marks[i] + ((value - parts[i]) / span if span else 1.0)
    return 4.5

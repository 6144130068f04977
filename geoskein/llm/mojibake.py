"""Pure-Python core of the wrong-encoding repair (no Spark in this module).

Text that was written as bytes in one encoding and decoded with another one is taken back to its bytes character by
character.  A byte-structure automaton for UTF-8 then finds the maximal well-formed multibyte spans among those bytes,
and these spans are decoded whole; everything else stays as it is.  Only then is the outcome judged, word by word: a
word is restored if it is less odd than before (``oddness``), otherwise none of its spans is.  As each layer makes
the text less odd, layers are undone for as long as one is found.

Confusions between two single-byte encodings leave no byte structure behind, and garbled text that was changed to
lower case a broken one.  For them the module only proposes candidates; the caller decides by evidence from the corpus
(see ``encoding_repair.py``).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Decoders that are commonly applied to bytes of another encoding.
WRONG_DECODERS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1253")
# Single-byte encodings in which the text may really have been written.
TRUE_ENCODINGS = ("cp1252", "mac_roman", "cp850", "cp437")
REPLACEMENT = "�"
#: Ends the name of an encoding whose text was changed to lower case after it was garbled.
LOWER = ", lower case"
_SPACES = re.compile(r"([ \t\r\n\f\v]+)")


@lru_cache(maxsize=None)
def byte_map(decoder: str) -> dict[str, int]:
    """Character -> byte (0x80 and above) of a single-byte decoder; bytes a decoder leaves undefined map from C1."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(decoder)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if decoder == "cp1252":  # text read as ISO 8859-1 has the controls themselves
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def undefined_bytes(decoder: str) -> tuple[int, ...]:
    out = []
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(decoder)
        except UnicodeDecodeError:
            out.append(b)
    return tuple(out)


def _lead_length(b: int) -> int:
    if 0xC2 <= b <= 0xDF:
        return 2
    if 0xE0 <= b <= 0xEF:
        return 3
    if 0xF0 <= b <= 0xF4:
        return 4
    return 0


@lru_cache(maxsize=100_000)
def plausible(ch: str) -> bool:
    """Whether a decoded character may stand in natural text of the scripts handled (Latin, Greek, Cyrillic)."""
    c = ord(ch)
    if 0xA0 <= c <= 0xBF or 0x300 <= c <= 0x36F:
        return True
    if 0x2010 <= c <= 0x2027 or 0x2030 <= c <= 0x203A or c in (0x20AC, 0x2116, 0x2122, 0x2605):
        return True
    # signs that take part in a further layer of garbling
    if 0x2500 <= c <= 0x257F or c in (0x192, 0x2C6, 0x2DC, 0x221A, 0x220F, 0x2206, 0x2248, 0x2260, 0x222B, 0x2202):
        return True
    return unicodedata.category(ch)[0] == "L" and (0xC0 <= c <= 0x24F or 0x370 <= c <= 0x52F or 0x1E00 <= c <= 0x1FFF)


def _runs(options: list[tuple[int, ...]]) -> list[tuple[int, int, bytes]]:
    """The automaton: (start, end, bytes) of the maximal runs of well-formed multibyte sequences.

    Each character offers the bytes it may stand for.  The first lead byte that its followers complete is taken.
    """
    out: list[tuple[int, int, bytes]] = []
    i, n = 0, len(options)
    while i < n:
        start, span = i, bytearray()
        while i < n:
            for lead in options[i]:
                length = _lead_length(lead)
                tail = [next((b for b in options[k] if 0x80 <= b <= 0xBF), None) for k in range(i + 1, min(n, i + length))]
                if not length or len(tail) != length - 1 or None in tail:
                    continue
                sequence = bytes([lead, *tail])
                try:
                    sequence.decode("utf-8")  # overlong forms and surrogates are not well-formed
                except UnicodeDecodeError:
                    continue
                span += sequence
                i += length
                break
            else:
                break
        if span:
            out.append((start, i, bytes(span)))
        else:
            i += 1
    return out


def _decoded(word: str, options: list[tuple[int, ...]]) -> str:
    out, done = [], 0
    for start, end, span in _runs(options):
        out += [word[done:start], span.decode("utf-8")]
        done = end
    return "".join([*out, word[done:]])


def _as_bytes(word: str, decoder: str) -> list[tuple[int, ...]]:
    to_byte, lost = byte_map(decoder), undefined_bytes(decoder)
    return [() if ord(ch) < 0x80 else (to_byte[ch],) if ch in to_byte else (lost[0],) if ch == REPLACEMENT and len(lost) == 1 else () for ch in word]


# Signs that may stand behind a letter or between two.
_CLOSING = frozenset("’”»–—…")


@lru_cache(maxsize=100_000)
def _script(ch: str) -> str:
    """The script of a letter by its name; Japanese and Chinese signs go together."""
    name = unicodedata.name(ch, "")
    first = name.split(" ", 1)[0].split("-", 1)[0]
    return "EAST" if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "KATAKANA-HIRAGANA", "IDEOGRAPHIC") else first


@lru_cache(maxsize=100_000)
def oddness(word: str) -> float:
    """How unlikely the signs of a word are in natural text: 0 for plain letters, more for signs among them, mixed scripts and controls."""
    scripts = {_script(ch) for ch in word if ch.isalpha()}
    # a script of its own weighs once, however long the word is
    out = 1.0 if len(scripts) == 1 and scripts != {"LATIN"} else 0.0
    for i, ch in enumerate(word):
        c = ord(ch)
        if i and (c >= 0x80 or ord(word[i - 1]) >= 0x80):
            # capitals after small letters, small letters after several capitals
            if (ch.isupper() and word[i - 1].islower()) or (ch.islower() and i > 1 and word[i - 1].isupper() and word[i - 2].isupper()):
                out += 1.5
        if c < 0x80:
            continue
        kind = unicodedata.category(ch)
        if kind in ("Cc", "Cn", "Co", "Cs") or ch == REPLACEMENT:
            out += 4.0
        elif kind[0] == "M":
            out += 0.5 if _script(ch) == "COMBINING" or scripts == {_script(ch)} else 4.0
        elif c in (0x200D, 0xFE0F):
            out += 0.5
        elif kind[0] == "L":
            if _script(ch) == "LATIN":
                out += (2.0 if c in (0xAA, 0xBA) else 0.0) if c <= 0xFF else 1.25 if c <= 0x17F or 0x1E00 <= c <= 0x1EFF else 3.0
            elif len(scripts) > 1:
                out += 3.0
        elif ch in _CLOSING:
            out += 1.0
        elif kind == "So" and c >= 0x2600 and not 0x1F100 <= c <= 0x1F2FF:
            out += 1.0
        elif kind[0] == "P" and (i == 0 or not word[i - 1].isalnum()):
            out += 1.0
        else:
            out += 3.0 if i and i + 1 < len(word) and word[i - 1].isalpha() and word[i + 1].isalpha() else 2.0
    return out


def _better(fixed: str, word: str) -> bool:
    """Less odd; or as odd but shorter, where no letter beyond Latin-1 comes in."""
    new, old = oddness(fixed), oddness(word)
    return new < old or (new == old and len(fixed) < len(word) and all(ord(ch) <= 0xFF or not ch.isalpha() for ch in fixed))


def _folded_options(word: str, decoder: str, both: bool) -> list[tuple[int, ...]]:
    """Bytes of a lower-cased word: a capital's byte where it opens a sequence; elsewhere too, if ``both``."""
    to_byte, out = byte_map(decoder), []
    for ch in word:
        own, up = to_byte.get(ch), to_byte.get(ch.upper()) if ch.upper() != ch else None
        first = (up, own) if both or own is None or _lead_length(up or 0) else (own, up)
        out.append(() if ord(ch) < 0x80 else tuple(b for b in first if b is not None))
    return out


def _lower_cased(word: str, decoder: str) -> str | None:
    """A lower-case word whose capitals were garbled, if its signs say so: at least one goes, and only letters of Latin-1 come."""
    for both in (False, True):
        fixed = _decoded(word, _folded_options(word, decoder, both)).lower()
        came = [ch for ch in fixed if ord(ch) > 0x7F]
        if fixed != word and oddness(fixed) <= oddness(word) - 2 and all(0xDF <= ord(ch) <= 0xFF and ch.isalpha() for ch in came):
            return fixed
    return None


def _layer(text: str) -> list[tuple[str, str]]:
    """Every (text, decoder) that one layer of decoding gives."""
    out, lower = [], text == text.lower()
    for decoder in WRONG_DECODERS:
        parts, changed = [], False
        for word in _SPACES.split(text):
            if not word.isascii():
                fixed = _decoded(word, _as_bytes(word, decoder))
                if fixed != word and _better(fixed, word):
                    word, changed = fixed, True
                elif lower and (fixed := _lower_cased(word, decoder)):
                    word, changed = fixed, True
            parts.append(word)
        if changed:
            out.append(("".join(parts), decoder))
    return out


def repair_utf8(text: str) -> tuple[str, str] | None:
    """The text with UTF-8 read by a wrong decoder restored, and the layers ("utf-8 as cp1252" ...), or None if there is none.

    Layers are followed for every decoder that makes the text less odd; the least odd text reached wins, then the
    shorter, then the smaller.  Text that ends with a control or a lost sign it did not begin with is no repair.
    """
    best: tuple[tuple[float, int, str], str] | None = None
    frontier: dict[str, str] = {text: ""}
    seen = {text}
    while frontier:
        following: dict[str, str] = {}
        for current, path in frontier.items():
            for fixed, decoder in _layer(current):
                if fixed in seen:
                    continue
                seen.add(fixed)
                following[fixed] = f"{path} / utf-8 as {decoder}" if path else f"utf-8 as {decoder}"
                rank = (sum(map(oddness, _SPACES.split(fixed))), len(fixed), fixed)
                if best is None or rank < best[0]:
                    best = (rank, following[fixed])
        frontier = following
    if best is None or mixed_script(best[0][2]) and not mixed_script(text):
        return None
    controls = lambda s: sum(unicodedata.category(ch) == "Cc" and ord(ch) > 0x7F for ch in s)
    if controls(best[0][2]) and not controls(text):
        return None
    return best[0][2], best[1]


def lower_cased_candidates(text: str) -> list[tuple[str, str]]:
    """(restored text, "utf-8 as cp1252, lower case") for lower-case text whose capitals would have stood for other bytes."""
    if text != text.lower():
        return []
    seen: dict[str, str] = {}
    for decoder in WRONG_DECODERS:
        for both in (False, True):
            fixed = "".join(w if w.isascii() else _decoded(w, _folded_options(w, decoder, both)).lower() for w in _SPACES.split(text))
            if fixed != text and not any(unicodedata.category(ch) in ("Cc", "Cn", "Co") for ch in fixed if ord(ch) > 0x7F):
                seen.setdefault(fixed, f"utf-8 as {decoder}{LOWER}")
    return list(seen.items())


def strangeness(text: str) -> tuple[bool, int]:
    """Whether scripts are mixed, and the signs above ASCII that are no letters."""
    return mixed_script(text), sum(1 for ch in text if ord(ch) > 0x7F and ch != "\xa0" and not ch.isalpha())


def single_byte_candidates(text: str) -> list[tuple[str, str]]:
    """(restored text, "cp850 as cp1252" ...) for each pair of single-byte encodings that maps the whole text."""
    high = [ch for ch in text if ord(ch) > 0x7F and ch != "\xa0"]
    if not high:
        return []
    seen: dict[str, str] = {}
    for wrong in WRONG_DECODERS:
        to_byte = byte_map(wrong)
        unknown = undefined_bytes(wrong) if REPLACEMENT in text else (0,)
        for true in TRUE_ENCODINGS:
            if true == wrong:
                continue
            for filler in unknown:
                out: list[str] = []
                for ch in text:
                    if ord(ch) < 0x80 or ch == "\xa0":
                        out.append(ch)
                        continue
                    b = filler if ch == REPLACEMENT else to_byte.get(ch)
                    if b is None:
                        break
                    try:
                        out.append(bytes([b]).decode(true))
                    except UnicodeDecodeError:
                        break
                else:
                    fixed = "".join(out)
                    if fixed != text and all(plausible(c) for c in fixed if ord(c) > 0x7F):
                        seen.setdefault(fixed, f"{true} as {wrong}")
    return list(seen.items())


def words(text: str) -> list[str]:
    """Words: the text split at white space and ASCII punctuation; other signs stay in their word."""
    out, cur = [], []
    for ch in text:
        if ch.isspace() or (ord(ch) < 0x80 and not ch.isalnum()):
            if cur:
                out.append("".join(cur))
                cur = []
        else:
            cur.append(ch)
    if cur:
        out.append("".join(cur))
    return out


def changed_words(before: str, after: str) -> list[tuple[str, str]]:
    """Pairs (garbled word, restored word) in which a character above ASCII changed; [] if the words don't line up."""
    a, b = words(before), words(after)
    if len(a) != len(b):
        return []
    return [(x, y) for x, y in zip(a, b) if x != y and any(ch.isalpha() for ch in y)]


def mixed_script(text: str) -> bool:
    """A word that mixes Latin letters with Greek or Cyrillic ones, or with box drawing: never natural."""
    for word in words(text):
        latin = any(ch.isalpha() and unicodedata.name(ch, "").startswith("LATIN") for ch in word)
        if latin and any(unicodedata.name(ch, "").startswith(("CYRILLIC", "GREEK", "BOX DRAWINGS")) for ch in word):
            return True
    return False

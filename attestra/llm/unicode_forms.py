"""Visually identical text in one form, by quick-check properties of characters.

Every character is Yes (stable whatever stands beside it), Maybe (stability depends on the
neighbours) or No. Text of Yes characters alone is never touched. Otherwise only the segments of
Maybe and No characters, each with the character before and after it as boundary context, are
normalised, and the results are spliced into the unchanged rest. Letters of other scripts that
look like Latin ones are then decided word by word, for words with such letters only.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

# Letters of other scripts and the Latin letter that each looks like.
_CYRILLIC = "АВЕІЈКМНОРСТУХЅҮԚԜӀЁЇаеорсухѕіјһԁԛԝүӏёї", "ABEIJKMHOPCTYXSYQWIËÏaeopcyxsijhdqwylëï"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳνοϲιαρυγχη", "ABEZHIKMNOPTYXCjvociapuyxn"
_ARMENIAN = "ՕՍԼՏոսօզհցյ", "OULSnuoqhgj"
_CHEROKEE = "ᎪᎫᎬᎻᎷᎱᏃᏚᏢᏞᏟᏦᏴ", "AJEHWГZSPLCKB"
_LATIN = "ɡɑ", "ga"
_MARKS = "‐‑∶∕⁄∗", "--://*"

LOOKALIKES = {a: b for pair in (_CYRILLIC, _GREEK, _ARMENIAN, _CHEROKEE) for a, b in zip(*pair) if b.isascii() or b in "ËÏëï"}
PLAIN = {a: b for pair in (_LATIN, _MARKS) for a, b in zip(*pair)}
#: Lower-case Greek letters that stand alone are symbols, but this one never is.
_NO_SYMBOL = "ο"

_ALWAYS_PLAIN = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Punctuation that Chinese and Japanese set in full width.
_EAST_ASIAN_MARKS = set("，。：；！？（）「」『』、《》〈〉【】・～")

YES, MAYBE, NO = "yes", "maybe", "no"


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """Latin, Greek, Cyrillic, Armenian, Cherokee, Arabic, East Asian, Hangul or '' of a letter."""
    if not ch.isalpha():
        return ""
    name = ud.name(ch, "")
    for start, what in (("LATIN", "Latin"), ("FULLWIDTH LATIN", "Latin"), ("GREEK", "Greek"), ("CYRILLIC", "Cyrillic"), ("ARMENIAN", "Armenian"), ("CHEROKEE", "Cherokee"), ("ARABIC", "Arabic"), ("CJK", "East Asian"), ("HIRAGANA", "East Asian"), ("KATAKANA", "East Asian"), ("HANGUL", "Hangul")):
        if name.startswith(start):
            return what
    return ""


@lru_cache(maxsize=1 << 16)
def quick_check(ch: str) -> str:
    """YES, MAYBE or NO of one character."""
    if ch < "\x7f":
        return YES if ch >= " " or ch in "\t\n\r" else NO
    kind = ud.category(ch)
    if kind in ("Cf", "Cc") or ch == "\u034f" or 0xFE00 <= ord(ch) <= 0xFE0F or 0x115F <= ord(ch) <= 0x1160 or ch == "\u3164":
        return NO
    if ud.combining(ch) or kind in ("Mn", "Mc") or 0x1100 <= ord(ch) <= 0x11FF:
        return MAYBE
    if kind == "Zs" or ch in PLAIN or ch in LOOKALIKES:
        return NO
    if not ud.is_normalized("NFC", ch):
        return NO
    if fold(ch) != ch:
        return NO
    return MAYBE if script(ch) in ("Greek", "Cyrillic", "Armenian", "Cherokee") else YES


@lru_cache(maxsize=1 << 16)
def fold(ch: str) -> str:
    """The plain form of a compatibility character that looks the same or differs only in width."""
    how, code = ud.decomposition(ch).split(" ")[0], ord(ch)
    same_look = how in _ALWAYS_PLAIN or how == "<compat>" and (0xFB00 <= code <= 0xFB17 or 0x2160 <= code <= 0x217F or 0x2E80 <= code <= 0x2FDF or 0x01C4 <= code <= 0x01F3 or 0x0132 <= code <= 0x0133 or code == 0x2024)
    return ud.normalize("NFKC", ch) if same_look else ch


def _joins(ch: str, before: str, after: str) -> bool:
    """Does the language of the text ask for this invisible character here?"""
    if ch in "\u200c\u200d":
        arabic = script(before) == "Arabic" and (script(after) == "Arabic" or not after)
        indic = before != "" and 0x0900 <= ord(before) <= 0x0DFF
        emoji = ch == "\u200d" and before != "" and after != "" and ud.category(before) in ("So", "Sk", "Mn") and ud.category(after) == "So"
        return arabic or indic or emoji
    if 0xFE00 <= ord(ch) <= 0xFE0F:
        return before != "" and (ud.category(before) == "So" or script(before) == "East Asian")
    return ch in "\t\n\r"


def _space(ch: str, before: str, after: str) -> str:
    if ch in "\xa0 " and (after != "" and after in ":;!?»%" and before.isalnum() or before == "«"):
        return ch
    if ch == "\u3000" and script(before) == "East Asian" and script(after) == "East Asian":
        return ch
    return " "


def _segment(segment: str, before: str, after: str, east_asian: bool) -> str:
    """A segment in canonical form, given the characters beside it."""
    out = []
    for i, ch in enumerate(segment):
        left, right = segment[i - 1] if i else before, segment[i + 1] if i + 1 < len(segment) else after
        kind = ud.category(ch)
        if kind in ("Cf", "Cc") or ch in "\u034f\u115f\u1160\u3164" or 0xFE00 <= ord(ch) <= 0xFE0F:
            out.append(ch if _joins(ch, left, right) else "")
        elif kind == "Zs":
            out.append(_space(ch, left, right) if ch != " " else ch)
        elif east_asian and ch in _EAST_ASIAN_MARKS:
            out.append(ch)
        else:
            out.append(PLAIN.get(ch) or fold(ch))
    return ud.normalize("NFC", "".join(out))


_WORDS = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def _word(word: str, foreign: frozenset[str], has_latin: bool, symbols: bool) -> str:
    """A word with letters that only look like its own script's replaced."""
    scripts = {script(c) for c in word} - {""}
    others = scripts & {"Greek", "Cyrillic", "Armenian", "Cherokee"}
    if not others:
        return word
    if "Latin" in scripts or len(others) > 1:
        own = next((s for s in ("Cyrillic", "Greek", "Armenian") if s in others and any(script(c) == s and c not in LOOKALIKES for c in word)), None)
        if own == "Cyrillic" and sum(script(c) == own for c in word) > sum(script(c) == "Latin" for c in word):
            back = {b: a for a, b in zip(*_CYRILLIC)}
            return "".join(back.get(c, c) if script(c) == "Latin" else c for c in word)
        return "".join(LOOKALIKES.get(c, c) for c in word)
    if not has_latin or foreign & others or any(c not in LOOKALIKES for c in word):
        return word
    if symbols and len(word) == 1 and word.islower() and script(word) == "Greek" and word not in _NO_SYMBOL:
        return word
    return "".join(LOOKALIKES.get(c, c) for c in word)


def canonical(text: str | None, context: str | None = None, symbols: bool = True) -> str | None:
    """The text in its one consistent form; null stays null and the empty text empty.

    ``context`` is more text of the same field, by which the script of single letters is judged;
    ``symbols`` says that a lone lower-case Greek letter is a symbol. Applying it twice changes
    nothing more: letters that became Latin may decide others, so it goes on until nothing changes.
    """
    while text and any(quick_check(c) != YES for c in set(text)):
        once = _once(text, context, symbols)
        if once == text:
            break
        text = once
    return text


def _once(text: str, context: str | None, symbols: bool) -> str:
    around = text if context is None else context
    east_asian = any(script(c) == "East Asian" and c not in "ﾞﾟ" for c in set(text))
    out, at, n = [], 0, len(text)
    while at < n:
        if quick_check(text[at]) == YES:
            out.append(text[at])
            at += 1
            continue
        end = at
        while end < n and quick_check(text[end]) != YES:
            end += 1
        base = out.pop() if out and quick_check(text[at]) == MAYBE else ""
        piece = _segment(base + text[at:end], out[-1][-1:] if out and out[-1] else text[at - 1 : at], text[end : end + 1], east_asian)
        out.append(piece)
        at = end
    spliced = ud.normalize("NFC", "".join(out)) if any(ud.combining(p[:1] or " ") for p in out) else "".join(out)
    folded = around if around == text else ud.normalize("NFKC", around)
    letters = set(spliced) | set(folded)
    if any(script(c) in ("Greek", "Cyrillic", "Armenian", "Cherokee") for c in set(spliced)):
        has_latin = any(script(c) == "Latin" for c in letters)
        foreign = frozenset(script(c) for c in letters if c not in LOOKALIKES and script(c) in ("Cyrillic", "Armenian", "Cherokee", "Greek") and not (script(c) == "Greek" and symbols))
        spliced = ud.normalize("NFC", _WORDS.sub(lambda m: _word(m.group(), foreign, has_latin, symbols), spliced))
    return spliced

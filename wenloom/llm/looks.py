"""How characters look: one consistent form for text, and comparison keys.

Three levels, each coarser than the one before:

* ``plain(text)``   invisible characters dropped, blanks of any width become
  U+0020, full-width forms become ASCII, radicals and compatibility ideographs
  become the ideograph, accents are composed. Letters keep their script.
* ``skeleton(text)``  ``plain`` with every look-alike letter as its Latin twin.
* ``parts(text)``  ``skeleton`` without case, punctuation and blanks, split at
  vertical bars of any form and sorted: two texts with equal parts differ in
  formatting only.

Null gives null (``parts``: an empty list); empty text stays empty.
"""

from __future__ import annotations

import unicodedata as ud

# Letters of other scripts that look like Latin ones.
LOOKS_LIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "ë", "ї": "ï", "ѵ": "v", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "ѡ": "w", "ɑ": "a", "ɡ": "g", "ı": "i",
}

# Radicals without a compatibility mapping, and their ideographs.
RADICALS = {
    "⺠": "民", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门",
    "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼",
    "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙",
}

# Characters without a glyph that aren't of category Cf.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ⠀"
# Line ends and tabs.
LINE = "\t\n\x0b\x0c\r\x85  "
# Forms of the vertical bar.
BARS = "|¦ǀ∣│┃❘❙❚⎮⏐︱︳｜￤￨"


_LIKE = {ord(a): b for a, b in LOOKS_LIKE.items()}


def _plain_form(i: int) -> int | str | None:
    ch = chr(i)
    if ch in LINE or 0x4E00 <= i <= 0x9FFF:
        return i
    kind = ud.category(ch)
    if kind in ("Cf", "Cc") or ch in UNSEEN or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or 0x180B <= i <= 0x180F:
        return None
    if kind == "Zs":
        return " "
    if 0x2E80 <= i <= 0x2FDF or 0xFF01 <= i <= 0xFFEE or 0xFB00 <= i <= 0xFB06 or 0xF900 <= i <= 0xFAFF or 0x2F800 <= i <= 0x2FA1F:
        return RADICALS.get(ch) or ud.normalize("NFKC", ch)
    return i


def _skeleton_form(i: int) -> int | str | None:
    return _LIKE.get(i) or _plain_form(i)


def _bare_form(i: int) -> int | str | None:
    """Of a character of any text: its skeleton without case; None for blanks and punctuation."""
    form = _skeleton_form(i)
    if form is None:
        return None
    out = ""
    for ch in chr(form) if isinstance(form, int) else form:
        if ch in BARS:
            out += "|"
        elif ud.category(ch)[0] not in "PZ" and ch not in LINE:
            out += ch.casefold()
    return out or None


class _Forms(dict):
    """For str.translate: each character's form is worked out when first met."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, key: int) -> int | str | None:
        form = self[key] = self.rule(key)
        return form


_PLAIN, _SKELETON, _BARE = _Forms(_plain_form), _Forms(_skeleton_form), _Forms(_bare_form)


def plain(text: str | None) -> str | None:
    if text is None or text.isascii() and text.isprintable():
        return text
    return ud.normalize("NFC", text.translate(_PLAIN))


def skeleton(text: str | None) -> str | None:
    """``plain`` with look-alike letters as Latin ones; equal for equal looks."""
    if text is None or text.isascii() and text.isprintable():
        return text
    t = text.translate(_SKELETON)
    if ud.is_normalized("NFC", t):
        return t
    # A look-alike may appear only once an accent is composed.
    return ud.normalize("NFC", ud.normalize("NFC", t).translate(_SKELETON))


def has_word(text: str | None) -> bool:
    """Whether any letter or digit is in the text."""
    return bool(text) and any(ud.category(c)[0] in "LN" for c in skeleton(text))


def bare(text: str) -> str:
    """Skeleton without case, blanks and punctuation; bars of any form as ``|``."""
    t = text.translate(_BARE)
    if ud.is_normalized("NFC", t):
        return t
    return skeleton(text).translate(_BARE)


def parts(text: str | None) -> list[str]:
    """The sorted parts between bars; empty parts hold nothing and are dropped."""
    if not text:
        return []
    return sorted(p for p in bare(text).split("|") if p)


def letters(text: str | None) -> str:
    """``bare`` without the bars, for passages."""
    return bare(text).replace("|", "") if text else ""

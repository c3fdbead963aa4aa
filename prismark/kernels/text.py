"""Text normalisation. Unicode tables are Python's; white space is Unicode White_Space, not str.isspace()."""

from __future__ import annotations

import re
import unicodedata

# Unicode White_Space, and the line ends that cleaning keeps.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "\n\x0b\x0c\r\x85\u2028\u2029"

_SPACES = re.compile(f"[{SPACE}]+")
_LINE_END = re.compile(f"\r\n|[{LINE_ENDS}]")


class _Dropped(dict):
    """For str.translate: characters of some categories go, others stay; filled as characters are met."""

    def __init__(self, categories: str, also: str = "", keep: str = ""):
        super().__init__({**{ord(c): None for c in also}, **{ord(c): ord(c) for c in keep}})
        self.categories = categories

    def __missing__(self, code: int) -> int | None:
        self[code] = out = None if unicodedata.category(chr(code))[0] in self.categories else code
        return out


_CONTROL = _Dropped("C", keep="\n")
_MARKS = _Dropped("CMP", also=SPACE)


def remove_newlines(text: str) -> str:
    """Runs of white space as one blank, none at the ends."""
    return " ".join(x for x in _SPACES.split(text) if x)


def trim(text: str, most: int) -> str:
    """The longest start of at most so many UTF-8 bytes that ends between characters, without white space at its ends."""
    raw = text.encode("utf-8", "surrogatepass")
    return (text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")).strip(SPACE)


def clean(text: str) -> str:
    """NFKC, line ends as \\n, other control characters gone, runs of blank lines as their first, trimmed."""
    lines = _LINE_END.sub("\n", unicodedata.normalize("NFKC", text)).translate(_CONTROL).split("\n")
    out, blank = [], False
    for line in lines:
        now = not line.strip(SPACE)
        if not (now and blank):
            out.append(line)
        blank = now
    return "\n".join(out).strip(SPACE)


def collapse(text: str) -> str:
    """Lower case, without white space, control characters, marks and punctuation, in NFKC."""
    if text.isascii():
        return text.lower().translate(_MARKS)
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFD", text).lower().translate(_MARKS))


def ngrams(text: str, width: int) -> list[str]:
    """All runs of so many characters; a shorter text is one, the empty one included."""
    if width < 2:
        raise ValueError("Sliding window width must be 2 or bigger.")
    return [text[i : i + width] for i in range(max(len(text) - width + 1, 1))]

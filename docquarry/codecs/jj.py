"""Scripts written in signs only, where digits and letters are members of one object ("jj" encoding), back to text."""

from __future__ import annotations

import re

# fixed values: what each member of the object stands for
_DIGITS = ("___", "__$", "_$_", "_$$", "$__", "$_$", "$$_", "$$$", "$___", "$__$", "$_$_", "$_$$", "$$__", "$$_$", "$$$_", "$$$$")
_LETTERS = {"_$": "o", "__": "t", "_": "u"}

_ESCAPE = re.compile(r"\\(u[0-9a-f]{4}|[0-7]{1,3}|.)", re.S)
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v"}


def jj_decode(text: str) -> str | None:
    """The hidden script; None if the text is not of this kind."""
    head = re.search(r"([$\w]+)=~\[\];\1=\{___:\+\+\1,", text)
    if not head:
        return None
    name = re.escape(head[1])
    body = re.search(rf'{name}\.\$\({name}\.\$\({name}\.\$\$\+"\\""\+(.*)"\\""\)\(\)\)\(\)', text, re.S)
    if not body:
        return None
    values = {m: f"{i:x}" for i, m in enumerate(_DIGITS)} | _LETTERS
    out = []
    for m in re.finditer(rf'{name}\.([$_]+)|\(!\[\]\+""\)\[{name}\._\$_\]|"((?:[^"\\]|\\.)*)"', body[1], re.S):
        if m[1] is not None:
            if m[1] not in values:
                return None
            out.append(values[m[1]])
        elif m[2] is not None:
            out.append(_plain(m[2]))
        else:
            out.append("l")
    return _plain("".join(out))


def _plain(text: str) -> str:
    """Escapes of a script's string literal, once."""
    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] == "u" and len(s) == 5:
            return chr(int(s[1:], 16))
        return chr(int(s, 8) & 0xFF) if s[0] in "01234567" else _NAMED.get(s, s)

    return _ESCAPE.sub(one, text)

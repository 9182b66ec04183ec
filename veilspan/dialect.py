"""User patterns in the script dialect, spelled for the ``regex`` module.

The dialect is that of a script's regular expressions without the Unicode flag: ``\\d``,
``\\w`` and ``\\b`` know ASCII, ``\\s`` all blanks, ``.`` no line end, ``$`` only the end of the
text; letter case does not matter. What the dialect does not know - atomic groups, possessive
repeats, inline flags, comments - makes a pattern invalid. An invalid pattern is never an
error: it has no spelling, so its rule finds nothing.

Offsets count code points, so an astral character is one ``.``, not two.
"""

from __future__ import annotations

from functools import lru_cache

import regex

#: Bodies of character classes: what an escape stands for, and what it leaves out.
_BLANK = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NOT_BLANK = r"\x00-\x08\x0e-\x1f!-\u009f\u00a1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\ufefe\uff00-\U0010ffff"
_SETS = {"d": "0-9", "w": "A-Za-z0-9_", "s": _BLANK, "D": r"\x00-/:-\U0010ffff", "W": r"\x00-/:-@\[-\^`\{-\U0010ffff", "S": _NOT_BLANK}
_CONTROLS = {"n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0b", "f": r"\x0c"}
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_EDGE = rf"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
_REPEAT = regex.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_GROUP = regex.compile(r"\(\?(?:[:=!]|<[=!]|<([A-Za-z_$][\w$]*)>)")
_NAMED = regex.compile(r"\(\?<[A-Za-z_$]")


class _Invalid(ValueError):
    pass


def _literal(ch: str) -> str:
    return regex.escape(ch, special_only=False) if ord(ch) < 128 else ch


class _Reader:
    """One pass over a pattern."""

    def __init__(self, pattern: str):
        self.p, self.at, self.out = pattern, 0, []
        # Groups count in the whole pattern, so that a reference may stand before its group.
        self.named = bool(_NAMED.search(pattern))
        bare = regex.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=regex.S)
        self.groups = len(regex.findall(r"\((?!\?)|\(\?<[A-Za-z_$]", bare))

    def spelled(self) -> str:
        repeatable = False
        while self.at < len(self.p):
            ch = self.p[self.at]
            rep = _REPEAT.match(self.p, self.at)
            if rep:
                if not repeatable:
                    raise _Invalid("nothing to repeat")
                self.at = rep.end()
                lazy = self.p[self.at : self.at + 1] == "?"
                self.at += lazy
                self.out.append(rep.group() + "?" * lazy)
                repeatable = False
                continue
            repeatable = ch not in "(|^"
            if ch == "\\":
                repeatable = self._escape()
            elif ch == "[":
                self._class()
            elif ch == "(":
                self._group()
            elif ch == ".":
                self._take(r"[^\n\r\u2028\u2029]")
            elif ch == "$":
                self._take(r"\Z")
                repeatable = False
            elif ch in ")|^":
                self._take(ch)
            else:
                self._take(_literal(ch))
        return "".join(self.out)

    def _take(self, text: str, width: int = 1) -> None:
        self.out.append(text)
        self.at += width

    def _group(self) -> None:
        m = _GROUP.match(self.p, self.at)
        if m:
            self._take(f"(?P<{m.group(1)}>" if m.group(1) else m.group(), m.end() - self.at)
        elif self.p.startswith("(?", self.at):
            raise _Invalid("unknown group")
        else:
            self._take("(")

    def _char(self) -> str:
        """The character an escape at the reader's place stands for; moves behind it."""
        ch = self.p[self.at + 1 : self.at + 2]
        if not ch:
            raise _Invalid("escape at the end")
        for mark, size in (("x", 2), ("u", 4)):
            digits = self.p[self.at + 2 : self.at + 2 + size]
            if ch == mark and len(digits) == size and all(c in "0123456789abcdefABCDEF" for c in digits):
                self.at += 2 + size
                return chr(int(digits, 16))
        if ch == "c" and regex.match("[A-Za-z]", self.p[self.at + 2 : self.at + 3]):
            self.at += 3
            return chr(ord(self.p[self.at - 1]) % 32)
        if ch in "01234567":
            m = regex.match(r"[0-3][0-7]{0,2}|[4-7][0-7]?", self.p[self.at + 1 :])
            self.at += 1 + len(m.group())
            return chr(int(m.group(), 8))
        if ch == "c":
            self.at += 1
            return "\\"
        self.at += 2
        return ch

    def _escape(self) -> bool:
        """Spell the escape; whether it may be repeated."""
        ch = self.p[self.at + 1 : self.at + 2]
        if ch in _SETS and ch:
            self._take(f"[{_SETS[ch]}]", 2)
        elif ch in _CONTROLS and ch:
            self._take(_CONTROLS[ch], 2)
        elif ch == "b" or ch == "B":
            self._take(_EDGE if ch == "b" else _NO_EDGE, 2)
            return False
        elif ch == "k" and self.named:
            m = regex.match(r"\\k<([A-Za-z_$][\w$]*)>", self.p[self.at :])
            if not m:
                raise _Invalid("bad name")
            self._take(f"(?:(?({m.group(1)})(?P={m.group(1)})))", m.end())
        elif (m := regex.match(r"\\([1-9][0-9]*)", self.p[self.at :])) and int(m.group(1)) <= self.groups:
            # A group that took no part matches the empty text.
            self._take(f"(?:(?({m.group(1)})\\{m.group(1)}))", m.end())
        else:
            self.out.append(_literal(self._char()))
        return True

    def _class(self) -> None:
        self.at += 1
        no = self.p[self.at : self.at + 1] == "^"
        self.at += no
        body, last = [], None
        while True:
            ch = self.p[self.at : self.at + 1]
            if not ch:
                raise _Invalid("open class")
            if ch == "]":
                self.at += 1
                break
            nxt = self.p[self.at + 1 : self.at + 2]
            if ch == "\\" and nxt in _SETS and nxt:
                # A hyphen beside a set is itself.
                body.append(_SETS[nxt])
                self.at += 2
                last = None
                if self.p[self.at : self.at + 1] == "-" and self.p[self.at + 1 : self.at + 2] not in ("", "]"):
                    body.append(r"\-")
                    self.at += 1
                continue
            one = self._class_char()
            if self.p[self.at : self.at + 1] == "-" and self.p[self.at + 1 : self.at + 2] not in ("", "]"):
                self.at += 1
                if self.p[self.at] == "\\" and self.p[self.at + 1 : self.at + 2] in _SETS:
                    body += [_literal(one), r"\-"]
                    continue
                last = self._class_char()
                if last < one:
                    raise _Invalid("range out of order")
                body.append(f"{_literal(one)}-{_literal(last)}")
            else:
                body.append(_literal(one))
        if not body:
            self.out.append(r"[\s\S]" if no else "(?!)")
        else:
            self.out.append(f"[{'^' * no}{''.join(body)}]")

    def _class_char(self) -> str:
        if self.p[self.at] != "\\":
            self.at += 1
            return self.p[self.at - 1]
        ch = self.p[self.at + 1 : self.at + 2]
        if ch == "b" or ch in _CONTROLS and ch:
            self.at += 2
            return {"b": "\b", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "f": "\f"}[ch]
        return self._char()


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> regex.Pattern | None:
    """The compiled pattern, ignoring letter case; null if it is not valid in the dialect."""
    try:
        return regex.compile(_Reader(pattern).spelled(), regex.V0 | regex.IGNORECASE)
    except (_Invalid, regex.error, RecursionError, OverflowError, ValueError):
        return None

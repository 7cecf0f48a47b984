"""Text patterns of the view expressions as Java regular expressions.

A pattern is a row of items: a character, ``.``, a class like ``%a``, or a set like ``[%w_]``, each with
``*`` (longest), ``-`` (shortest), ``+`` or ``?`` behind it; parentheses capture, ``%1`` repeats a capture,
``^`` begins and ``$`` ends a pattern. Classes are those of ASCII, and characters are code points. What has
no regular equivalent is refused: balanced pairs (``%b()``), frontiers (``%f[a]``), captured positions
(``()``) and repeats of captures that are open or missing.
"""

from __future__ import annotations

import re

# The letters of the classes, as the inside of a set.
CLASSES = {
    "a": "A-Za-z",
    "c": r"\x00-\x1F\x7F",
    "d": "0-9",
    "g": "!-~",
    "l": "a-z",
    "p": r"!-/:-@\[-`{-~",
    "s": r"\x09-\x0D\x20",
    "u": "A-Z",
    "w": "0-9A-Za-z",
    "x": "0-9A-Fa-f",
}
ITEM = re.compile(r"%(?P<escaped>.)|\[(?P<set>\^?\]?(?:%.|[^\]%])*)\]|(?P<plain>[^\[%])", re.S)
MEMBER = re.compile(r"%(?P<escaped>.)|(?P<low>[^%])-(?P<high>[^%])|(?P<plain>.)", re.S)


class UnsupportedPattern(ValueError):
    """The pattern is malformed, or no regular expression is equal to it."""


def literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}"


def one_class(c: str) -> str | None:
    """A class's regular expression; None for a letter or sign that stands for itself."""
    inside = CLASSES.get(c.lower())
    if inside is None:
        if c.isalnum():
            raise UnsupportedPattern(f"%{c}")
        return None
    return f"[{'^' if c.isupper() else ''}{inside}]"


def one_set(inside: str) -> str:
    out, negated = [], inside.startswith("^")
    for m in MEMBER.finditer(inside[negated:]):
        if m["low"]:
            if m["low"] > m["high"]:
                continue  # an empty range holds nothing
            out.append(f"{literal(m['low'])}-{literal(m['high'])}")
        elif m["escaped"]:
            out.append(one_class(m["escaped"]) or literal(m["escaped"]))
        else:
            out.append(literal(m["plain"]))
    if not out:
        return r"[\s\S]" if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(out)}]"


def translated(pattern: str, before: int = 0) -> tuple[str, int]:
    """The regular expression and its number of captures; ``before`` others stand to its left."""
    out, at, captures, open_ = [], 0, 0, []
    if pattern.startswith("^"):
        out.append(r"\A")
        at = 1
    while at < len(pattern):
        if pattern[at] == "$" and at == len(pattern) - 1:
            out.append(r"\z")
            break
        m = ITEM.match(pattern, at)
        if not m:
            raise UnsupportedPattern(pattern)
        at = m.end()
        if m["plain"] == "(":
            if pattern[at : at + 1] == ")":
                raise UnsupportedPattern("a captured position")
            captures += 1
            open_.append(captures)
            out.append("(")
            continue
        if m["plain"] == ")":
            if not open_:
                raise UnsupportedPattern(pattern)
            open_.pop()
            out.append(")")
            continue
        if m["escaped"] and m["escaped"] in "123456789":
            if int(m["escaped"]) > captures or int(m["escaped"]) in open_:
                raise UnsupportedPattern(m[0])
            out.append(f"(?:\\{int(m['escaped']) + before})")
            continue
        if m["escaped"]:
            item = one_class(m["escaped"]) or literal(m["escaped"])
        elif m["set"] is not None:
            item = one_set(m["set"])
        else:
            item = r"[\s\S]" if m["plain"] == "." else literal(m["plain"])
        if at < len(pattern) and pattern[at] in "*+?-":
            item += {"-": "*?"}.get(pattern[at], pattern[at])
            at += 1
        out.append(item)
    if open_:
        raise UnsupportedPattern(pattern)
    return "".join(out), captures


def replacement(text: str, captures: int) -> str:
    """The text that replaces a match, ``%0`` to ``%9`` being captures, in Java's form."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return "\\" + m[0] if m[0] in "\\$0123456789" else m[0]  # a digit could lengthen a capture's number
        if not m[1].isdigit():
            if m[1].isalnum():
                raise UnsupportedPattern(f"%{m[1]}")
            return "\\" + m[1] if m[1] in "\\$" else m[1]
        if int(m[1]) > max(captures, 1):
            raise UnsupportedPattern(f"%{m[1]}")
        return f"${m[1]}" if captures else "$0"

    if re.search(r"(?:^|[^%])(?:%%)*%$", text):
        raise UnsupportedPattern(text)
    return re.sub(r"%(.)|.", one, text, flags=re.S)

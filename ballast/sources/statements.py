"""Import statements of one script text, by its tokens.

A slash is a division or a regular expression by what stands before it; template literals nest
through `${`; comments and strings hide their contents. Small and per text: partitioning and
everything behind the statements stay in Spark (`script.extract_imports`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\A\#![^\n]*)
    |(?P<word>[\w$]+)
    |(?P<string>"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*')
    |(?P<tick>`)|(?P<slash>/)|(?P<open>[({\[])|(?P<close>[)}\]])
    |(?P<other>=>|\?\.|\+\+|--|[\s\S])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*(?:`|\$\{|\Z)")
_KEYWORD = re.compile(r"\b(?:import|export)\b")
#: Words before which a value cannot have ended, so a slash behind them begins a regular expression.
_PREFIX_WORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_HEADS = frozenset("if while for with".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    #: what stands before is a member access
    member: bool


class Statement(NamedTuple):
    form: str
    specifier: str
    start: int
    end: int
    type_only: bool
    default: bool
    star: bool
    #: binding names without type-only ones, and how many entries the braces hold
    names: list[str]
    items: int


def tokens(text: str) -> Iterator[Token]:
    """Tokens of a script, without comments and white space."""
    at, end = 0, len(text)
    # what was before: a value (then a slash divides), and the word or sign itself
    value, before, member = False, "", False
    # open brackets: ("(", a head of if, while, for, with), ("{", an expression), ("`", resumes a template)
    held: list[tuple[str, bool]] = []
    while at < end:
        found = _TOKEN.match(text, at)
        kind, word, start = found.lastgroup, found.group(), at
        at = found.end()
        if kind == "skip":
            continue
        after_member, member = member, before in (".", "?.")
        if kind == "word":
            value = word not in _PREFIX_WORDS or member
        elif kind == "string":
            value = True
        elif kind == "slash":
            regex = None if value else _REGEX.match(text, start)
            if regex:
                at, kind, value = regex.end(), "regex", True
            else:
                value = False
        elif kind == "tick" or (kind == "close" and word == "}" and held and held[-1][0] == "`"):
            if kind == "close":
                held.pop()
            body = _TEMPLATE.match(text, at)
            if not body.group().endswith(("`", "${")) and kind == "tick":
                # never closed: a stray sign
                kind, value = "other", False
            else:
                at = body.end()
                open_ = body.group().endswith("${")
                if open_:
                    held.append(("`", False))
                kind = "template" if kind == "tick" and not open_ else "part"
                value = not open_
        elif kind == "open":
            if word == "(":
                held.append((word, before in _HEADS and not after_member))
            else:
                held.append((word, word == "{" and not value and before not in ("", ";", "{", "}", ")", "=>", "else", "do", "try", "finally")))
            value = False
        elif kind == "close":
            opened = held.pop() if held and held[-1][0] != "`" else ("", False)
            # behind a condition or a block a statement begins
            value = not opened[1] if word == ")" else word == "]" or opened[1]
        elif word not in ("++", "--"):
            value = False
        yield Token(kind, text[start:at], start, at, member)
        before = word


def _clause(parts: list[Token], static: bool) -> tuple[bool, bool, bool, list[str], int]:
    """type_only, default, star, names, items of what stands between the keyword and `from`."""
    words = [t.text for t in parts]
    type_only = len(words) > 1 and words[0] == "type" and words[1] != ","
    default = static and bool(parts) and parts[0].kind == "word" and (len(words) == 1 or words[1] == ",")
    star = "*" in (w for w, t in zip(words, parts, strict=True) if t.kind == "other")
    names: list[str] = []
    items = 0
    if "{" in words:
        inner = parts[words.index("{") + 1 :]
        entry: list[Token] = []
        for token in [*inner, Token("other", ",", 0, 0, False)]:
            if token.text in (",", "}") and token.kind != "string":
                if entry:
                    items += 1
                    first = entry[0].text
                    if not (first == "type" and len(entry) in (2, 4)):
                        names.append(first[1:-1] if entry[0].kind == "string" else first)
                entry = []
                if token.text == "}":
                    break
            else:
                entry.append(token)
    return type_only, default, star, names, items


def statements(text: str) -> Iterator[Statement]:
    """Static imports, re-exports and dynamic imports with a literal specifier, in order."""
    stream = tokens(text)
    last = max((m.start() for m in _KEYWORD.finditer(text)), default=-1)
    waiting: list[Token] = []

    def following() -> Token | None:
        return waiting.pop(0) if waiting else next(stream, None)

    token = following()
    while token is not None and token.start <= last:
        if token.kind != "word" or token.text not in ("import", "export") or token.member:
            token = following()
            continue
        first, seen = token, []
        token = following()
        if token is None:
            return
        if first.text == "import" and token.text == "(":
            inner, after = following(), following()
            if inner is not None and after is not None and inner.kind in ("string", "template") and after.text in (")", ","):
                specifier = inner.text[1:-1]
                if specifier and "\n" not in specifier and "${" not in specifier:
                    yield Statement("dynamic", specifier, first.start, inner.end, False, False, False, [], 0)
            waiting[:0] = [t for t in (inner, after) if t is not None]
            token = following()
            continue
        if first.text == "import" and token.kind == "string":
            yield Statement("static", token.text[1:-1], first.start, token.end, False, False, False, [], 0)
            token = following()
            continue
        if first.text == "export" and token.text not in ("type", "*", "{"):
            continue
        # the clause ends at a `from` that a string follows; nothing else may stand in it
        depth = 0
        while token is not None:
            if token.text == "from" and token.kind == "word" and not depth and seen:
                after = following()
                if after is None:
                    return
                if after.kind == "string":
                    type_only, default, star, names, items = _clause(seen, first.text == "import")
                    form = "static" if first.text == "import" else "reexport"
                    if form == "static" or star or "{" in (t.text for t in seen):
                        yield Statement(form, after.text[1:-1], first.start, after.end, type_only, default, star, names, items)
                    token = following()
                    break
                waiting.insert(0, after)
            elif token.text == "{" and token.kind == "open":
                depth += 1
            elif token.text == "}" and token.kind == "close":
                depth -= 1
                if depth < 0:
                    break
            elif not (token.kind in ("word", "string") or token.text in (",", "*")):
                break
            elif token.kind == "word" and token.text in ("import", "export") and not depth:
                break
            elif token.kind == "string" and not (depth or seen and seen[-1].text == "as"):
                break
            seen.append(token)
            token = following()

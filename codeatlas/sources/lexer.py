"""Tokens of TypeScript and JavaScript, with matched brackets.

The reader keeps a stack of modes: code, the expression in a template, a tag, the text of an element, and
the expression in its braces. What a tag and an element's text hold is no code, whatever quotes, backticks or
slashes stand in it; their expressions are lexed as code and stand between ``${`` and ``$}``, as in templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME, NUMBER, STRING, TEMPLATE, REGEX, PUNCT, MARKUP = "name", "number", "string", "template", "regex", "punct", "markup"

_NAME = re.compile(r"#?[A-Za-z_$ª-￿][\w$ª-￿]*")
_NUMBER = re.compile(r"\.?\d[\w.]*")
_STRING = re.compile(r""""(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'""")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*=?|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_SPACE = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
_TAG = re.compile(r"<(?=[A-Za-z_$>])(?P<name>[A-Za-z_$][\w$.:-]*)?")
#: Behind its name, type parameters of an arrow function go on like this and tags don't.
_TYPE_PARAMETER = re.compile(r"\s*(?:,|=(?!>)|extends\b(?!\s*[=/>]))")
#: After these words a slash starts a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "instanceof", "else", "do", "yield", "await"}
_CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens_of(text: str, markup: bool = False) -> list[Token]:
    """Tokens in order; what stands in a template's ``${}`` is lexed too, with ``markup`` elements as well.

    Text that fits no rule is skipped a character at a time, so any input gives tokens.
    """
    out: list[Token] = []
    modes: list[list] = [["code", 0]]  # open templates, tags and elements, with the open braces of the code in them
    at, size = 0, len(text)

    def template(start: int) -> int:
        """The rest of a template's text, up to its end or the next ``${``."""
        i = start
        while i < size:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                out.append(Token(TEMPLATE, text[start:i], start, i + 1))
                return i + 1
            elif text.startswith("${", i):
                out.append(Token(TEMPLATE, text[start:i], start, i))
                out.append(Token(PUNCT, "${", i, i + 2))
                modes.append(["template", 0])
                return i + 2
            else:
                i += 1
        out.append(Token(TEMPLATE, text[start:size], start, size))
        return size

    def element(start: int) -> int:
        """On from a tag or an element's text, up to the next braces or to the end of the outermost element."""
        i = start

        def put(end: int) -> None:
            if end > start:  # tokens of an element follow each other without a gap
                out.append(Token(MARKUP, text[start:end], start, end))

        while i < size and modes[-1][0] in ("tag", "text"):
            if modes[-1][0] == "text":
                brace, angle = text.find("{", i), text.find("<", i)
                if brace < 0 and angle < 0:
                    i = size
                elif angle < 0 or 0 <= brace < angle:
                    i = brace
                elif text.startswith("</", angle):
                    modes.pop()
                    i = text.find(">", angle) + 1 or size
                    continue
                elif m := _TAG.match(text, angle):
                    modes.append(["tag", 0])
                    i = m.end()
                    continue
                else:
                    i = angle + 1
                    continue
            elif m := _SPACE.match(text, i):
                i = m.end()
                continue
            elif text.startswith("/>", i):
                modes.pop()
                i += 2
                continue
            elif text[i] == ">":
                modes[-1][0] = "text"
                i += 1
                continue
            elif text[i] in "\"'":
                i = text.find(text[i], i + 1) + 1 or size
                continue
            elif text[i] == "<":
                if text[start:i].rstrip().endswith("=") and (m := _TAG.match(text, i)):  # an element as a value
                    modes.append(["tag", 0])
                    i = m.end()
                else:  # type arguments of a component
                    i = text.find(">", i) + 1 or size
                continue
            elif text[i] != "{":
                i += 1
                continue
            if i < size:
                put(i)
                out.append(Token(PUNCT, "${", i, i + 1))
                modes.append(["braces", 0])
                return i + 1
        put(i)
        return i

    def begins_element(i: int) -> re.Match | None:
        """The tag at ``i``, if an expression may start there and its element ends somewhere."""
        m = _TAG.match(text, i)
        if not m or not _value_may_start(out):
            return None
        name = m["name"] or ""
        if name and _TYPE_PARAMETER.match(text, m.end()):
            return None
        close = text.find("/>", m.end())
        return m if text.find(f"</{name}", m.end()) >= 0 or (name and 0 <= close and "<" not in text[m.end() : close]) else None

    while at < size:
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if c == "`":
            at = template(at + 1)
            continue
        if m := _NAME.match(text, at):
            out.append(Token(NAME, m[0], at, m.end()))
        elif m := _NUMBER.match(text, at):
            out.append(Token(NUMBER, m[0], at, m.end()))
        elif m := _STRING.match(text, at):
            out.append(Token(STRING, m[0], at, m.end()))
        elif c == "<" and markup and (m := begins_element(at)):
            modes.append(["tag", 0])
            start = at
            at = m.end()
            out.append(Token(MARKUP, text[start:at], start, at))
            at = element(at)
            continue
        elif c == "/" and _value_may_start(out) and (m := _REGEX.match(text, at)):
            out.append(Token(REGEX, m[0], at, m.end()))
        elif m := _PUNCT.match(text, at):
            if c == "{":
                modes[-1][1] += 1
            elif c == "}":
                if modes[-1][1] == 0 and len(modes) > 1:
                    kind, _ = modes.pop()
                    out.append(Token(PUNCT, "$}", at, at + 1))
                    at = (template if kind == "template" else element)(at + 1)
                    continue
                modes[-1][1] -= 1
            out.append(Token(PUNCT, m[0], at, m.end()))
        else:
            at += 1
            continue
        at = m.end()
    return out


def _value_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    if last.kind == NAME:
        return last.text in _BEFORE_REGEX
    return last.kind == PUNCT and last.text not in (")", "]", "}", "$}", "++", "--")


def matched(tokens: list[Token]) -> dict[int, int]:
    """The closing bracket of each opening one; unclosed ones end with the text."""
    found: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != PUNCT:
            continue
        if t.text in _CLOSING or t.text == "${":
            stack.append(i)
        elif t.text in (")", "]", "}", "$}"):
            while stack:
                open_ = stack.pop()
                wanted = "$}" if tokens[open_].text == "${" else _CLOSING[tokens[open_].text]
                found[open_] = i
                if wanted == t.text:
                    break
    for i in stack:
        found[i] = len(tokens) - 1
    return found

"""Tokens of TypeScript, JavaScript and their JSX forms, with matched brackets. Broken sources never fail."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, regex, mark, open, close, jsx
    text: str
    start: int
    end: int
    line: int


_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_WORD = re.compile(r"#?[^\W\d][\w$‌‍]*|#?\$[\w$]*|#?_[\w$]*")
_NUMBER = re.compile(r"0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_MARK = re.compile(r"\.\.\.|=>|===?|!==?|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|\+\+|--|[-+*/%&|^]=|<=|<<=?|[-+*/%&|^~!?:;,.<>=@#\\]")
_TAG = re.compile(r"[\w$.:-]*")
_TYPE_PARAMETER = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=(?!=))")
_TYPED_FUNCTION = re.compile(r"<[^<>]*>\s*\(")
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words after which an operand follows.
BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do await yield instanceof default extends".split())


class Lexer:
    def __init__(self, source: str):
        self.source, self.at, self.line, self.tokens = source, 0, 1, []

    def _emit(self, kind: str, end: int) -> None:
        text = self.source[self.at : end]
        self.tokens.append(Token(kind, text, self.at, end, self.line))
        self._move(end)

    def _move(self, end: int) -> None:
        self.line += self.source.count("\n", self.at, end)
        self.at = end

    def _operand_next(self) -> bool:
        """Can an operand (a regular expression, an element) start here?"""
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "word":
            return last.text in BEFORE_OPERAND and not (len(self.tokens) > 1 and self.tokens[-2].text in (".", "?."))
        return last.kind == "open" and last.text != "`" or last.kind == "mark" and last.text not in ("++", "--")

    def run(self, stop: bool = False) -> None:
        """Reads on; with stop, up to the closing brace of the brace that was read last."""
        source, size, depth = self.source, len(self.source), 0
        while True:
            if m := _SKIP.match(source, self.at):
                self._move(m.end())
            if self.at >= size:
                return
            c = source[self.at]
            if c in OPENS:
                depth += c == "{"
                self._emit("open", self.at + 1)
            elif c in CLOSES:
                if c == "}":
                    if stop and depth == 0:
                        return
                    depth -= 1
                self._emit("close", self.at + 1)
            elif c in "\"'":
                self._emit("string", _STRING.match(source, self.at).end())
            elif c == "`":
                self._template()
            elif m := _WORD.match(source, self.at):
                self._emit("word", m.end())
            elif c.isdigit() or c == "." and source[self.at + 1 : self.at + 2].isdigit():
                self._emit("number", _NUMBER.match(source, self.at).end())
            elif c == "/" and self._operand_next() and (m := _REGEX.match(source, self.at)):
                self._emit("regex", m.end())
            elif c == "<" and self._operand_next() and self._is_element():
                self._element()
            elif m := _MARK.match(source, self.at):
                self._emit("mark", m.end())
            else:
                self._move(self.at + 1)

    def _template(self) -> None:
        source, size = self.source, len(self.source)
        self._emit("open", self.at + 1)
        while self.at < size:
            c = source[self.at]
            if c == "\\":
                self._move(min(size, self.at + 2))
            elif c == "`":
                self._emit("close", self.at + 1)
                return
            elif source.startswith("${", self.at):
                self._container(self.at + 2)
            else:
                self._move(self.at + 1)

    def _container(self, end: int) -> None:
        """An expression in braces inside a template or an element."""
        self.tokens.append(Token("open", "{", self.at, end, self.line))
        self._move(end)
        self.run(stop=True)
        if self.at < len(self.source):
            self._emit("close", self.at + 1)

    def _is_element(self) -> bool:
        after = self.source[self.at + 1 : self.at + 2]
        if not (after.isalpha() or after in ("_", "$", ">")):
            return False
        if _TYPE_PARAMETER.match(self.source, self.at):
            return False
        return not (self.tokens and self.tokens[-1].text == ":" and _TYPED_FUNCTION.match(self.source, self.at))

    def _element(self) -> None:
        source, size = self.source, len(self.source)
        self._emit("jsx", _TAG.match(source, self.at + 1).end())
        while self.at < size:  # attributes
            if m := _SKIP.match(source, self.at):
                self._move(m.end())
                continue
            c = source[self.at]
            if source.startswith("/>", self.at):
                self._emit("jsx", self.at + 2)
                return
            if c == ">":
                self._move(self.at + 1)
                break
            if c in "\"'":
                end = source.find(c, self.at + 1)
                self._move(size if end < 0 else end + 1)
            elif c == "{":
                self._container(self.at + 1)
            elif c == "<":
                self._element()
            else:
                self._move(self.at + 1)
        while self.at < size:  # children
            c = source[self.at]
            if source.startswith("</", self.at):
                end = source.find(">", self.at)
                self._emit("jsx", size if end < 0 else end + 1)
                return
            if c == "{":
                self._container(self.at + 1)
            elif c == "<":
                self._element()
            else:
                self._move(self.at + 1)


def tokenize(source: str) -> tuple[list[Token], list[int]]:
    """Tokens, and for each bracket the place of its partner (for an unmatched one and for all other tokens, its own)."""
    lexer = Lexer(source)
    lexer.run()
    tokens, match, stack = lexer.tokens, list(range(len(lexer.tokens))), []
    for i, t in enumerate(tokens):
        if t.kind == "open":
            stack.append(i)
        elif t.kind == "close":
            want = "`" if t.text == "`" else CLOSES[t.text]
            depth = next((k for k in reversed(range(len(stack))) if tokens[stack[k]].text == want), -1)
            if depth >= 0:
                match[i], match[stack[depth]] = stack[depth], i
                del stack[depth:]
    for i in stack:  # never closed: up to the end
        match[i] = len(tokens)
    return tokens, match

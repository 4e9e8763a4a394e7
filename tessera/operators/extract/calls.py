"""Calls in a range of tokens, an outer call before those in its callee and its arguments."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.operators.extract.lexer import Token

#: Words that are no callee and no operand of their own.
RESERVED = frozenset(
    "if for while switch catch return typeof function class new else do try finally throw case in of delete void await yield instanceof "
    "const let var import export extends implements default with break continue as satisfies debugger super".split()
)


class Calls:
    def __init__(self, tokens: list[Token], match: list[int]):
        self.tokens, self.match = tokens, match

    def type_arguments(self, i: int, end: int) -> int:
        """After <...> at i if that can be type arguments or parameters, else i."""
        if i >= end or self.tokens[i].text != "<":
            return i
        depth = 0
        while i < end:
            t = self.tokens[i]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif t.kind == "open":
                i = self.match[i]
            elif t.kind == "close" or t.text in (";", "&&", "||", "+", "*", "/", "++", "--"):
                break
            i += 1
        return self._start(i, depth)

    def _start(self, i: int, depth: int) -> int:
        while depth > 0 and i > 0:
            i -= 1
            if self.tokens[i].kind == "close":
                i = self.match[i]
            elif self.tokens[i].text == "<":
                depth -= 1
            elif self.tokens[i].text == ">":
                depth += 1
        return i

    def find(self, i: int, end: int, members: bool = False) -> Iterator[dict]:
        """members: the range is a class body or an object literal, where `name(...) {` is a method."""
        tokens, match = self.tokens, self.match
        while i < end:
            t = tokens[i]
            if t.kind == "word" and t.text == "function":
                i += 1
                while i < end and (tokens[i].text == "*" or tokens[i].kind == "word"):
                    i += 1
                i = self.type_arguments(i, end)
            elif t.kind == "word" and t.text == "class":
                while i < end and tokens[i].text != "{":
                    i += 1
                if i < end:
                    yield from self.find(i + 1, min(end, match[i]), members=True)
                    i = match[i] + 1
            elif t.kind == "word" and members and self._is_method(i, end):
                i = self.type_arguments(i + 1, end)
            elif t.kind == "word" and (t.text not in RESERVED or t.text in ("new", "super")) or t.kind in ("string", "number", "regex") or t.kind == "open":
                if t.kind == "open" and t.text != "`" and i and tokens[i - 1].text == ")" and t.text == "{":
                    yield from self._inside(i, end)  # a block after a header
                    i = match[i] + 1
                else:
                    i, calls = self._chain(i, end)
                    yield from calls
            else:
                i += 1

    def _is_method(self, i: int, end: int) -> bool:
        k = self.type_arguments(i + 1, end)
        if k >= end or self.tokens[k].text != "(" or (i and self.tokens[i - 1].text in (".", "?.", "=", ":", "new", "=>", "return", "await")):
            return False
        k = self.match[k] + 1
        if k < end and self.tokens[k].text == ":":
            while k < end and self.tokens[k].text not in ("{", ";", ","):
                k = self.match[k] + 1 if self.tokens[k].kind == "open" else k + 1
        return k < end and self.tokens[k].text == "{"

    def _inside(self, i: int, end: int) -> Iterator[dict]:
        """Calls in a bracket."""
        t, stop = self.tokens[i], min(end, self.match[i])
        yield from self.find(i + 1, stop, members=t.text == "{" and self.is_object(i))

    def is_object(self, i: int) -> bool:
        """Is the brace at i an object literal?"""
        if i == 0:
            return False
        p = self.tokens[i - 1]
        if p.kind == "word":
            return p.text in ("return", "default", "typeof", "in", "of", "case", "throw", "await", "yield", "new")
        return p.kind == "open" and p.text in "([" or p.kind == "mark" and p.text not in (";", "=>", ">", ":") or p.text == ":" and not self._is_label(i - 1)

    def _is_label(self, i: int) -> bool:
        """Is the colon at i that of a case or a label, after which a block stands?"""
        k = i - 1
        while k >= 0 and self.tokens[k].kind in ("word", "string", "number") and self.tokens[k].text not in ("case", "default"):
            k -= 1
        return k >= 0 and self.tokens[k].text in ("case", "default")

    def _chain(self, i: int, end: int) -> tuple[int, Iterator[dict]]:
        """The operand at i with all that is applied to it; calls come from the last one on."""
        tokens, match = self.tokens, self.match
        steps: list[tuple[str, int]] = []
        made = tokens[i].text == "new" and tokens[i].kind == "word"
        if made:
            i += 1
            if i >= end:
                return i, iter(())
        steps.append(("operand", i))
        i = match[i] + 1 if tokens[i].kind == "open" else i + 1
        while i < end:
            t = tokens[i]
            after = self.type_arguments(i, end) if t.text == "<" else i
            if t.text in (".", "?.") and i + 1 < end:
                n = tokens[i + 1]
                if n.kind == "word":
                    steps.append(("member", i + 1))
                    i += 2
                elif n.kind == "open" and n.text in "([":
                    i += 1
                else:
                    break
            elif t.text == "!" and t.line == tokens[i - 1].line and not (i + 1 < end and tokens[i + 1].text in ("=", "==")):
                steps.append(("sure", i))
                i += 1
            elif t.text == "[":
                steps.append(("index", i))
                i = match[i] + 1
            elif t.text == "`":
                steps.append(("call", i))
                i = match[i] + 1
            elif after < end and tokens[after].text == "(":
                steps.append(("new" if made else "call", after))
                made = False
                i = match[after] + 1
            else:
                break
        return i, self._emit(steps, len(steps) - 1, end)

    def _emit(self, steps: list[tuple[str, int]], k: int, end: int) -> Iterator[dict]:
        tokens = self.tokens
        kind, i = steps[k]
        if kind == "operand":
            if tokens[i].kind == "open":
                yield from self._inside(i, end)
            return
        if kind == "call":
            before, j = steps[k - 1]
            line = tokens[steps[0][1]].line
            if before == "operand" and tokens[j].kind == "word" and tokens[j].text not in ("super", "this", "import", "async"):
                yield {"name": tokens[j].text, "is_member": False, "object": None, "line": line}
            elif before == "member":
                own = steps[k - 2][0] == "operand" and tokens[steps[k - 2][1]].kind == "word" and tokens[steps[k - 2][1]].text not in ("this", "super")
                yield {"name": tokens[j].text, "is_member": True, "object": tokens[steps[k - 2][1]].text if own else None, "line": line}
        yield from self._emit(steps, k - 1, end)
        if kind in ("call", "new", "index"):
            yield from self.find(i + 1, min(end, self.match[i]))

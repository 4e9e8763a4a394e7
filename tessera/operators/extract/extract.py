"""Symbols, imports and call edges of one source file.

The rules are those of a syntax tree read from the top: a symbol for each named declaration in source order, calls of a function or
method for its whole body (a nested function's calls count for both), none for arrow functions and none at top level.
"""

from __future__ import annotations

import re

from tessera.operators.extract.calls import Calls
from tessera.operators.extract.lexer import Token, tokenize

#: Words before a member's name.
MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())
_DECLARES = frozenset("function class interface type enum const let var import export namespace module abstract declare async".split())
_EXTENSION = re.compile(r"[^/]\.([^./]*)$")
_CONTINUES = frozenset(". ?. => = + - * / % ? : , && || ?? == === != !== < > <= >= | & ^ ** += -= *= /= ( [ { `".split())
_CONTINUE_WORDS = frozenset("in of instanceof as satisfies is extends implements".split())


class Extractor:
    def __init__(self, source: str, namespace_imports: bool = True):
        self.source, self.namespace_imports = source, namespace_imports
        self.tokens, self.match = tokenize(source)
        self.calls = Calls(self.tokens, self.match)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.edges: list[dict] = []
        self.scope: list[tuple[str, str]] = []

    # tokens

    def text(self, i: int, end: int) -> str:
        """The source from token i up to token end."""
        return self.source[self.tokens[i].start : self.tokens[end - 1].end] if i < end else ""

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "string"

    def past(self, i: int) -> int:
        return self.match[i] + 1 if self.tokens[i].kind == "open" else i + 1

    def breaks(self, i: int) -> bool:
        """Does a statement end before token i because a new line starts there that can't go on with it?"""
        t, last = self.tokens[i], self.tokens[i - 1]
        if t.line == last.line + self.source.count("\n", last.start, last.end) and self.source.find("\n", last.end, t.start) < 0:
            return False
        if last.kind == "mark" and last.text not in ("++", "--", "!", ">") or last.kind == "word" and last.text in _CONTINUE_WORDS:
            return False
        return not (t.text in _CONTINUES and t.kind != "string" and t.text != "{" or t.kind == "word" and t.text in _CONTINUE_WORDS)

    def statement_end(self, i: int, end: int) -> int:
        """After the statement's last token, its semicolon not counted."""
        k = i
        while k < end:
            if self.is_(k, ";") or k > i and self.breaks(k):
                return k
            k = self.past(k)
        return min(k, end)

    def type_end(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """Where a type that starts at i ends: at one of the stops outside brackets, or where a line can't go on."""
        k, angle = i, 0
        while k < end:
            t = self.tokens[k]
            if angle == 0 and t.kind != "string" and t.text in stops and not (t.text == "{" and (k == i or self.tokens[k - 1].text in ("|", "&", "=>", ":", "<", ","))):
                return k
            if angle == 0 and k > i and self.breaks(k):
                return k
            angle += (t.text == "<") - (t.text == ">" and angle > 0)
            k = self.past(k)
        return min(k, end)

    def starts_statement(self, i: int, low: int) -> bool:
        if i <= low:
            return True
        p = self.tokens[i - 1]
        return p.text in (";", "{", "}", ")", "else", "do", ":") and p.kind in ("mark", "open", "close", "word") or self.breaks(i)

    # output

    def symbol(self, name: str, kind: str, first: int, last: int, exported: bool, default: bool, is_async: bool = False, signature: str | None = None) -> None:
        parent, enclosing = self.scope[-1] if self.scope else (None, None)
        end = self.tokens[min(last, len(self.tokens)) - 1]
        self.symbols.append(
            {
                "name": name, "kind": kind, "line_start": self.tokens[first].line, "line_end": end.line + self.source.count("\n", end.start, end.end), "signature": signature,
                "is_export": exported, "is_default_export": default, "is_async": is_async, "parent_symbol": parent, "enclosing_type": enclosing,
            }
        )

    def body_calls(self, name: str, brace: int) -> None:
        for call in self.calls.find(brace + 1, min(self.match[brace], len(self.tokens))):
            self.edges.append(call | {"caller_symbol_name": name})

    def inner(self, brace: int, exported: bool, kind: str = "block") -> None:
        self.walk(brace + 1, min(self.match[brace], len(self.tokens)), exported, kind)

    # the walk

    def walk(self, i: int, end: int, exported: bool = False, kind: str = "block", default: bool = False) -> None:
        """All declarations in a range. kind: block, class or object, which say what a name before a bracket is."""
        low, in_default = i, default
        while i < end:
            t = self.tokens[i]
            if kind == "class":
                i = self.member(i, end, exported)
                continue
            if kind == "object" and (after := self.method(i, end, exported)):
                i = after
                continue
            if t.kind == "open":
                self.inner(i, exported, "object" if t.text == "{" and self.calls.is_object(i) else "block")
                i = self.match[i] + 1
                continue
            if t.kind != "word" or i and self.tokens[i - 1].text in (".", "?."):
                i += 1
                continue
            if t.text in ("case", "default") and kind == "block" and self.starts_statement(i, low):
                in_default = t.text == "default"
            if t.text in _DECLARES:
                i = self.declaration(i, end, low, exported, in_default)
            else:
                i += 1

    def declaration(self, i: int, end: int, low: int, exported: bool, default: bool) -> int:
        word, at_start = self.tokens[i].text, self.starts_statement(i, low)
        if word == "import" and at_start and not self.is_(i + 1, "(", "."):
            return self.import_statement(i, end)
        if word == "export" and at_start:
            k = i + 1
            is_default = self.is_(k, "default")
            k += is_default
            if self.is_(k, "{", "*", "="):
                return self.statement_end(i, end)
            while self.is_(k, "declare") and k + 1 < end and self.tokens[k + 1].kind == "word":
                k += 1
            stop = self.declared_end(k, end)
            if is_default and not (k < end and self.tokens[k].text in ("function", "class", "abstract", "interface", "async")):
                self.walk(k, stop, True)
            else:
                self.walk(k, stop, True, default=is_default)
            return max(stop, i + 1)
        if word == "async" and self.is_(i + 1, "function") and at_start:
            return self.function(i + 1, i, end, exported, default, True)
        if word == "function":
            return self.function(i, i, end, exported, default, False) if at_start else self.skip_function(i, end, exported)
        if word == "class":
            abstract = i > low and self.tokens[i - 1].text == "abstract"
            return self.class_(i, end, exported, default, at_start and not abstract)
        if word in ("interface", "enum") and i + 1 < end and self.tokens[i + 1].kind == "word" and (at_start or self.tokens[i - 1].text == "const"):
            return self.named_block(i, end, word, exported, default)
        if word == "type" and at_start and i + 1 < end and self.tokens[i + 1].kind == "word" and self.tokens[i + 1].line == self.tokens[i].line:
            k = self.calls.type_arguments(i + 2, end)
            if self.is_(k, "="):
                stop = self.type_end(k + 1, end, (";",))
                self.symbol(self.tokens[i + 1].text, "type_alias", i, stop, exported, default)
                return stop
        if word in ("const", "let", "var") and not self.is_(i + 1, "enum"):
            return self.variables(i, end, exported)
        return i + 1

    def declared_end(self, i: int, end: int) -> int:
        """The end of what an export exports."""
        k = i
        while k < end and self.tokens[k].text in ("async", "abstract", "declare", "const"):
            k += 1
        if k < end and self.tokens[k].text in ("function", "class", "interface", "enum", "namespace", "module"):
            while k < end and not self.is_(k, "{", ";") and not (k > i + 1 and self.tokens[i].text == "function" and self.breaks(k)):
                k = self.past(k) if self.tokens[k].text != "{" else k
            return min(self.past(k), end) if self.is_(k, "{") else k
        return self.statement_end(i, end)

    def import_statement(self, i: int, end: int) -> int:
        stop, line = self.statement_end(i, end), self.tokens[i].line
        k, is_type = i + 1, False
        if self.is_(k, "type") and k + 1 < stop and (self.tokens[k + 1].text in ("{", "*") or self.tokens[k + 1].kind == "word" and self.tokens[k + 1].text != "from"):
            k, is_type = k + 1, True
        place = next((p for p in range(k, stop) if self.tokens[p].kind == "string"), None)
        has_from = place is not None and self.is_(place - 1, "from")
        source = self.tokens[place].text.strip('"').strip("'") if place is not None and (has_from or place == k) else ""

        def add(name: str, kind: str, alias: str | None = None) -> None:
            self.imports.append({"symbol_name": name, "alias_name": alias, "source_path": source, "import_type": kind, "line": line, "is_type_import": is_type})

        if not has_from:
            add("", "side_effect")
            return stop
        while k < place - 1:
            t = self.tokens[k]
            if t.text == "{":
                p, close = k + 1, self.match[k]
                while p < close:
                    q = p
                    while q < close and self.tokens[q].text != ",":
                        q += 1
                    part = self.tokens[p:q]
                    if part and part[0].text == "type" and len(part) > 1 and part[1].text != "as" or len(part) == 4 and part[0].text == "type":
                        part = part[1:]
                    if part:
                        add(part[0].text, "named", part[2].text if len(part) > 2 and part[1].text == "as" else None)
                    p = q + 1
                k = close
            elif t.text == "*" and self.is_(k + 1, "as") and k + 2 < place:
                if self.namespace_imports:
                    add(self.tokens[k + 2].text, "namespace")
                k += 2
            elif t.kind == "word":
                add(t.text, "default")
            k += 1
        return stop

    def header(self, i: int, end: int) -> tuple[int, int, int, int] | None:
        """From type parameters or parameters at i: (parameters, after them, after the return type, the body's brace or -1)."""
        k = self.calls.type_arguments(i, end)
        if not self.is_(k, "("):
            return None
        after = typed = self.match[k] + 1
        if self.is_(after, ":"):
            typed = self.type_end(after + 1, end, ("{", ";", "=>", ","))
        return k, after, typed, typed if typed < end and self.is_(typed, "{") else -1

    def signature(self, name: str, parts: tuple[int, int, int, int]) -> str:
        params, after, typed, _ = parts
        out = name + self.text(params, after)
        return f"{out}: {self.text(after, typed)}" if typed > after else out

    def function(self, i: int, first: int, end: int, exported: bool, default: bool, is_async: bool) -> int:
        """A function declaration; without a body it is none."""
        k = i + 1
        generator = self.is_(k, "*")
        k += generator
        if not (k < end and self.tokens[k].kind == "word" and not self.is_(k, "function")):
            return self.skip_function(i, end, exported)
        name, parts = self.tokens[k].text, self.header(k + 1, end)
        if parts is None or parts[3] < 0:
            return i + 1
        brace = parts[3]
        if not generator:
            self.scope.append((name, "function"))
        self.symbol(name, "function", first, self.match[brace] + 1, exported, default, is_async, self.signature(name, parts))
        self.body_calls(name, brace)
        self.inner(parts[0], exported)
        self.inner(brace, exported)
        if not generator:
            self.scope.pop()
        return self.match[brace] + 1

    def skip_function(self, i: int, end: int, exported: bool) -> int:
        """A function expression: its parts are walked."""
        k = i + 1
        while k < end and (self.is_(k, "*") or self.tokens[k].kind == "word"):
            k += 1
        parts = self.header(k, end)
        if parts is None:
            return i + 1
        self.inner(parts[0], exported)
        if parts[3] >= 0:
            self.inner(parts[3], exported)
            return self.match[parts[3]] + 1
        return parts[2]

    def class_(self, i: int, end: int, exported: bool, default: bool, declared: bool) -> int:
        k = i + 1
        name = self.tokens[k].text if k < end and self.tokens[k].kind == "word" and self.tokens[k].text not in ("extends", "implements") else None
        while k < end and not self.is_(k, "{"):
            k = self.past(k)
        if k >= end:
            return i + 1
        named = declared and name is not None
        if named:
            self.scope.append((name, "class"))
            self.symbol(name, "class", i, self.match[k] + 1, exported, default, signature=f"class {name}")
        self.inner(k, exported, "class")
        if named:
            self.scope.pop()
        return self.match[k] + 1

    def named_block(self, i: int, end: int, word: str, exported: bool, default: bool) -> int:
        name, k = self.tokens[i + 1].text, i + 2
        while k < end and not self.is_(k, "{"):
            k = self.past(k)
        first = i - 1 if i and self.tokens[i - 1].text == "const" else i
        if k < end:
            self.symbol(name, word, first, self.match[k] + 1, exported, default, signature=f"interface {name}" if word == "interface" else None)
            return self.match[k] + 1
        return i + 1

    def variables(self, i: int, end: int, exported: bool) -> int:
        """Declarators up to the end of their statement; a loop over elements declares none."""
        stop, k = self.statement_end(i, end), i + 1
        if i and self.tokens[i - 1].text == "(" and any(self.is_(p, "of", "in") for p in (self.past(k),) if k < end):
            return self.past(k)
        while k < stop:
            first, after = k, self.past(k)
            name = self.text(first, min(after, stop))
            if self.is_(after, "!"):
                after += 1
            if self.is_(after, ":"):
                after = self.type_end(after + 1, stop, ("=", ",", ";"))
            value = after + 1 if after < stop and self.is_(after, "=") else None
            last = after
            if value is not None:
                last = value
                while last < stop and not self.is_(last, ","):
                    skip = self.calls.type_arguments(last, stop) if self.is_(last, "<") else last
                    last = skip if skip > last and self.is_(skip, "(") else self.past(last)
                last = min(last, stop)
            arrow = self.arrow(value, last) if value is not None else None
            if arrow:
                self.symbol(name, "arrow_function", first, last, exported, False, signature=name + arrow)
            else:
                self.symbol(name, "variable", first, last, exported, False)
            if self.tokens[first].kind == "open":
                self.inner(first, exported)
            if value is not None:
                self.walk(value, last, exported)
            k = last + 1
        return stop

    def arrow(self, i: int, end: int) -> str | None:
        """What follows the name in the signature if the whole value from i is an arrow function."""
        if self.is_(i, "async") and i + 1 < end and not self.is_(i + 1, "=>"):
            i += 1
        if i + 1 < end and self.tokens[i].kind == "word" and self.is_(i + 1, "=>"):
            return "()"
        parts = self.header(i, end)
        if parts is None or not self.is_(parts[2], "=>") or parts[2] >= end:
            return None
        return self.signature("", parts)

    def method(self, i: int, end: int, exported: bool) -> int:
        """After the method that starts at i, or 0 if none does."""
        k, is_async, star = i, False, False
        while k < end:
            t = self.tokens[k]
            following = self.tokens[k + 1] if k + 1 < end else None
            if t.text == "@" and t.kind == "mark":  # decorators
                k += 1
                while k < end and self.tokens[k].kind == "word":
                    k += 2 if self.is_(k + 1, ".") else 1
                    if not self.is_(k - 1, "."):
                        break
                if self.is_(k, "("):
                    k = self.match[k] + 1
            elif t.kind == "word" and t.text in MODIFIERS and following and (following.kind in ("word", "string", "number") or following.text in ("[", "*", "#", "@")):
                is_async |= t.text == "async"
                k += 1
            elif t.text == "*" and t.kind == "mark":
                k, star = k + 1, True
            else:
                break
        if k >= end or not (self.tokens[k].kind in ("word", "string", "number") or self.tokens[k].text == "["):
            return 0
        after = self.past(k)
        name_end = after
        if self.is_(after, "?", "!"):
            after += 1
        parts = self.header(after, end)
        if parts is None or parts[3] < 0:
            return 0
        if self.tokens[k].text in ("function", "if", "for", "while", "switch", "catch") and self.tokens[k].kind == "word" and not star and i and self.tokens[i - 1].text not in ("{", ",", ";", "}"):
            return 0
        name, brace = self.text(k, name_end), parts[3]
        self.symbol(name, "method", i, self.match[brace] + 1, exported, False, is_async, self.signature(name, parts))
        self.body_calls(name, brace)
        self.walk(i, k, exported)
        self.inner(parts[0], exported)
        self.inner(brace, exported)
        return self.match[brace] + 1

    def member(self, i: int, end: int, exported: bool) -> int:
        """A member of a class body: a method, a static block, or a field or signature, whose value is walked."""
        if self.is_(i, ";", ","):
            return i + 1
        if self.is_(i, "static") and self.is_(i + 1, "{"):
            self.inner(i + 1, exported)
            return self.match[i + 1] + 1
        if after := self.method(i, end, exported):
            return after
        k = i
        while k < end and not self.is_(k, ";") and not (k > i and self.breaks(k) and not self.is_(k - 1, "@")):
            if self.is_(k, "="):
                stop = self.statement_end(k + 1, end)
                self.walk(k + 1, stop, exported)
                return max(stop, k + 1)
            k = self.past(k)
        return max(k, i + 1)


def extract_source(path: str, content: bytes, namespace_imports: bool = True) -> dict:
    """language, lines, bytes, symbols, imports and call_edges of a file; error is set, and the lists are empty, if it can't be read.

    namespace_imports: `import * as x` gives a row of type namespace.
    """
    name = path.rsplit("/", 1)[-1]
    m = _EXTENSION.search(name)
    out = {"language": "typescriptreact" if m and m[1] == "tsx" else "typescript", "lines": content.count(b"\n"), "bytes": len(content), "symbols": [], "imports": [], "call_edges": [], "error": None}
    try:
        e = Extractor(content.decode("utf-8", "replace"), namespace_imports)
        e.walk(0, len(e.tokens))
        out |= {"symbols": e.symbols, "imports": e.imports, "call_edges": e.edges}
    except RecursionError:
        out["error"] = "nested too deeply"
    return out


__all__ = ["Extractor", "Token", "extract_source"]

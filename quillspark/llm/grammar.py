"""Syntax checks for eight languages: Python, JavaScript, TypeScript, Go, Java, JSON, YAML and SQL.

Python, JSON and YAML use the parsers at hand. The others have a lexer each (one regular expression) and a
recursive-descent recogniser over the token kinds. What lies between two braces is recognised once for each
different sequence of kinds and remembered, since code repeats its shapes far more often than its names.
"""

from __future__ import annotations

import copy
import json
import re
import sys
import warnings
from collections import Counter
from itertools import accumulate

try:
    import yaml
except ImportError:  # then files of YAML stay undecided
    yaml = None

EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql",
}
#: Frames of the recognisers. They recurse in the interpreter's heap, not on the C stack; what is nested deeper is undecided.
FRAMES = 60_000


class Bad(Exception):
    """Not a sentence of the grammar."""


class Undecided(Exception):
    """The grammar at hand cannot tell: it is missing, or the text is nested deeper than it can follow."""


# --- lexers ---------------------------------------------------------------------------------------------------

_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
_LEX = {
    "javascript": re.compile(
        rf"(?P<ws>[ \t\r\f\v\xa0﻿]+)|(?P<nl>\n)|(?P<com>{_C_COMMENT}|\A#![^\n]*)|(?P<num>{_NUM}n?)(?![\w$])|(?P<id>[#@]?[A-Za-z_$\u0080-￿][\w$]*)"
        r"""|(?P<str>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')|(?P<tmpl>`)"""
        r"|(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
    ),
    "java": re.compile(
        rf"(?P<ws>[ \t\r\f]+)|(?P<nl>\n)|(?P<com>{_C_COMMENT})|(?P<num>{_NUM}[lLfFdD]?)(?![\w$])|(?P<id>@?[A-Za-z_$\u0080-￿][\w$]*)"
        r'''|(?P<str>"""[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)')'''
        r"|(?P<op>\.\.\.|->|::|<<=|==|!=|<=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<<|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
    ),
    "go": re.compile(
        rf"(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<com>{_C_COMMENT})|(?P<num>{_NUM}i?)(?!\w)|(?P<id>[A-Za-z_\u0080-￿]\w*)"
        r"""|(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))')"""
        r"|(?P<op>\.\.\.|&\^=|<<=|>>=|&\^|<-|:=|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<<|>>|[{}()\[\];,<>+\-*/%&|^!~:=.])"
    ),
    "sql": re.compile(
        r"(?P<ws>\s+)|(?P<com>--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?!\w)|(?P<str>[eEnNxXbB]?'(?:[^']|'')*')"
        r"""|(?P<id>[A-Za-z_\u0080-￿][\w$]*|"(?:[^"]|"")+"|`[^`]+`|\[[A-Za-z_][\w ]*\])|(?P<par>\?|[:@$]\w+)"""
        r"|(?P<op>::|<>|!=|>=|<=|\|\||->>|->|[()+\-*/%=<>,.;~&|^\[\]])"
    ),
}
_LEX["typescript"] = _LEX["javascript"]

_JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set null true false enum".split()
)
_TS_WORDS = _JS_WORDS | frozenset("interface type namespace module declare abstract as satisfies keyof infer is asserts readonly public private protected implements override unique from accessor global".split())
_JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while null true false var record yield sealed permits non when".split()
)
_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_WORDS = {"javascript": _JS_WORDS | {"as", "from"}, "typescript": _TS_WORDS, "java": _JAVA_WORDS, "go": _GO_WORDS}
_OPEN = {"(": ")", "[": "]", "{": "}"}
# Before these a slash begins a regular expression.
_REGEX_AFTER = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Tokens:
    """Kinds of the tokens ('a' a name, '0' a number, '"' a string), whether a line break stands before each, and where its bracket's partner is."""

    __slots__ = ("k", "nl", "mate", "adj", "text", "off", "inner")

    def __init__(self, code: str, language: str):
        self.k, self.nl, self.adj, self.inner = [], [], [], []
        words, lex, script = _WORDS.get(language, ()), _LEX[language], language in ("javascript", "typescript")
        at, n, new, end = 0, len(code), False, -1
        k, nl, adj = self.k, self.nl, self.adj
        go = language == "go"
        match = lex.match
        while at < n:
            m = match(code, at)
            if m is None:
                raise Bad(f"a character that begins no token at {at}")
            kind, was = m.lastgroup, at
            at = m.end()
            if kind == "ws":
                continue
            if kind == "nl":
                new = True
                if go and k and (k[-1] in _GO_ENDS):
                    k.append(";"), nl.append(False), adj.append(False)
                continue
            if kind == "com":
                if "\n" in m[0]:
                    new = True
                    if go and k and k[-1] in _GO_ENDS:
                        k.append(";"), nl.append(False), adj.append(False)
                continue
            v = m[0]
            if kind == "id":
                t = v if v in words else "@" if v[0] == "@" and language != "sql" else "a"
                if t == "@" and v == "@interface":
                    t = "@interface"
            elif kind == "num":
                t = "0"
            elif kind == "str":
                t = '"'
            elif kind == "tmpl":
                at = self.template(code, was, language)
                t = '"'
            else:
                t = v
                if v in ("/", "/=") and script and (not k or k[-1] in _REGEX_AFTER or k[-1] not in _VALUE_ENDS):
                    r = _REGEX.match(code, was)
                    if r:
                        t, at = '"', r.end()
            k.append(t), nl.append(new), adj.append(was == end)
            new, end = False, at
        if go and k and k[-1] in _GO_ENDS:
            k.append(";"), nl.append(False), adj.append(False)
        self.mate = {}
        stack = []
        for i, t in enumerate(k):
            if t in _OPEN:
                stack.append(i)
            elif t in (")", "]", "}"):
                if not stack or _OPEN[k[stack[-1]]] != t:
                    raise Bad(f"an unmatched {t}")
                self.mate[stack.pop()] = i
        if stack:
            raise Bad(f"a {k[stack[-1]]} that is never closed")
        k += ["", "", ""]
        nl += [True] * 3
        adj += [False] * 3
        self.off, self.text = None, None

    def template(self, code: str, at: int, language: str, keep: bool = True) -> int:
        """The end of the template literal that begins at ``at``; its expressions are kept to be parsed, with what is in them."""
        i, n = at + 1, len(code)
        while i < n:
            c = code[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif c == "$" and code[i + 1 : i + 2] == "{":
                depth, j = 1, i + 2
                while j < n and depth:
                    c = code[j]
                    if c == "`":
                        j = self.template(code, j, language, False)
                        continue
                    if c in "\"'":
                        q = j + 1
                        while q < n and code[q] != c:
                            q += 2 if code[q] == "\\" else 1
                        j = q
                    depth += (c == "{") - (c == "}")
                    j += 1
                if depth:
                    break
                if keep:
                    self.inner.append(code[i + 2 : j - 1])
                i = j
            else:
                i += 1
        raise Bad("a template that is never closed")

    def shape(self, a: int, b: int) -> str:
        """The kinds of tokens a to b with their line breaks, as one string."""
        if self.off is None:
            parts, off, at = [], [], 0
            for t, n in zip(self.k, self.nl, strict=True):
                s = ("\n" if n else " ") + t
                off.append(at)
                parts.append(s)
                at += len(s)
            self.off, self.text = off, "".join(parts)
        return self.text[self.off[a] : self.off[b + 1]]


_GO_ENDS = frozenset(["a", "0", '"', "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_VALUE_ENDS = frozenset(["a", "0", '"', ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "get", "set", "of", "async", "static", "as", "from", "type", "is"]) | (_TS_WORDS - _JS_WORDS)


class Parser:
    """Common part of the recognisers: a cursor over the kinds."""

    MEMORY = 100_000

    def __init__(self, tokens: Tokens, memory: dict):
        self.t, self.k, self.nl, self.i, self.memory = tokens, tokens.k, tokens.nl, 0, memory

    def at(self, *kinds: str) -> bool:
        return self.k[self.i] in kinds

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, *kinds: str) -> None:
        if self.k[self.i] not in kinds:
            raise Bad(f"{self.k[self.i] or 'the end'} where {' or '.join(kinds)} belongs")
        self.i += 1

    def name(self) -> None:
        if not self.is_name():
            raise Bad(f"{self.k[self.i] or 'the end'} where a name belongs")
        self.i += 1

    def is_name(self, ahead: int = 0) -> bool:
        return self.k[self.i + ahead] == "a" or self.k[self.i + ahead] in self.SOFT

    def tries(self, f, *args) -> bool:
        """Whether f succeeds; if not, the cursor stays."""
        i = self.i
        try:
            f(*args)
            return True
        except Bad:
            self.i = i
            return False

    def once(self, what: str, f) -> None:
        """f from the brace at the cursor to its partner; done once for each shape."""
        a = self.i
        b = self.t.mate[a]
        key = what + self.t.shape(a, b)
        known = self.memory.get(key)
        if known is None:
            try:
                f()
                known = self.i == b + 1
            except Bad:
                known = False
            if len(self.memory) < self.MEMORY:
                self.memory[key] = known
        if not known:
            raise Bad(f"what stands between braces is no {what}")
        self.i = b + 1

    def listed(self, close: str, item, sep: str = ",") -> None:
        """Items with separators up to ``close``, which is taken; a last separator may stand before it."""
        while not self.take(close):
            item()
            if not self.take(sep):
                self.need(close)
                return

    def angle(self, item) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            item()
            if self.take(">"):
                return
            self.need(",")
            if self.take(">"):
                return


# --- JavaScript and TypeScript --------------------------------------------------------------------------------

_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("=== !== == != <= < + - * / % & | ^ && || ?? ** << in instanceof".split())


class Script(Parser):
    SOFT = frozenset("let static async await of get set as from type namespace module declare abstract satisfies keyof infer is asserts readonly public private protected implements override unique accessor global interface yield".split())
    STRICT_JS = frozenset("interface type namespace module declare abstract satisfies keyof infer is asserts readonly unique accessor global".split())

    def __init__(self, tokens, memory, typed: bool):
        super().__init__(tokens, memory)
        self.typed = typed

    def program(self) -> None:
        while self.k[self.i]:
            self.statement()

    def end(self) -> None:
        if self.take(";") or self.at("}", "") or self.nl[self.i]:
            return
        raise Bad(f"{self.k[self.i]} where the statement should end")

    def block(self) -> None:
        if not self.at("{"):
            raise Bad("no block")
        self.once("block", self._block)

    def _block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def statement(self) -> None:
        k, nxt = self.k[self.i], self.k[self.i + 1]
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return None
        if k in ("var", "const") or k == "let" and (self.is_name(1) or nxt in ("[", "{")):
            if self.typed and k == "const" and nxt == "enum":
                self.i += 1
                return self.statement()
            self.variables()
            return self.end()
        if k == "function" or k == "async" and nxt == "function" and not self.nl[self.i + 1]:
            return self.function(True)
        if k in ("class", "@"):
            return self.klass()
        if k == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
            return None
        if k == "for":
            return self.loop()
        if k == "while":
            self.i += 1
            self.condition()
            return self.statement()
        if k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.take(";")
            return None
        if k == "switch":
            self.i += 1
            self.condition()
            if not self.at("{"):
                raise Bad("no cases")
            return self.once("cases", self.cases)
        if k == "try":
            self.i += 1
            self.block()
            handled = False
            if self.take("catch"):
                handled = True
                if self.take("("):
                    self.binding()
                    self.annotation()
                    self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif not handled:
                raise Bad("try alone")
            return None
        if k in ("return", "throw"):
            self.i += 1
            if k == "throw" and self.nl[self.i]:
                raise Bad("nothing to throw")
            if k == "throw" or not (self.at(";", "}", "") or self.nl[self.i]):
                self.expression()
            return self.end()
        if k in ("break", "continue"):
            self.i += 1
            if self.is_name() and not self.nl[self.i]:
                self.i += 1
            return self.end()
        if k == "debugger":
            self.i += 1
            return self.end()
        if k == "import" and nxt not in ("(", "."):
            return self.imports()
        if k == "export":
            return self.exports()
        if self.typed and self.declared():
            return None
        if self.is_name() and nxt == ":":
            self.i += 2
            return self.statement()
        self.expression()
        return self.end()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def cases(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()

    def variables(self, inside_for: bool = False) -> None:
        fixed = self.k[self.i] == "const"
        self.i += 1
        while True:
            plain = not self.at("[", "{")
            self.binding()
            if self.typed:
                self.take("!")
                self.annotation()
            if self.take("="):
                self.assignment(not inside_for)
            elif (fixed or not plain) and not inside_for:
                raise Bad("a declaration without value")
            if not self.take(","):
                return

    def loop(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if self.at("var", "let", "const") and self.k[self.i + 1] not in ("of", "in"):
            self.variables(True)
        elif not self.at(";"):
            self.expression(False)
        if self.take("of"):
            self.assignment()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.statement()

    def function(self, named: bool) -> None:
        self.take("async")
        self.need("function")
        self.take("*")
        if self.is_name():
            self.i += 1
        elif named:
            raise Bad("a function without name")
        self.signature()
        if self.typed and not self.at("{"):
            return self.end()
        return self.block()

    def signature(self) -> None:
        if self.typed and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.typed:
            while self.at("public", "private", "protected", "readonly", "override") and (self.is_name(1) or self.k[self.i + 1] in ("{", "[")):
                self.i += 1
            if self.take("this"):
                return self.annotation()
        self.take("...")
        self.binding()
        if self.typed:
            self.take("?")
            self.annotation()
        if self.take("="):
            self.assignment()
        return None

    def annotation(self) -> None:
        if self.typed and self.take(":"):
            self.type()

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            self.listed("}", self.binding_property)
        else:
            self.name()

    def binding_property(self) -> None:
        if self.take("..."):
            return self.binding()
        bare = self.is_name()
        self.property_name()
        if self.take(":"):
            self.binding()
        elif not bare:
            raise Bad("a pattern without name")
        if self.take("="):
            self.assignment()
        return None

    def property_name(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.at("a", '"', "0") or self.k[self.i][:1].isalpha():
            self.i += 1
        else:
            raise Bad(f"{self.k[self.i]} where a property's name belongs")

    def decorator(self) -> None:
        self.need("@")
        while self.take("."):
            self.property_name()
        if self.at("("):
            self.arguments()

    def klass(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.at("export"):
            return self.exports()
        self.take("abstract")
        self.need("class")
        if self.is_name() and not (self.at("implements") and self.is_name(1)):
            self.i += 1
        if self.typed and self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.typed and self.at("<"):
                self.angle(self.type)
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        if not self.at("{"):
            raise Bad("a class without body")
        return self.once("members", self.members)

    def members(self) -> None:
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.at("static") and self.k[self.i + 1] == "{":
            self.i += 1
            return self.block()
        while self.at("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor") and self.k[self.i + 1] not in ("(", "=", ";", ":", "}", "?", "!", "<", ",") and (self.typed or self.at("static", "async", "get", "set")):
            self.i += 1
        self.take("*")
        if self.typed and self.at("[") and self.is_name(1) and self.k[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            self.annotation()
            return self.end()
        self.property_name()
        if self.typed and not self.take("?"):
            self.take("!")
        if self.at("(", "<"):
            self.signature()
            if self.typed and not self.at("{"):
                return self.end()
            return self.block()
        self.annotation()
        if self.take("="):
            self.assignment()
        return self.end()

    def imports(self) -> None:
        self.i += 1
        if self.typed and self.at("type") and (self.k[self.i + 1] in ("{", "*") or self.is_name(1) and not (self.k[self.i + 1] == "from" and self.k[self.i + 2] == '"')):
            self.i += 1
        if not self.take('"'):
            if self.is_name():
                self.i += 1
                if self.typed and self.take("="):
                    self.expression()
                    return self.end()
                if not self.take(","):
                    self.need("from")
                    self.need('"')
                    self.attributes()
                    return self.end()
            if self.take("*"):
                self.need("as")
                self.name()
            else:
                self.need("{")
                self.listed("}", self.specifier)
            self.need("from")
            self.need('"')
        self.attributes()
        return self.end()

    def attributes(self) -> None:
        if self.take("with"):
            self.primary()

    def specifier(self) -> None:
        if self.typed and self.at("type") and self.k[self.i + 1] not in (",", "}", "as"):
            self.i += 1
        self.property_name()
        if self.take("as"):
            self.property_name()

    def exports(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.at("function") or self.at("async") and self.k[self.i + 1] == "function":
                return self.function(False)
            if self.at("class", "@") or self.typed and self.at("abstract"):
                return self.klass()
            if self.typed and self.at("interface"):
                return self.statement()
            self.assignment()
            return self.end()
        if self.typed and self.at("type") and self.k[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.property_name()
            self.need("from")
            self.need('"')
            self.attributes()
            return self.end()
        if self.take("{"):
            self.listed("}", self.specifier)
            if self.take("from"):
                self.need('"')
                self.attributes()
            return self.end()
        if self.typed and self.take("="):
            self.expression()
            return self.end()
        if self.typed and self.take("as"):
            self.need("namespace")
            self.name()
            return self.end()
        if self.at("var", "let", "const", "function", "class", "async", "@") or self.typed and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import"):
            return self.statement()
        raise Bad("nothing to export")

    def declared(self) -> bool:
        """A declaration that only TypeScript has."""
        k, nxt = self.k[self.i], self.k[self.i + 1]
        if k in ("declare", "abstract") and not self.nl[self.i + 1] and (nxt in ("class", "function", "const", "var", "let", "enum", "abstract", "namespace", "module", "interface", "type", "global")):
            self.i += 1
            if k == "declare" and self.at("const", "let", "var") and self.k[self.i + 1] != "enum":
                self.i += 1
                self.listed_names()
                self.end()
            elif self.take("global"):
                self.block()
            else:
                self.statement()
            return True
        if k == "interface" and self.is_name(1):
            self.i += 2
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.object_type()
            return True
        if k == "type" and self.is_name(1) and not self.nl[self.i + 1]:
            self.i += 2
            if self.at("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.end()
            return True
        if k == "enum":
            self.i += 1
            self.name()
            self.need("{")
            self.listed("}", self.enum_member)
            return True
        if k in ("namespace", "module") and (self.is_name(1) or nxt == '"') and not self.nl[self.i + 1]:
            self.i += 2
            while self.take("."):
                self.name()
            if self.at("{"):
                self.block()
            else:
                self.end()
            return True
        return False

    def listed_names(self) -> None:
        while True:
            self.binding()
            self.annotation()
            if not self.take(","):
                return

    def enum_member(self) -> None:
        self.property_name()
        if self.take("="):
            self.assignment()

    # types
    def type_parameters(self) -> None:
        self.angle(self.type_parameter)

    def type_parameter(self) -> None:
        self.take("const")
        self.take("in")
        self.name()
        if self.take("extends"):
            self.type()
        if self.take("="):
            self.type()

    def type(self) -> None:
        if self.take("asserts") and self.at("a", "this"):
            self.i += 1
            if self.take("is"):
                self.type()
            return
        if self.at("a", "this") and self.k[self.i + 1] == "is" and not self.nl[self.i + 1]:
            self.i += 2
        self.take("|")
        self.take("&")
        self.type_unit()
        while self.take("|") or self.take("&"):
            self.type_unit()
        if self.at("extends") and not self.nl[self.i]:
            i = self.i
            self.i += 1
            self.type_unit()
            if not self.take("?"):
                self.i = i
                return
            self.type()
            self.need(":")
            self.type()

    def type_unit(self) -> None:
        while self.at("keyof", "readonly", "unique", "infer") and (self.is_name(1) or self.k[self.i + 1] in ("(", "[", "{", "typeof", '"', "this")):
            self.i += 1
        if self.take("new"):
            self.function_type()
        elif self.at("<"):
            self.function_type()
        elif self.at("("):
            close = self.t.mate[self.i]
            if self.k[close + 1] == "=>":
                self.function_type()
            else:
                self.i += 1
                self.type()
                self.need(")")
        elif self.at("{"):
            self.object_type()
        elif self.take("["):
            self.listed("]", self.tuple_item)
        elif self.take("typeof"):
            self.property_name()
            while self.take("."):
                self.property_name()
        elif self.take("import"):
            self.arguments()
            while self.take("."):
                self.property_name()
        elif self.at('"', "0", "null", "true", "false", "this", "void", "super"):
            self.i += 1
        elif self.take("-"):
            self.need("0")
        else:
            self.name()
            while self.take("."):
                self.property_name()
            if self.at("<"):
                self.angle(self.type)
        while self.at("[") and not self.nl[self.i]:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def tuple_item(self) -> None:
        self.take("...")
        if self.is_name() and (self.k[self.i + 1] == ":" or self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":"):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def function_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.type()

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            while self.at("readonly", "get", "set", "+", "-") and self.k[self.i + 1] not in (":", "(", "?", ";", ",", "}"):
                self.i += 1
            if self.at("(", "<") or self.at("new") and self.k[self.i + 1] in ("(", "<"):
                self.take("new")
                self.signature()
            elif self.at("[") and self.is_name(1) and self.k[self.i + 2] in (":", "in"):
                self.i += 3
                self.type()
                if self.take("as"):
                    self.type()
                self.need("]")
                if self.at("+", "-"):
                    self.i += 1
                self.take("?")
                self.annotation()
            else:
                self.property_name()
                self.take("?")
                if self.at("(", "<"):
                    self.signature()
                else:
                    self.annotation()
            if not (self.take(";") or self.take(",") or self.at("}") or self.nl[self.i]):
                raise Bad("members of a type run together")

    # expressions
    def expression(self, with_in: bool = True) -> None:
        self.assignment(with_in)
        while self.take(","):
            self.assignment(with_in)

    def arrow_here(self) -> bool:
        i = self.i + (self.k[self.i] == "async" and self.k[self.i + 1] in ("(", "a", "<") and not self.nl[self.i + 1])
        if self.k[i] == "a" or self.k[i] in self.SOFT:
            return self.k[i + 1] == "=>"
        if self.typed and self.k[i] == "<":
            return self.tries_ahead(i)
        if self.k[i] != "(":
            return False
        after = self.k[self.t.mate[i] + 1]
        return after == "=>" or self.typed and after == ":" and self.tries_ahead(i)

    def tries_ahead(self, i: int) -> bool:
        was = self.i
        self.i = i
        try:
            self.signature()
            return self.at("=>")
        except Bad:
            return False
        finally:
            self.i = was

    def assignment(self, with_in: bool = True) -> None:
        if self.at("yield") and self.k[self.i + 1] not in ("=", ".", "=>"):
            self.i += 1
            if self.nl[self.i] or self.at(")", "]", "}", ",", ";", ":", ""):
                return
            self.take("*")
            return self.assignment(with_in)
        if self.arrow_here():
            if self.at("async") and self.k[self.i + 1] != "=>":
                self.i += 1
            if self.at("(", "<"):
                self.signature()
            else:
                self.name()
            self.need("=>")
            if self.at("{"):
                self.block()
            else:
                self.assignment(with_in)
            return None
        while True:
            self.unary()
            if self.take("?"):
                self.assignment()
                self.need(":")
                return self.assignment(with_in)
            if self.k[self.i] in _ASSIGN:
                self.i += 1
                return self.assignment(with_in)
            if not self.operator(with_in):
                return None

    def operator(self, with_in: bool) -> bool:
        k = self.k[self.i]
        if k == ">":
            n = 1
            while n < 4 and self.k[self.i + n] in (">", "=") and self.t.adj[self.i + n]:
                n += 1
            self.i += n
            return True
        if k in _BINARY and (k != "in" or with_in):
            self.i += 1
            return True
        if self.typed and k in ("as", "satisfies") and not self.nl[self.i]:
            self.i += 1
            if not self.take("const"):
                self.type()
            return self.operator(with_in)
        return False

    def unary(self) -> None:
        while self.at("!", "~", "+", "-", "++", "--", "typeof", "void", "delete") or self.at("await") and self.k[self.i + 1] not in ("=", ")", ";", ",", ".", "=>"):
            self.i += 1
        if self.typed and self.at("<") and not self.arrow_here():
            self.angle(self.type)
            return self.unary()
        self.primary()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.property_name()
            elif k == "?.":
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    self.property_name()
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif k == "(":
                self.arguments()
            elif k in ("++", "--") and not self.nl[self.i]:
                self.i += 1
            elif self.typed and k == "!" and not self.nl[self.i] and self.k[self.i + 1] not in ("a", "0", "("):
                self.i += 1
            elif k == '"' and self.k[self.i - 1] in _VALUE_ENDS and self.k[self.i - 1] not in ("0", '"') and self.t.adj[self.i]:
                self.i += 1  # a tagged template
            elif self.typed and k == "<" and self.tries(self.instantiated):
                pass
            else:
                return None

    def instantiated(self) -> None:
        self.angle(self.type)
        if not self.at("(", '"', ")", ";", ",", "]"):
            raise Bad("no type arguments")

    def arguments(self) -> None:
        self.need("(")
        self.listed(")", self.spread)

    def spread(self) -> None:
        self.take("...")
        self.assignment()

    def primary(self) -> None:
        k = self.k[self.i]
        if k in ("a", "0", '"', "this", "super", "null", "true", "false"):
            self.i += 1
        elif k == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.spread()
                if not self.at("]"):
                    self.need(",")
        elif k == "{":
            self.once("object", self.object)
        elif k == "function" or k == "async" and self.k[self.i + 1] == "function":
            self.function(False)
        elif k in ("class", "@"):
            self.klass()
        elif k == "new":
            self.i += 1
            if self.take("."):
                return self.property_name()
            self.unary()
        elif k == "import":
            self.i += 1
            if self.take("."):
                self.property_name()
            else:
                self.arguments()
        elif k in self.SOFT:
            self.i += 1
        else:
            raise Bad(f"{k or 'the end'} where a value belongs")
        return None

    def object(self) -> None:
        self.need("{")
        self.listed("}", self.entry)

    def entry(self) -> None:
        if self.take("..."):
            return self.assignment()
        while self.at("async", "get", "set") and self.k[self.i + 1] not in ("(", ":", ",", "}", "="):
            self.i += 1
        self.take("*")
        bare = self.is_name()
        self.property_name()
        if self.take(":"):
            return self.assignment()
        if self.at("(", "<"):
            self.signature()
            return self.block()
        if not bare:
            raise Bad("an entry without value")
        if self.take("="):
            self.assignment()
        return None


# --- Go -------------------------------------------------------------------------------------------------------

_GO_BINARY = frozenset("== != < <= > >= + - * / % & | ^ && || << >> &^ <-".split())
_GO_ASSIGN = frozenset(":= = += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Go(Parser):
    SOFT = frozenset()

    def __init__(self, tokens, memory):
        super().__init__(tokens, memory)
        self.header = False  # in the header of a statement a brace begins its block

    def program(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.take("import"):
            self.group(self.import_spec)
        while self.k[self.i]:
            self.declaration(True)

    def group(self, spec) -> None:
        if self.take("("):
            self.listed(")", spec, ";")
        else:
            spec()
        self.close()

    def close(self) -> None:
        if not self.take(";") and not self.at("}", ")", ""):
            raise Bad(f"{self.k[self.i]} where the statement should end")

    def import_spec(self) -> None:
        if self.at("a", "."):
            self.i += 1
        self.need('"')

    def declaration(self, top: bool) -> None:
        if self.take("var"):
            self.group(self.var_spec)
        elif self.take("const"):
            self.group(self.const_spec)
        elif self.take("type"):
            self.group(self.type_spec)
        elif top and self.at("func"):
            self.i += 1
            if self.at("("):
                self.parameters()
            self.name()
            if self.at("["):
                self.type_parameters()
            self.signature()
            if self.at("{"):
                self.block()
            self.close()
        else:
            raise Bad(f"{self.k[self.i] or 'the end'} where a declaration belongs")

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
            if not self.at("="):
                raise Bad("a constant without value")
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.k[self.i + 1] == "a" and self.k[self.i + 2] not in ("]",):
            self.tries(self.type_parameters)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        self.listed("]", self.type_parameter)

    def type_parameter(self) -> None:
        self.name()
        if not self.at(",", "]"):
            self.constraint()

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.at("a", "*", "[", "map", "chan", "<-", "func", "struct", "interface"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        self.take("...")
        self.type()
        if not self.at(",", ")"):
            self.take("...")
            self.type()

    def type(self) -> None:
        k = self.k[self.i]
        if k == "a":
            self.i += 1
            if self.take("."):
                self.name()
            if self.at("[") and self.k[self.i + 1] != "]":
                self.tries(self.type_arguments)
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.inside(self.expression)
                self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k in ("struct", "interface"):
            self.i += 1
            if not self.at("{"):
                raise Bad("no fields")
            self.once(k, self.fields if k == "struct" else self.methods)
        else:
            raise Bad(f"{k or 'the end'} where a type belongs")

    def type_arguments(self) -> None:
        self.need("[")
        self.listed("]", self.type)

    def fields(self) -> None:
        self.need("{")
        self.listed("}", self.field, ";")

    def field(self) -> None:
        if self.at("*"):
            self.type()
        elif self.at("a") and self.k[self.i + 1] in (";", ".", '"', "}"):
            self.type()
        else:
            self.names()
            self.type()
        self.take('"')

    def methods(self) -> None:
        self.need("{")
        self.listed("}", self.method, ";")

    def method(self) -> None:
        if self.at("a") and self.k[self.i + 1] == "(":
            self.i += 1
            self.signature()
        else:
            self.constraint()

    def inside(self, f) -> None:
        was, self.header = self.header, False
        f()
        self.header = was

    def block(self) -> None:
        if not self.at("{"):
            raise Bad("no block")
        was, self.header = self.header, False
        self.once("block", self._block)
        self.header = was

    def _block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not self.at("}", "case", "default", ""):
            self.statement()
            self.close()

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("var", "const", "type"):
            self.declaration(False)
            self.i -= self.k[self.i - 1] == ";"
        elif k == "{":
            self.block()
        elif k == "if":
            self.branch()
        elif k == "for":
            self.i += 1
            self.heading(self.for_header)
            self.block()
        elif k in ("switch", "select"):
            self.i += 1
            if not self.at("{"):
                self.heading(self.switch_header)
            if not self.at("{"):
                raise Bad("no cases")
            was, self.header = self.header, False
            self.once("cases", self.cases)
            self.header = was
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
        elif k == "return":
            self.i += 1
            if not self.at(";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            self.take("a")
        elif k == ";":
            pass
        elif k == "a" and self.k[self.i + 1] == ":":
            self.i += 2
            if not self.at("}"):
                self.statement()
        else:
            self.simple()

    def heading(self, f) -> None:
        was, self.header = self.header, True
        f()
        self.header = was

    def branch(self) -> None:
        self.need("if")
        self.heading(self.if_header)
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.branch()
            else:
                self.block()

    def if_header(self) -> None:
        if not self.at(";"):
            self.simple()
        if self.take(";"):
            self.expression()

    def switch_header(self) -> None:
        if not self.at(";"):
            self.simple()
        if self.take(";") and not self.at("{"):
            self.simple()

    def for_header(self) -> None:
        if self.at("{"):
            return
        if self.take("range"):
            return self.expression()
        if not self.at(";"):
            self.simple()
        if self.take(";"):
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at("{"):
                self.simple()
        return None

    def cases(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.case_items()
            else:
                self.need("default")
            self.need(":")
            self.statements()

    def case_items(self) -> None:
        self.simple_or_type()
        while self.take(","):
            self.simple_or_type()

    def simple_or_type(self) -> None:
        if not self.tries(self.simple_case):
            self.type()

    def simple_case(self) -> None:
        self.simple()
        if not self.at(":", ","):
            raise Bad("no case")

    def simple(self) -> None:
        self.expressions()
        k = self.k[self.i]
        if k in ("++", "--"):
            self.i += 1
        elif k in _GO_ASSIGN:
            self.i += 1
            if self.take("range"):
                return self.expression()
            self.expressions()
        return None

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.k[self.i] in _GO_BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.at("!", "-", "+", "^", "*", "&", "<-"):
            self.i += 1
        k, composite = self.k[self.i], False
        if k in ("0", '"'):
            self.i += 1
        elif k == "a":
            self.i += 1
            composite = True
        elif k == "(":
            self.i += 1
            self.inside(self.expression_or_type)
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif k in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.at("{"):
                self.literal()
            elif not self.at("(", ",", ")"):
                raise Bad("a type where a value belongs")
        else:
            raise Bad(f"{k or 'the end'} where a value belongs")
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    composite = False
                else:
                    self.name()
            elif k == "[":
                self.i += 1
                self.inside(self.index)
                self.need("]")
            elif k == "(":
                self.i += 1
                self.inside(lambda: self.listed(")", self.argument))
                composite = False
            elif k == "{" and composite and not self.header:
                self.literal()
                composite = False
            else:
                return

    def expression_or_type(self) -> None:
        i = self.i
        if self.tries(self.expression) and self.at(")"):
            return
        self.i = i
        self.type()

    def index(self) -> None:
        if not self.at(":"):
            self.argument()
            while self.take(","):
                self.argument()
        for _ in range(2):
            if self.take(":") and not self.at("]", ":"):
                self.expression()

    def argument(self) -> None:
        i = self.i
        if not (self.tries(self.expression) and self.at(",", ")", "...", "]", ":")):
            self.i = i
            self.type()
        self.take("...")

    def literal(self) -> None:
        was, self.header = self.header, False
        self.once("literal", self._literal)
        self.header = was

    def _literal(self) -> None:
        self.need("{")
        self.listed("}", self.element)

    def element(self) -> None:
        self.value()
        if self.take(":"):
            self.value()

    def value(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()


# --- Java -----------------------------------------------------------------------------------------------------

_JAVA_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_JAVA_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_JAVA_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
_JAVA_BINARY = frozenset("== != < <= + - * / % & | ^ && || <<".split())


class Java(Parser):
    SOFT = frozenset(["var", "record", "yield", "sealed", "permits", "non", "when"])

    def program(self) -> None:
        if self.at("package") or self.at("@"):
            i = self.i
            self.annotations()
            if self.take("package"):
                self.qualified()
                self.need(";")
            else:
                self.i = i
        while True:
            if self.take("import"):
                self.take("static")
                self.name()
                while self.take("."):
                    if self.take("*"):
                        break
                    self.name()
                self.need(";")
            elif not self.take(";"):
                break
        while self.k[self.i]:
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def annotations(self) -> None:
        while self.at("@"):
            self.i += 1
            while self.take("."):
                self.name()
            if self.at("("):
                self.need("(")
                self.listed(")", self.annotation_value)

    def annotation_value(self) -> None:
        if self.is_name() and self.k[self.i + 1] == "=":
            self.i += 2
        if self.at("@"):
            self.annotations()
        elif self.at("{"):
            self.need("{")
            self.listed("}", self.annotation_value)
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.at("@"):
                self.annotations()
            elif self.k[self.i] in _JAVA_MODIFIERS and not (self.at("default") and self.k[self.i + 1] in (":", "->")):
                if self.at("sealed") and not (self.k[self.i + 1] in _JAVA_MODIFIERS or self.k[self.i + 1] in ("class", "interface")):
                    return
                if self.at("static", "synchronized") and self.k[self.i + 1] in ("{", "("):
                    return
                self.i += 1
            elif self.at("non") and self.k[self.i + 1] == "-" and self.k[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def is_type_declaration(self) -> bool:
        return self.at("class", "interface", "enum", "@interface") or self.at("record") and self.is_name(1) and self.k[self.i + 2] in ("(", "<")

    def type_declaration(self) -> None:
        if not self.is_type_declaration():
            raise Bad(f"{self.k[self.i] or 'the end'} where a type's declaration belongs")
        k = self.k[self.i]
        self.i += 1
        self.name()
        if self.at("<"):
            self.type_parameters()
        if k == "record":
            self.parameters()
        while self.at("extends", "implements", "permits"):
            self.i += 1
            self.type()
            while self.take(","):
                self.type()
        if not self.at("{"):
            raise Bad("a type without body")
        self.once("enum" if k == "enum" else "members", self.enum_body if k == "enum" else self.members)

    def type_parameters(self) -> None:
        self.angle(self.type_parameter)

    def type_parameter(self) -> None:
        self.annotations()
        self.name()
        if self.take("extends"):
            self.type()
            while self.take("&"):
                self.type()

    def members(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.member()

    def enum_body(self) -> None:
        self.need("{")
        while not self.at(";", "}"):
            self.annotations()
            self.name()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.once("members", self.members)
            if not self.take(","):
                break
        if self.take(";"):
            while not self.at("}"):
                self.member()
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return None
        if self.at("{") or self.at("static") and self.k[self.i + 1] == "{":
            self.take("static")
            return self.block()
        self.modifiers()
        if self.is_type_declaration():
            return self.type_declaration()
        if self.at("<"):
            self.type_parameters()
            self.annotations()
        if self.is_name() and self.k[self.i + 1] in ("(", "{"):  # a constructor
            self.i += 1
            if self.at("("):
                self.parameters()
            self.throws()
            return self.block()
        if not self.take("void"):
            self.type()
        self.name()
        if self.at("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.annotation_value()
            if self.take(";"):
                return None
            return self.block()
        self.declarators()
        return self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()

    def dims(self) -> None:
        while self.at("[") and self.k[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initial()
            if not self.take(","):
                return
            self.name()

    def initial(self) -> None:
        if self.at("{"):
            self.need("{")
            self.listed("}", self.initial)
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            self.take("...")
            if not self.take("this"):
                self.name()
            self.dims()
            if self.take(")"):
                return
            self.need(",")

    def type(self) -> None:
        self.annotations()
        if self.k[self.i] in _JAVA_PRIMITIVE:
            self.i += 1
        elif self.take("?"):
            if self.take("extends") or self.take("super"):
                self.type()
            return
        else:
            self.name()
            if self.at("<"):
                self.angle(self.type)
            while self.at(".") and (self.is_name(1) or self.k[self.i + 1] == "@"):
                self.i += 1
                self.annotations()
                self.name()
                if self.at("<"):
                    self.angle(self.type)
        self.dims()

    def block(self) -> None:
        if not self.at("{"):
            raise Bad("no block")
        self.once("block", self._block)

    def _block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        k, nxt = self.k[self.i], self.k[self.i + 1]
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return None
        if k == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
            return None
        if k == "while":
            self.i += 1
            self.condition()
            return self.statement()
        if k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            return self.need(";")
        if k == "for":
            self.i += 1
            self.need("(")
            if not self.take(";"):
                if self.local():
                    if self.take(":"):
                        self.expression()
                        self.need(")")
                        return self.statement()
                    self.declarators()
                else:
                    self.expressions()
                self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expressions()
            self.need(")")
            return self.statement()
        if k == "switch":
            self.unary()
            if self.at(";", "."):
                return self.rest()
            return None
        if k == "try":
            self.i += 1
            alone = True
            if self.take("("):
                alone = False
                self.listed(")", self.resource, ";")
            self.block()
            while self.take("catch"):
                alone = False
                self.need("(")
                self.modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.name()
                self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif alone:
                raise Bad("try alone")
            return None
        if k == "synchronized" and nxt == "(":
            self.i += 1
            self.condition()
            return self.block()
        if k in ("return", "throw") or k == "yield" and nxt not in ("=", ".", "(", "++", "--", "["):
            self.i += 1
            if k != "return" or not self.at(";"):
                self.expression()
            return self.need(";")
        if k in ("break", "continue"):
            self.i += 1
            if self.is_name():
                self.i += 1
            return self.need(";")
        if k == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            return self.need(";")
        if self.is_name() and nxt == ":":
            self.i += 2
            return self.statement()
        i = self.i
        self.modifiers()
        if self.is_type_declaration():
            return self.type_declaration()
        self.i = i
        if self.local():
            self.declarators()
            return self.need(";")
        return self.rest()

    def rest(self) -> None:
        if not self.at(";"):
            a = self.i
            self.expression()
            if self.k[self.i - 1] not in (")", "++", "--", "a", "0", '"', "}", "]", "null", "true", "false", "this") or self.i - a == 1:
                raise Bad("an expression alone")
        self.need(";")

    def resource(self) -> None:
        if self.local():
            self.need("=")
        self.expression()

    def local(self) -> bool:
        """A local variable's modifiers, type and first name."""
        return self.tries(self._local)

    def _local(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if not self.at("=", ";", ",", ":", "["):
            raise Bad("no declaration")

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def lambda_here(self) -> bool:
        if self.is_name():
            return self.k[self.i + 1] == "->"
        return self.at("(") and self.k[self.t.mate[self.i] + 1] == "->"

    def expression(self) -> None:
        if self.lambda_here():
            if self.is_name():
                self.i += 1
            elif not self.tries(self.parameters):
                self.need("(")
                self.listed(")", self.name)
            self.need("->")
            if self.at("{"):
                self.block()
            else:
                self.expression()
            return
        self.ternary()
        if self.k[self.i] in _JAVA_ASSIGN:
            self.i += 1
            self.expression()
        elif self.at(">") and self.shift_assign():
            self.expression()

    def shift_assign(self) -> bool:
        n = 1
        while self.k[self.i + n] == ">" and self.t.adj[self.i + n]:
            n += 1
        if n > 1 and self.k[self.i + n] == "=" and self.t.adj[self.i + n]:
            self.i += n + 1
            return True
        return False

    def ternary(self) -> None:
        while True:
            self.unary()
            k = self.k[self.i]
            if k == "instanceof":
                self.i += 1
                self.take("final")
                self.pattern()
                k = self.k[self.i]
            if k in _JAVA_BINARY:
                self.i += 1
            elif k == ">":
                n = 1
                while n < 3 and self.k[self.i + n] == ">" and self.t.adj[self.i + n]:
                    n += 1
                if self.k[self.i + n] == "=" and self.t.adj[self.i + n]:
                    if n > 1:
                        return
                    n += 1
                self.i += n
            elif k == "?":
                self.i += 1
                self.expression()
                self.need(":")
                if self.lambda_here():
                    return self.expression()
            else:
                return None

    def pattern(self) -> None:
        self.type()
        if self.at("("):
            self.need("(")
            self.listed(")", self.pattern)
        if self.is_name() and not (self.at("when") and not self.k[self.i + 1] in (")", "&&", "->", ":", ",")):
            self.i += 1

    def cast(self) -> None:
        self.need("(")
        primitive = self.k[self.i] in _JAVA_PRIMITIVE
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        if not (self.is_name() or self.at("0", '"', "(", "!", "~", "this", "new", "super", "switch", "null", "true", "false") or self.k[self.i] in _JAVA_PRIMITIVE or primitive and self.at("+", "-", "++", "--")):
            raise Bad("no cast")
        if self.lambda_here():
            self.expression()
        else:
            self.unary()

    def unary(self) -> None:
        while self.at("!", "~", "+", "-", "++", "--"):
            self.i += 1
        k = self.k[self.i]
        if k == "(":
            if self.tries(self.cast):
                return
            self.i += 1
            self.expression()
            self.need(")")
        elif k == "new":
            self.i += 1
            self.created()
        elif k == "switch":
            self.i += 1
            self.condition()
            if not self.at("{"):
                raise Bad("no cases")
            self.once("cases", self.cases)
        elif k in _JAVA_PRIMITIVE or k == "void":
            self.i += 1
            self.dims()
            if not self.at("::", "."):
                raise Bad("a type where a value belongs")
        elif k in ("0", '"', "this", "super", "null", "true", "false"):
            self.i += 1
        else:
            self.name()
            if self.at("<"):
                self.tries(self.reference)
            if self.at("[") and self.k[self.i + 1] == "]":
                self.dims()
                if not self.at("::", "."):
                    raise Bad("a type where a value belongs")
        while True:
            if self.take("."):
                if self.at("<"):
                    self.angle(self.type)
                if self.take("new"):
                    self.created()
                elif not (self.take("class") or self.take("this") or self.take("super")):
                    self.name()
            elif self.take("["):
                self.expression()
                self.need("]")
            elif self.at("("):
                if self.k[self.i - 1] in ("0", '"', "null", "true", "false", ")", "]", "}"):
                    raise Bad("a call of no name")
                self.arguments()
            elif self.at("++", "--"):
                self.i += 1
            elif self.take("::"):
                if self.at("<"):
                    self.angle(self.type)
                if not self.take("new"):
                    self.name()
            else:
                return

    def reference(self) -> None:
        self.angle(self.type)
        self.dims()
        if not self.at("::"):
            raise Bad("no reference")

    def created(self) -> None:
        self.annotations()
        if self.k[self.i] in _JAVA_PRIMITIVE:
            self.i += 1
        else:
            self.name()
            if self.at("<"):
                self.angle(self.type)
            while self.take("."):
                self.name()
                if self.at("<"):
                    self.angle(self.type)
        if self.at("["):
            while self.take("["):
                if not self.take("]"):
                    self.expression()
                    self.need("]")
            if self.at("{"):
                self.initial()
            return
        self.arguments()
        if self.at("{"):
            self.once("members", self.members)

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        self.expressions()
        self.need(")")

    def cases(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    if self.take("default"):
                        pass
                    elif not self.tries(self.case_pattern):
                        self.ternary()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.statement()

    def case_pattern(self) -> None:
        self.pattern()
        if self.k[self.i - 1] not in ("a", ")") or not self.at("->", ":", ",", "when"):
            raise Bad("no pattern")


# --- SQL ------------------------------------------------------------------------------------------------------

_SQL_STARTS = frozenset(
    "select with insert update delete merge create drop alter truncate grant revoke begin commit rollback start set use explain analyze vacuum call values show describe comment declare savepoint release lock copy replace pragma end do execute if return refresh rename".split()
)
_SQL_STOP = frozenset("from where group having order limit offset union intersect except window fetch join inner left right full cross natural on using qualify returning set values when then else end as and or for into lateral tablesample select with".split())
_SQL_BINARY = frozenset("+ - * / % = <> != < > <= >= || & | ^ -> ->> ~ and or".split())


class Sql(Parser):
    """Generic SQL. Names and words are one kind to the lexer; here the words themselves are looked at."""

    SOFT = frozenset()

    def __init__(self, tokens: Tokens, memory: dict, words: list[str]):
        super().__init__(tokens, memory)
        self.k = [w or k for k, w in zip(self.k, words, strict=True)]

    def word(self, *words: str) -> bool:
        if self.k[self.i] in words:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        k = self.k[self.i]
        if k == "a" or k[:1].isalpha() and k not in _SQL_STOP:
            self.i += 1
        else:
            raise Bad(f"{k or 'the end'} where a name belongs")

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            if not self.take("*"):
                self.name()

    def program(self) -> None:
        while self.k[self.i]:
            if self.take(";"):
                continue
            self.statement()
            if self.k[self.i] and not self.take(";"):
                raise Bad(f"{self.k[self.i]} where the statement should end")

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("select", "with", "values", "("):
            return self.query()
        if k not in _SQL_STARTS:
            raise Bad(f"{k} begins no statement")
        if k == "explain":
            self.i += 1
            self.word("analyze", "verbose", "extended")
            return self.statement()
        if k in ("insert", "replace"):
            return self.insert()
        if k == "update":
            self.i += 1
            self.qualified()
            self.alias()
            self.need("set")
            self.assignments()
            if self.word("from"):
                self.sources()
            return self.tail()
        if k == "delete":
            self.i += 1
            self.need("from")
            self.qualified()
            self.alias()
            if self.word("using"):
                self.sources()
            return self.tail()
        if k == "create":
            return self.create()
        if k == "drop":
            self.i += 1
            self.name()
            if self.word("if"):
                self.need("exists")
            self.qualified()
            while self.take(","):
                self.qualified()
            self.word("cascade", "restrict")
            if self.word("on"):
                self.qualified()
            return None
        # Other statements: a name at least, brackets in balance, and no other statement run into.
        alone = k in ("begin", "commit", "rollback", "end", "analyze", "vacuum", "return", "show", "start")
        self.i += 1
        if not alone and self.at(";", ""):
            raise Bad(f"{k} alone")
        n = 0
        while not self.at(";", ""):
            if self.at("(", "["):
                self.i = self.t.mate[self.i]
            elif n > 3 and self.k[self.i] == self.k[self.i - 1] == "a":
                raise Bad("prose")
            self.i += 1
            n += 1
        if self.k[self.i - 1] in (",", "=", "+", "-", "add", "column", "table", "to", "set", "on", "alter", "."):
            raise Bad("an unfinished statement")
        return None

    def create(self) -> None:
        self.i += 1
        while self.word("or", "replace", "temporary", "temp", "unique", "global", "local", "external", "unlogged", "materialized", "recursive", "clustered", "nonclustered"):
            pass
        k = self.k[self.i]
        self.name()
        if self.word("if"):
            self.need("not")
            self.need("exists")
        if k == "table":
            self.qualified()
            if self.at("("):
                if self.k[self.i + 1] in ("select", "with"):
                    return self.query()
                self.i += 1
                self.columns()
            while not self.at(";", "", "as"):
                if self.at("(", "["):
                    self.i = self.t.mate[self.i]
                elif self.at("select", "create", "insert"):
                    raise Bad("statements run together")
                self.i += 1
            if self.word("as"):
                self.query()
            elif self.k[self.i - 1] in (",", "="):
                raise Bad("an unfinished table")
            return None
        if k == "view":
            self.qualified()
            if self.at("("):
                self.i = self.t.mate[self.i] + 1
            self.need("as")
            return self.query()
        if k == "index":
            if not self.at("on"):
                self.qualified()
            self.need("on")
            self.qualified()
            if self.word("using"):
                self.name()
            self.need("(")
            self.order_items()
            self.need(")")
            if self.word("include"):
                self.i = self.t.mate[self.i] + 1
            return self.tail()
        # Functions, triggers, schemas and the like.
        self.qualified()
        while not self.at(";", ""):
            if self.at("(", "["):
                self.i = self.t.mate[self.i]
            self.i += 1
        return None

    def columns(self) -> None:
        """Column and constraint definitions; the bracket is closed here."""
        while True:
            if self.at(")", ","):
                raise Bad("an empty definition")
            if self.word("constraint"):
                self.name()
            if self.at("primary", "unique", "foreign", "check", "key", "index", "exclude"):
                pass
            else:
                self.name()
                if self.at("a") or self.k[self.i][:1].isalpha() and not self.at("primary", "not"):
                    self.i += 1
                elif not self.at(",", ")"):
                    raise Bad("a column without type")
            while not self.at(",", ")", ""):
                if self.at("(", "["):
                    self.i = self.t.mate[self.i]
                elif self.at("default", "check") and self.k[self.i + 1] in (",", ")", ""):
                    raise Bad("no value")
                elif self.at("=", ";", "select", "create"):
                    raise Bad("no definition")
                self.i += 1
            if self.take(")"):
                return
            self.need(",")

    def insert(self) -> None:
        self.i += 1
        if self.word("or"):
            self.name()
        if not (self.word("into") or self.word("overwrite")):
            raise Bad("into what")
        self.word("table")
        self.qualified()
        if self.at("(") and self.k[self.i + 1] not in ("select", "with"):
            self.i += 1
            self.listed(")", self.qualified)
            if self.k[self.i - 2] == ",":
                raise Bad("a comma too many")
        if self.word("default"):
            self.need("values")
        elif self.at("values"):
            self.i += 1
            self.rows()
        else:
            self.query()
        if self.word("on"):
            while not self.at(";", "", "returning"):
                self.i = self.t.mate[self.i] + 1 if self.at("(") else self.i + 1
        if self.word("returning"):
            self.select_items()

    def rows(self) -> None:
        while True:
            self.need("(")
            self.expressions()
            self.need(")")
            if not self.take(","):
                return

    def assignments(self) -> None:
        while True:
            if self.at("("):
                self.i = self.t.mate[self.i] + 1
            else:
                self.qualified()
            self.need("=")
            self.expression()
            if not self.take(","):
                return

    def tail(self) -> None:
        if self.word("where"):
            self.expression()
        if self.word("order"):
            self.need("by")
            self.order_items()
        if self.word("limit"):
            self.expression()
        if self.word("returning"):
            self.select_items()

    def query(self) -> None:
        if self.word("with"):
            self.word("recursive")
            while True:
                self.name()
                if self.at("("):
                    self.i = self.t.mate[self.i] + 1
                self.need("as")
                self.word("not")
                self.word("materialized")
                self.need("(")
                self.statement()
                self.need(")")
                if not self.take(","):
                    break
            if self.at("insert", "update", "delete"):
                return self.statement()
        self.term()
        while self.word("union", "intersect", "except", "minus"):
            self.word("all", "distinct")
            self.term()
        if self.word("order"):
            self.need("by")
            self.order_items()
        while self.at("limit", "offset", "fetch", "for"):
            k = self.k[self.i]
            self.i += 1
            if k in ("limit", "offset"):
                if not self.word("all"):
                    self.expression()
                if self.take(","):
                    self.expression()
                self.word("rows", "row")
            else:
                while not self.at(";", "", ")"):
                    self.i += 1
        return None

    def term(self) -> None:
        if self.take("("):
            self.query()
            return self.need(")")
        if self.word("values"):
            return self.rows()
        self.need("select")
        if self.word("distinct"):
            if self.word("on"):
                self.need("(")
                self.expressions()
                self.need(")")
        else:
            self.word("all")
        if self.word("top"):
            self.need("0")
        self.select_items()
        if self.word("into"):
            self.qualified()
        if self.word("from"):
            self.sources()
        if self.word("where"):
            self.expression()
        if self.word("group"):
            self.need("by")
            if not self.word("all"):
                self.expressions()
        if self.word("having"):
            self.expression()
        if self.word("qualify"):
            self.expression()
        if self.word("window"):
            while True:
                self.name()
                self.need("as")
                if not self.at("("):
                    raise Bad("no window")
                self.i = self.t.mate[self.i] + 1
                if not self.take(","):
                    break
        return None

    def select_items(self) -> None:
        while True:
            if not self.take("*"):
                self.expression()
                self.alias()
            if not self.take(","):
                return

    def alias(self) -> None:
        if self.word("as"):
            if not self.take('"'):
                self.name()
        elif self.at("a"):
            self.i += 1

    def sources(self) -> None:
        self.source()
        while True:
            if self.take(","):
                self.word("lateral")
                self.source()
            elif self.at("join", "inner", "left", "right", "full", "cross", "natural"):
                plain = True
                while not self.word("join"):
                    if not self.word("inner", "left", "right", "full", "cross", "natural", "outer", "semi", "anti", "asof"):
                        raise Bad("no join")
                    plain = plain and self.k[self.i - 1] not in ("cross", "natural")
                self.word("lateral")
                self.source()
                if self.word("on"):
                    self.expression()
                elif self.word("using"):
                    self.need("(")
                    self.listed(")", self.name)
            else:
                return

    def source(self) -> None:
        if self.at("("):
            self.i += 1
            if self.at("select", "with", "values", "("):
                self.query()
            else:
                self.sources()
            self.need(")")
        else:
            self.qualified()
            if self.at("("):
                self.arguments()
        self.alias()
        if self.at("(") and self.k[self.i - 1] == "a":
            self.i = self.t.mate[self.i] + 1

    def order_items(self) -> None:
        while True:
            self.expression()
            self.word("asc", "desc")
            if self.word("nulls") and not self.word("first", "last"):
                raise Bad("nulls where")
            if not self.take(","):
                return

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        while True:
            self.unary()
            if self.k[self.i] in _SQL_BINARY:
                self.i += 1
                if self.word("any", "all", "some"):
                    pass
                continue
            if self.word("is"):
                self.word("not")
                if self.word("distinct"):
                    self.need("from")
                    continue
                if not self.word("null", "true", "false", "unknown"):
                    raise Bad("is what")
                if self.k[self.i] in _SQL_BINARY:
                    self.i += 1
                    continue
                return
            i = self.i
            self.word("not")
            if self.word("in"):
                self.need("(")
                if self.at("select", "with"):
                    self.query()
                else:
                    self.expressions()
                self.need(")")
                if self.k[self.i] in _SQL_BINARY:
                    self.i += 1
                    continue
                return
            if self.word("between"):
                self.unary()
                while self.at("+", "-", "*", "/", "||"):
                    self.i += 1
                    self.unary()
                self.need("and")
                continue
            if self.word("like", "ilike", "rlike", "regexp", "similar", "glob"):
                self.word("to")
                continue
            if self.word("collate", "escape"):
                continue
            self.i = i
            return

    def unary(self) -> None:
        while self.at("-", "+", "~", "not"):
            self.i += 1
        k = self.k[self.i]
        if k == "(":
            self.i += 1
            if self.at("select", "with", "values"):
                self.query()
            else:
                self.expressions()
            self.need(")")
        elif k in ("0", '"', "?", "null", "true", "false"):
            self.i += 1
        elif k == "*":
            self.i += 1
        elif k == "case":
            self.i += 1
            if not self.at("when"):
                self.expression()
            if not self.at("when"):
                raise Bad("case without when")
            while self.word("when"):
                self.expression()
                self.need("then")
                self.expression()
            if self.word("else"):
                self.expression()
            self.need("end")
        elif k == "exists":
            self.i += 1
            self.need("(")
            self.query()
            self.need(")")
        elif k in ("cast", "try_cast") and self.k[self.i + 1] == "(":
            self.i += 2
            self.expression()
            self.need("as")
            while not self.at(")"):
                self.i = self.t.mate[self.i] + 1 if self.at("(") else self.i + 1
            self.need(")")
        elif k == "interval":
            self.i += 1
            self.unary()
            if self.at("a") or self.at("day", "month", "year", "hour", "minute", "second"):
                self.i += 1
        elif k in ("left", "right", "values", "replace", "set", "if") and self.k[self.i + 1] == "(":
            self.i += 1
            self.arguments()
        else:
            self.qualified()
            if self.at("("):
                self.arguments()
            elif self.at('"') and self.k[self.i - 1] in ("date", "timestamp", "time"):
                self.i += 1
        while True:
            if self.word("over"):
                if self.at("("):
                    self.i = self.t.mate[self.i] + 1
                else:
                    self.name()
            elif self.word("filter", "within"):
                self.word("group")
                if not self.at("("):
                    raise Bad("no filter")
                self.i = self.t.mate[self.i] + 1
            elif self.take("::"):
                self.qualified()
                if self.at("("):
                    self.i = self.t.mate[self.i] + 1
            elif self.at("["):
                self.i = self.t.mate[self.i] + 1
            elif self.at("at") and self.k[self.i + 1] == "time":
                self.i += 2
                self.name()
                self.unary()
            else:
                return

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        self.word("distinct", "all")
        if self.at("select", "with"):
            self.query()
        else:
            self.expressions()
        while not self.at(")"):  # from, for, order by, separators
            if not self.word("from", "for", "in", "using", "order", "separator", "respect", "ignore", "nulls", "as"):
                raise Bad(f"{self.k[self.i]} among the arguments")
            self.word("by")
            if not self.at(")"):
                self.order_items()
        self.need(")")


# --- the checks -----------------------------------------------------------------------------------------------


def _python(code: str, memory: dict) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(code, "f", "exec", 0x400, dont_inherit=True)  # ast.PyCF_ONLY_AST
        except (SyntaxError, ValueError) as e:
            raise Bad(str(e)) from None
        except (RecursionError, MemoryError):
            raise Undecided("too deep") from None


def _no_constant(name: str):
    raise Bad(f"{name} is no JSON")


def _json(code: str, memory: dict) -> None:
    try:
        json.loads(code, parse_constant=_no_constant)
    except ValueError as e:
        raise Bad(str(e)) from None


def _yaml(code: str, memory: dict) -> None:
    if yaml is None:
        raise Undecided("no parser of YAML")
    if code.count("[") + code.count("{") > 10_000 and max(accumulate((c in "[{") - (c in "]}") for c in code if c in "[]{}")) > 10_000:
        raise Undecided("too deep")  # the parser's time grows with the square of the depth
    try:
        for _ in yaml.parse(code, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            pass
    except yaml.YAMLError as e:
        raise Bad(str(e)) from None


def one_scalar(code: str) -> bool:
    """Whether a text that is YAML is so only as one plain scalar, as nearly any words are."""
    events = yaml.parse(code, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    return all(isinstance(e, (yaml.StreamStartEvent, yaml.DocumentStartEvent, yaml.DocumentEndEvent, yaml.StreamEndEvent)) or isinstance(e, yaml.ScalarEvent) and not e.style for e in events)


#: What a file begins with, comments aside.
_BEGIN = re.compile(rf"(?:\s|{_C_COMMENT})*+(@|[^\W\d]\w*|.)?", re.S)
_JAVA_BEGIN = frozenset("package import class interface enum record public private protected static abstract final strictfp sealed non open module @ ;".split()) | {None}
_GO_BEGIN = re.compile(rf"(?:\s|{_C_COMMENT})*+package\b(?:[ \t]|/\*(?:[^*]|\*(?!/))*\*/)*[^\W\d]\w*[ \t\r]*(?:[;\n]|/[/*]|\Z)")
_SQL_BEGIN = re.compile(r"(?:\s|;|--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*+([^\W\d]\w*|.)?", re.S)


def script_tokens(code: str, typed: bool, memory: dict) -> Tokens:
    """The tokens of a script. Its two languages differ in their words only, so a text is read once for both."""
    known = memory.get("script")
    if known is None or known[0] != code:
        try:
            known = (code, Tokens(code, "typescript"))
        except Bad as e:
            known = (code, e)
        memory["script"] = known
    t = known[1]
    if isinstance(t, Bad):
        raise t
    if typed:
        return t
    plain = copy.copy(t)
    plain.k, plain.off, plain.text = ["a" if k in _TS_ONLY else k for k in t.k], None, None
    return plain


_TS_ONLY = _TS_WORDS - _WORDS["javascript"]


def _script(typed: bool):
    name = "typescript" if typed else "javascript"

    def check(code: str, memory: dict) -> None:
        if _BEGIN.match(code)[1] == "package":
            raise Bad("package is a reserved word")
        t = script_tokens(code, typed, memory)
        Script(t, memory.setdefault(name, {}), typed).program()
        for part in t.inner:
            check("(" + part + ")", memory)

    return check


def _go(code: str, memory: dict) -> None:
    if not _GO_BEGIN.match(code):
        raise Bad("no package clause")
    Go(Tokens(code, "go"), memory.setdefault("go", {})).program()


def _java(code: str, memory: dict) -> None:
    if _BEGIN.match(code)[1] not in _JAVA_BEGIN:
        raise Bad("no declaration at the beginning")
    Java(Tokens(code, "java"), memory.setdefault("java", {})).program()


def _sql(code: str, memory: dict) -> None:
    first = _SQL_BEGIN.match(code)[1]
    if first is not None and first != "(" and first.lower() not in _SQL_STARTS:
        raise Bad(f"{first} begins no statement")
    t, words = Tokens(code, "sql"), []
    lex = _LEX["sql"]
    for m in lex.finditer(code):
        if m.lastgroup not in ("ws", "com"):
            v = m[0].lower()
            words.append("?" if m.lastgroup == "par" else (v if v in _SQL_WORDS else "a") if m.lastgroup == "id" else "")
    Sql(t, memory, words + [""] * 3).program()


_SQL_WORDS = _SQL_STARTS | _SQL_STOP | _SQL_BINARY | frozenset(
    "by not null true false is in between like ilike rlike regexp similar glob to collate escape case exists cast try_cast interval distinct all any some asc desc nulls first last over filter within at time recursive materialized table view index if replace temporary temp unique primary foreign check key constraint default overwrite minus top rows row outer semi anti asof unknown separator respect ignore date timestamp cascade restrict column add include or day month year hour minute second verbose extended exclude global local external unlogged clustered nonclustered".split()
)

CHECKS = {"python": _python, "javascript": _script(False), "typescript": _script(True), "go": _go, "java": _java, "json": _json, "yaml": _yaml, "sql": _sql}

#: Tokens that speak for a language, for the order in which the grammars are tried.
_SIGNS = {
    "python": "def class from import elif with self None True False not pass except ): @ #",
    "javascript": "const let function export require => ; === null undefined }); );",
    "typescript": "interface readonly type private string number boolean const let export => ; ?: }); );",
    "go": "package func := nil range chan defer struct err * }",
    "java": "package public private static final void @ import new String int ; ); {",
    "json": '": ", "},{" }, ], ": { ": [',
    "yaml": ": - # name version",
    "sql": "select insert into create table where values group by SELECT INSERT INTO CREATE TABLE WHERE VALUES GROUP BY FROM NOT NULL --",
}
_SPEAKS: dict[str, list[str]] = {}
for _language, _tokens in _SIGNS.items():
    for _token in _tokens.split():
        _SPEAKS.setdefault(_token, []).append(_language)
_SIGN = re.compile(r"[A-Za-z_]+|[^\w\s]+")


def ranked(code: str) -> list[str]:
    """The languages in the order of what the file's tokens speak for."""
    votes = dict.fromkeys(CHECKS, 0)
    for token, n in Counter(_SIGN.findall(code)).items():
        for language in _SPEAKS.get(token, ()):
            votes[language] += n
    return sorted(CHECKS, key=lambda k: (-votes[k], k))


def error_of(code: str, language: str, memory: dict) -> str | None:
    """Why a text is no program of the language; None if it is one. Undecided where that cannot be told."""
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    try:
        CHECKS[language](code.removeprefix("﻿"), memory)
    except Bad as e:
        return str(e)[:200]
    except RecursionError:
        raise Undecided("too deep") from None
    except (IndexError, KeyError):
        return "unfinished"
    return None

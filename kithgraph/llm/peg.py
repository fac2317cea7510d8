"""Parsing-expression grammars, compiled to atomic patterns.

A grammar is a list of rules `name <- expression`. Expressions have the usual PEG forms: sequence by spaces,
ordered choice `/`, `* + ?`, look-ahead `& !`, groups, quoted literals, `[classes]`, `.`, and rule names; `@name`
also captures what the rule matched. As PEG choice and repetition never give back what they took, each becomes an
atomic group, so a match takes one forward pass; a rule that refers to itself becomes a recursive pattern, which is
how nested annotations are matched.
"""

from __future__ import annotations

import regex

_TOKEN = regex.compile(r"""\s*(?:(?P<lit>'(?:[^'\\]|\\.)*')|(?P<cls>\[(?:[^\]\\]|\\.)+\])|(?P<ref>@?[a-z_]+)|(?P<op><-|[/*+?&!().]))""", regex.X)


class Grammar:
    """`Grammar(text).pattern(rule)` is the compiled pattern of a rule; captures are its parse tree's named parts."""

    def __init__(self, text: str):
        self.rules: dict[str, list] = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, body = line.split("<-", 1)
                self.tokens, self.at = [m for m in _TOKEN.finditer(body.strip())], 0
                self.rules[name.strip()] = self._choice()

    def _peek(self) -> str:
        return self.tokens[self.at].group().strip() if self.at < len(self.tokens) else ""

    def _choice(self):
        ways = [self._sequence()]
        while self._peek() == "/":
            self.at += 1
            ways.append(self._sequence())
        return ("choice", ways) if len(ways) > 1 else ways[0]

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "/", ")"):
            parts.append(self._prefixed())
        return ("seq", parts)

    def _prefixed(self):
        if self._peek() in ("&", "!"):
            sign = self._peek()
            self.at += 1
            return (sign, self._prefixed())
        token = self.tokens[self.at]
        self.at += 1
        if token.group().strip() == "(":
            node = self._choice()
            self.at += 1
        elif token["lit"]:
            node = ("lit", token["lit"][1:-1].replace("\\'", "'"))
        elif token["cls"]:
            node = ("cls", token["cls"])
        elif token["ref"]:
            node = ("ref", token["ref"])
        else:
            node = ("cls", ".")
        while self._peek() in ("*", "+", "?"):
            node = ("rep", self._peek(), node)
            self.at += 1
        return node

    def _emit(self, node, open_rules: tuple[str, ...]) -> str:
        kind = node[0]
        if kind == "choice":
            return "(?>" + "|".join(self._emit(n, open_rules) for n in node[1]) + ")"
        if kind == "seq":
            return "".join(self._emit(n, open_rules) for n in node[1])
        if kind == "rep":
            return f"(?>(?:{self._emit(node[2], open_rules)}){node[1]})"
        if kind in "&!":
            return f"(?{'=' if kind == '&' else '!'}{self._emit(node[1], open_rules)})"
        if kind == "lit":
            return regex.escape(node[1])
        if kind == "cls":
            return node[1]
        name = node[1].lstrip("@")
        if name in open_rules:
            return f"(?&_{name})"
        inner = self._emit(self.rules[name], (*open_rules, name))
        if f"(?&_{name})" in inner:
            inner = f"(?P<_{name}>{inner})"
        return f"(?P<{name}>{inner})" if node[1][0] == "@" else f"(?>{inner})"

    def pattern(self, rule: str, flags: int = 0) -> regex.Pattern:
        return regex.compile(self._emit(("ref", rule), ()), flags)

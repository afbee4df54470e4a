"""Parser of the query language: text to a tree of :class:`Node`, whose kinds are the names of the logical model's expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from asclepia.plans.errors import SyntaxProblem


@dataclass
class Node:
    kind: str
    args: list[Node] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)

    def __getitem__(self, name: str):
        return self.attrs.get(name)


@dataclass
class Definition:
    name: str
    body: Node
    context: str = "Unfiltered"
    access: str = "Public"


@dataclass
class Library:
    name: str | None = None
    version: str | None = None
    usings: list[tuple[str, str | None]] = field(default_factory=list)
    includes: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    code_systems: dict[str, str] = field(default_factory=dict)
    value_sets: dict[str, str] = field(default_factory=dict)
    codes: dict[str, tuple[str, str | None, str | None]] = field(default_factory=dict)
    concepts: dict[str, tuple[list[str], str | None]] = field(default_factory=dict)
    parameters: dict[str, tuple[Node | None, Node | None]] = field(default_factory=dict)
    definitions: dict[str, Definition] = field(default_factory=dict)
    functions: dict[str, list[tuple[list[tuple[str, Node]], Node]]] = field(default_factory=dict)


TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<time>@T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)
    |(?P<date>@\d{4}(-\d{2}(-\d{2})?)?(T(\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?(Z|[+-]\d{2}:\d{2})?)?)
    |(?P<number>\d+(\.\d+)?L?)
    |(?P<string>'(?:\\.|[^'\\])*')
    |(?P<quoted>"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)
    |(?P<name>\$?[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=|>=|!=|!~|->|[-+*/^=<>~&|(){}\[\],.:;])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "'": "'", '"': '"', "`": "`", "\\": "\\", "/": "/"}
UNIT_WORDS = ("year", "years", "month", "months", "week", "weeks", "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "millisecond", "milliseconds")
PRECISION_WORDS = tuple(w for w in UNIT_WORDS if not w.endswith("s"))
#: Words that end an expression where an alias or a name could stand.
CLAUSES = {"where", "return", "sort", "with", "without", "let", "aggregate", "such", "then", "else", "end", "when", "and", "or", "xor", "implies", "asc", "ascending", "desc", "descending", "by", "starting", "define", "all", "distinct"}


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text, flags=re.S)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}", 1)
        if m.lastgroup != "space" and (kind := next(k for k in ("time", "date", "number", "string", "quoted", "name", "op", "space") if m[k] is not None)) != "space":
            out.append((kind, m[0], at))
        at = m.end()
    return [*out, ("end", "", at)]


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens(text), 0

    # Tokens.

    def peek(self, ahead: int = 0) -> str:
        kind, text, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text if kind in ("name", "op") else ""

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def next(self) -> tuple[str, str]:
        kind, text, _ = self.tokens[self.at]
        self.at += 1
        return kind, text

    def take(self, *words: str) -> bool:
        """Takes the words if they come next, in this order."""
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            kind, text, at = self.tokens[self.at]
            raise SyntaxProblem(f"expected {' '.join(words)!r} but found {text!r} at {at}", 2)

    def one_of(self, *words: str) -> str | None:
        if self.peek() in words and self.kind() != "end":
            return self.next()[1]
        return None

    def name(self) -> str:
        kind, text = self.next()
        if kind == "quoted":
            return unescape(text[1:-1])
        if kind == "name":
            return text
        raise SyntaxProblem(f"expected a name but found {text!r} at {self.tokens[self.at - 1][2]}")

    def string(self) -> str:
        kind, text = self.next()
        if kind != "string":
            raise SyntaxProblem(f"expected a string but found {text!r}")
        return unescape(text[1:-1])

    def qualified(self) -> str:
        out = self.name()
        while self.take("."):
            out += "." + self.name()
        return out

    # Libraries.

    def library(self) -> Library:
        lib, context = Library(), "Unfiltered"
        version = lambda: self.string() if self.take("version") else None
        while self.kind() != "end":
            access = self.one_of("public", "private")
            word = self.name()
            if word == "library":
                lib.name, lib.version = self.qualified(), version()
            elif word == "using":
                lib.usings.append((self.qualified(), version()))
            elif word == "include":
                path = self.qualified()
                v = version()
                alias = self.name() if self.take("called") else path
                lib.includes[alias] = (path, v)
            elif word == "context":
                context = self.name()
            elif word == "codesystem":
                n = self.name()
                self.need(":")
                lib.code_systems[n] = self.string()
                version()
            elif word == "valueset":
                n = self.name()
                self.need(":")
                lib.value_sets[n] = self.string()
                version()
                if self.take("codesystems"):
                    self.need("{")
                    while not self.take("}"):
                        self.name()
                        self.take(",")
            elif word == "code":
                n = self.name()
                self.need(":")
                value = self.string()
                system = self.name() if self.take("from") else None
                lib.codes[n] = (value, system, self.string() if self.take("display") else None)
            elif word == "concept":
                n = self.name()
                self.need(":")
                self.need("{")
                parts = []
                while not self.take("}"):
                    parts.append(self.name())
                    self.take(",")
                lib.concepts[n] = (parts, self.string() if self.take("display") else None)
            elif word == "parameter":
                n = self.name()
                kind = self.type() if self.peek() not in ("default", "define", "parameter", "context", "") or self.kind() == "quoted" else None
                lib.parameters[n] = (kind, self.expression() if self.take("default") else None)
            elif word == "define":
                access = self.one_of("public", "private") or access
                if self.take("fluent") or self.peek() == "function":
                    self.need("function")
                    n = self.name()
                    self.need("(")
                    operands = []
                    while not self.take(")"):
                        o = self.name()
                        operands.append((o, self.type()))
                        self.take(",")
                    if self.take("returns"):
                        self.type()
                    self.need(":")
                    lib.functions.setdefault(n, []).append((operands, self.expression()))
                else:
                    n = self.name()
                    self.need(":")
                    if n in lib.definitions:
                        raise SyntaxProblem(f"{n!r} is defined twice")
                    lib.definitions[n] = Definition(n, self.expression(), context, (access or "public").title())
            else:
                raise SyntaxProblem(f"unexpected {word!r} at {self.tokens[self.at - 1][2]}")
        return lib

    # Types.

    def type(self) -> Node:
        name = self.qualified()
        name = name.removeprefix("System.").removeprefix("FHIR.")
        if name in ("List", "Interval", "Choice") and self.take("<"):
            inner = [self.type()]
            while self.take(","):
                inner.append(self.type())
            self.need(">")
            return Node("Type", inner, {"name": name})
        if name == "Tuple" and self.take("{"):
            names = []
            inner = []
            while not self.take("}"):
                names.append(self.name())
                inner.append(self.type())
                self.take(",")
            return Node("Type", inner, {"name": "Tuple", "fields": names})
        return Node("Type", [], {"name": name})

    # Expressions, from the loosest to the tightest.

    def whole(self) -> Node:
        out = self.expression()
        if self.kind() != "end":
            raise SyntaxProblem(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
        return out

    def expression(self) -> Node:
        if self.peek() == "from" and self.kind(1) != "end" and self.peek(1) in ("(", "[", "{"):
            self.next()
            first = [self.source()]
            while self.take(","):
                first.append(self.source())
            return self.query(first)
        if self.peek() in ("(", "[", "{"):
            start = self.at
            try:
                first = self.source()
                return self.query([first])
            except SyntaxProblem:
                self.at = start
        return self.implies()

    def source(self) -> tuple[str, Node]:
        if self.peek() == "[":
            node = self.retrieve()
        elif self.peek() == "{":
            node = self.atom()
        else:
            self.need("(")
            node = self.expression()
            self.need(")")
        if self.kind() not in ("name", "quoted") or self.peek() in CLAUSES | OPERATORS:
            raise SyntaxProblem("no alias")
        return self.name(), node

    def query(self, sources: list[tuple[str, Node]]) -> Node:
        lets, relations, where, ret, agg, sort = [], [], None, None, None, None
        if self.take("let"):
            while True:
                n = self.name()
                self.need(":")
                lets.append((n, self.expression()))
                if not self.take(","):
                    break
        while self.peek() in ("with", "without"):
            kind = self.next()[1]
            alias, node = self.relation_source()
            such = None
            if self.take("such", "that"):
                such = self.expression()
            relations.append((kind, alias, node, such))
        if self.take("where"):
            where = self.expression()
        if self.take("aggregate"):
            how = self.one_of("all", "distinct")
            name = self.name()
            start = None
            if self.take("starting"):
                start = self.implies()
            self.need(":")
            agg = (name, start, self.expression(), how == "distinct")
        elif self.take("return"):
            how = self.one_of("all", "distinct")
            ret = (self.expression(), how == "distinct")
        if self.take("sort"):
            sort = []
            if self.take("by"):
                while True:
                    e = self.implies()
                    sort.append((e, (self.one_of("asc", "ascending", "desc", "descending") or "asc")[:3] != "des"))
                    if not self.take(","):
                        break
            else:
                sort.append((None, (self.one_of("asc", "ascending", "desc", "descending") or "asc")[:3] != "des"))
        return Node("Query", [n for _, n in sources], {"aliases": [a for a, _ in sources], "lets": lets, "relations": relations, "where": where, "return": ret, "aggregate": agg, "sort": sort})

    def relation_source(self) -> tuple[str, Node]:
        if self.peek() in ("[", "{", "("):
            return self.source()
        node = self.postfix()
        return self.name(), node

    def implies(self) -> Node:
        left = self.or_()
        return Node("Implies", [left, self.implies()]) if self.take("implies") else left

    def or_(self) -> Node:
        left = self.and_()
        while word := self.one_of("or", "xor"):
            left = Node(word.title(), [left, self.and_()])
        return left

    def and_(self) -> Node:
        left = self.membership()
        while self.take("and"):
            left = Node("And", [left, self.membership()])
        return left

    def _precision(self) -> str | None:
        if self.peek() in UNIT_WORDS and self.peek(1) == "of":
            word = self.next()[1]
            self.need("of")
            return word
        return None

    def membership(self) -> Node:
        left = self.equality()
        while True:
            if self.take("properly", "between") or self.take("between"):
                low = self.equality_free()
                self.need("and")
                left = Node("Between", [left, low, self.equality_free()])
            elif self.peek() == "properly" and self.peek(1) in ("contains", "in"):
                self.next()
                kind = "ProperContains" if self.next()[1] == "contains" else "ProperIn"
                precision = self._precision()
                left = Node(kind, [left, self.equality()], {"precision": precision})
            elif self.peek() in ("in", "contains") and self.kind() == "name":
                word = self.next()[1]
                precision = self._precision()
                left = Node("In" if word == "in" else "Contains", [left, self.equality()], {"precision": precision})
            else:
                return left

    def equality_free(self) -> Node:
        return self.additive()

    def equality(self) -> Node:
        left = self.inequality()
        while word := self.one_of("=", "!=", "~", "!~"):
            right = self.inequality()
            left = {"=": lambda: Node("Equal", [left, right]), "!=": lambda: Node("NotEqual", [left, right]), "~": lambda: Node("Equivalent", [left, right]), "!~": lambda: Node("Not", [Node("Equivalent", [left, right])])}[word]()
        return left

    def inequality(self) -> Node:
        left = self.timing()
        while word := self.one_of("<", "<=", ">", ">="):
            left = Node({"<": "Less", "<=": "LessOrEqual", ">": "Greater", ">=": "GreaterOrEqual"}[word], [left, self.timing()])
        return left

    def timing(self) -> Node:
        left = self.setop()
        while (found := self._timing()) is not None:
            kind, precision = found
            right = self.setop()
            left = Node(kind, [left, right], {"precision": precision})
        return left

    def _timing(self) -> tuple[str, str | None] | None:
        start = self.at
        if self.take("starts"):
            if self.peek() in ("before", "after", "same", "on", "during", "in", "included"):
                self.at = start
                return None
            return "Starts", self._precision()
        if self.take("ends"):
            return "Ends", self._precision()
        properly = self.take("properly")
        for words, kind in ((("includes",), "Includes"), (("included", "in"), "IncludedIn"), (("during",), "IncludedIn")):
            if self.take(*words):
                return ("Proper" if properly else "") + kind, self._precision()
        if properly:
            self.at = start
            return None
        if self.take("same"):
            precision = self.one_of(*PRECISION_WORDS)
            kind = "SameOrBefore" if self.take("or", "before") else "SameOrAfter" if self.take("or", "after") else "SameAs"
            if kind == "SameAs":
                self.need("as")
            else:
                precision = self._precision() or precision
            return kind, precision
        if self.take("on", "or", "before") or self.take("before", "or", "on"):
            return "SameOrBefore", self._precision()
        if self.take("on", "or", "after") or self.take("after", "or", "on"):
            return "SameOrAfter", self._precision()
        for word, kind in (("before", "Before"), ("after", "After")):
            if self.take(word):
                return kind, self._precision()
        for word, kind in (("meets", "Meets"), ("overlaps", "Overlaps")):
            if self.take(word):
                side = self.one_of("before", "after")
                return kind + (side.title() if side else ""), self._precision()
        return None

    def setop(self) -> Node:
        left = self.additive()
        while word := self.one_of("union", "|", "intersect", "except"):
            left = Node({"union": "Union", "|": "Union", "intersect": "Intersect", "except": "Except"}[word], [left, self.additive()])
        return left

    def additive(self) -> Node:
        left = self.multiplicative()
        while word := self.one_of("+", "-", "&"):
            left = Node({"+": "Add", "-": "Subtract", "&": "Concatenate"}[word], [left, self.multiplicative()])
        return left

    def multiplicative(self) -> Node:
        left = self.power()
        while word := self.one_of("*", "/", "div", "mod"):
            left = Node({"*": "Multiply", "/": "Divide", "div": "TruncatedDivide", "mod": "Modulo"}[word], [left, self.power()])
        return left

    def power(self) -> Node:
        left = self.typed()
        return Node("Power", [left, self.power()]) if self.take("^") else left

    def typed(self) -> Node:
        left = self.unary()
        while True:
            if self.peek() == "as" and self.kind() == "name":
                self.next()
                left = Node("As", [left], {"type": self.type()})
            elif self.take("is"):
                negate = self.take("not")
                word = self.one_of("null", "true", "false")
                node = Node({"null": "IsNull", "true": "IsTrue", "false": "IsFalse"}[word], [left]) if word else Node("Is", [left], {"type": self.type()})
                left = Node("Not", [node]) if negate else node
            else:
                return left

    def unary(self) -> Node:
        if self.take("-"):
            inner = self.unary()
            if inner.kind == "Literal" and inner["type"] in ("Integer", "Long", "Decimal"):
                return Node("Literal", [], inner.attrs | {"value": inner["value"][1:] if inner["value"].startswith("-") else "-" + inner["value"]})
            return Node("Negate", [inner])
        if self.take("+"):
            return self.unary()
        if self.take("not"):
            return Node("Not", [self.unary()])
        if self.take("exists"):
            return Node("Exists", [self.unary()])
        for words, kind in ((("start", "of"), "Start"), (("end", "of"), "End"), (("width", "of"), "Width"), (("point", "from"), "PointFrom"), (("successor", "of"), "Successor"), (("predecessor", "of"), "Predecessor"), (("singleton", "from"), "SingletonFrom"), (("date", "from"), "DateFrom"), (("time", "from"), "TimeFrom"), (("timezoneoffset", "from"), "TimezoneOffsetFrom"), (("timezone", "from"), "TimezoneFrom")):
            if self.take(*words):
                return Node(kind, [self.unary()])
        for word, kind in (("distinct", "Distinct"), ("flatten", "Flatten")):
            if self.peek() == word and self.peek(1) != ":":
                self.next()
                return Node(kind, [self.unary()])
        if self.peek() in ("collapse", "expand"):
            kind = self.next()[1].title()
            args = [self.unary()]
            if self.take("per"):
                args.append(Node("Quantity", [], {"value": "1", "unit": self.next()[1]}) if self.peek() in UNIT_WORDS else self.unary())
            return Node(kind, args)
        if self.peek() in PRECISION_WORDS and self.peek(1) == "from":
            precision = self.next()[1]
            self.need("from")
            return Node("DateTimeComponentFrom", [self.unary()], {"precision": precision})
        if self.peek() in ("minimum", "maximum"):
            kind = "MinValue" if self.next()[1] == "minimum" else "MaxValue"
            return Node(kind, [], {"type": self.type()})
        if self.peek() == "duration" and self.peek(1) == "in":
            self.at += 2
            return self._between("DurationBetween")
        if self.peek() == "difference" and self.peek(1) == "in":
            self.at += 2
            return self._between("DifferenceBetween")
        if self.peek() in UNIT_WORDS and self.peek(1) == "between":
            return self._between("DurationBetween")
        if self.take("convert"):
            value = self.postfix() if self.peek() != "-" else self.unary()
            self.need("to")
            if self.kind() == "string":
                return Node("ConvertQuantity", [value], {"unit": self.string()})
            return Node("Convert", [value], {"type": self.type()})
        if self.take("cast"):
            value = self.postfix()
            self.need("as")
            return Node("As", [value], {"type": self.type()})
        return self.postfix()

    def _between(self, kind: str) -> Node:
        precision = self.next()[1]
        self.need("between")
        low = self.additive()
        self.need("and")
        return Node(kind, [low, self.additive()], {"precision": precision})

    def postfix(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                name = self.name()
                node = self.call(name, [node]) if self.peek() == "(" else Node("Property", [node], {"path": name})
            elif self.peek() == "[":
                self.next()
                node = Node("Indexer", [node, self.expression()])
                self.need("]")
            else:
                return node

    def call(self, name: str, args: list[Node]) -> Node:
        self.need("(")
        while not self.take(")"):
            args.append(self.expression())
            if not self.take(",") and self.peek() != ")":
                self.need(")")
        return Node("FunctionRef", args, {"name": name})

    def items(self, closing: str) -> list[Node]:
        out = []
        while not self.take(closing):
            out.append(self.expression())
            if not self.take(",") and self.peek() != closing:
                self.need(closing)
        return out

    def retrieve(self) -> Node:
        self.need("[")
        attrs: dict = {"type": self.qualified().rpartition(".")[2]}
        if self.take(":"):
            if self.peek(1) in ("in", "=", "~") and self.kind() == "name":
                attrs["code_path"] = self.name()
                attrs["comparator"] = self.next()[1]
            if self.kind() in ("quoted", "name"):
                attrs["codes"] = Node("IdentifierRef", [], {"name": self.qualified()})
            else:
                attrs["codes"] = self.expression()
        self.need("]")
        return Node("Retrieve", [], attrs)

    def tuple_(self, kind: str = "Tuple", **attrs) -> Node:
        names, values = [], []
        self.need("{")
        if self.take(":"):
            self.need("}")
            return Node(kind, [], {"names": [], **attrs})
        while not self.take("}"):
            names.append(self.name())
            self.need(":")
            values.append(self.expression())
            self.take(",")
        return Node(kind, values, {"names": names, **attrs})

    def atom(self) -> Node:
        kind, text = self.tokens[self.at][:2]
        if kind == "number":
            self.next()
            if text.endswith("L"):
                return Node("Literal", [], {"type": "Long", "value": text[:-1]})
            quantity = None
            if self.kind() == "string":
                quantity = Node("Quantity", [], {"value": text, "unit": self.string()})
            elif self.peek() in UNIT_WORDS and self.peek(1) not in ("between", "from"):
                quantity = Node("Quantity", [], {"value": text, "unit": self.next()[1]})
            if quantity:
                if self.peek() == ":" and self.kind(1) == "number" and self.kind(2) == "string":
                    self.next()
                    return Node("Ratio", [quantity, self.atom()])
                return quantity
            return Node("Literal", [], {"type": "Decimal" if "." in text else "Integer", "value": text})
        if kind == "string":
            return Node("Literal", [], {"type": "String", "value": self.string()})
        if kind == "time":
            self.next()
            return Node("Literal", [], {"type": "Time", "value": text[2:]})
        if kind == "date":
            self.next()
            return Node("Literal", [], {"type": "DateTime" if "T" in text else "Date", "value": text[1:]})
        if kind == "quoted":
            name = self.name()
            return self.call(name, []) if self.peek() == "(" else Node("IdentifierRef", [], {"name": name})
        if text == "(":
            self.next()
            node = self.expression()
            self.need(")")
            return node
        if text == "[":
            return self.retrieve()
        if text == "{":
            if self.peek(1) == ":" or (self.kind(1) in ("name", "quoted") and self.peek(2) == ":"):
                return self.tuple_()
            self.next()
            return Node("List", self.items("}"))
        if kind != "name":
            raise SyntaxProblem(f"unexpected {text or 'end'!r} at {self.tokens[self.at][2]}")
        after = self.peek(1)
        if text == "List" and after in ("<", "{"):
            self.next()
            inner = None
            if self.take("<"):
                inner = self.type()
                self.need(">")
            self.need("{")
            return Node("List", self.items("}"), {"type": inner})
        if text == "Interval" and after in ("[", "("):
            self.next()
            low_closed = self.next()[1] == "["
            low = self.expression()
            self.need(",")
            high = self.expression()
            closing = self.next()[1]
            if closing not in ("]", ")"):
                raise SyntaxProblem(f"expected the end of an interval but found {closing!r}")
            return Node("Interval", [low, high], {"low_closed": low_closed, "high_closed": closing == "]"})
        if text == "Tuple" and after == "{":
            self.next()
            return self.tuple_()
        if text in ("System", "FHIR") and after == ".":
            self.at += 2
            text, after = self.peek(), self.peek(1)
        if after == "{" and text[:1].isupper():
            self.next()
            return self.tuple_("Instance", type=text)
        if text == "if":
            self.next()
            c = self.expression()
            self.need("then")
            t = self.expression()
            self.need("else")
            return Node("If", [c, t, self.expression()])
        if text == "case":
            self.next()
            comparand = None if self.peek() == "when" else self.expression()
            branches = []
            while self.take("when"):
                w = self.expression()
                self.need("then")
                branches.append((w, self.expression()))
            other = self.expression() if self.take("else") else None
            self.need("end")
            return Node("Case", [], {"comparand": comparand, "branches": branches, "else": other})
        if text in ("true", "false"):
            self.next()
            return Node("Literal", [], {"type": "Boolean", "value": text})
        if text == "null":
            self.next()
            return Node("Null")
        if text in ("$this", "$index", "$total"):
            self.next()
            return Node({"$this": "Current", "$index": "Iteration", "$total": "Total"}[text])
        if text in CLAUSES:
            raise SyntaxProblem(f"unexpected {text!r} at {self.tokens[self.at][2]}")
        self.next()
        return self.call(text, []) if self.peek() == "(" else Node("IdentifierRef", [], {"name": text})


OPERATORS = {
    "and", "or", "xor", "implies", "in", "contains", "between", "is", "as", "div", "mod", "union", "intersect", "except", "before", "after", "during", "includes", "included", "meets",
    "overlaps", "starts", "ends", "same", "on", "properly", "within", "to", "per",
}


def parse_expression(text: str) -> Node:
    return Parser(text).whole()


def parse_library(text: str) -> Library:
    return Parser(text).library()

"""Whether two answers in LaTeX or plain notation are equal as expressions.

An answer is parsed to a tree: numbers, letters, sums, products, quotients,
powers, roots and a few functions.  Two trees that are rational functions are
equal if they agree at random points of a prime field, which is exact but for a
chance of about degree / 2**61 a point.  Others are compared as complex numbers
at random points.  Matrices, tuples, intervals and sets are compared element by
element.  Nothing is evaluated as code, and what doesn't parse is equal to
nothing here.
"""

from __future__ import annotations

import cmath
import math
import random
import re
from collections.abc import Callable
from fractions import Fraction

PRIME = (1 << 61) - 1
POINTS = 4
#: An answer longer than this, nested deeper, or with a larger power isn't looked at.
LONGEST, DEEPEST, LARGEST_POWER = 1_000, 60, 1_000

Tree = tuple

TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:,\d{3})+(?:\.\d+)?(?![\d])|\d+\.?\d*|\.\d+)|(?P<command>\\[A-Za-z]+|\\[^A-Za-z])|(?P<word>[A-Za-z]+)|(?P<sign>\*\*|.))", re.S)
#: Commands that only change how an answer looks, and what others stand for.
LOOKS = frozenset("\\left \\right \\, \\! \\; \\: \\displaystyle \\big \\Big \\bigl \\bigr \\quad \\$ \\limits".split()) | {"\\ "}
SIGNS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "\\{": "(", "\\}": ")", "−": "-", "\\lbrace": "(", "\\rbrace": ")", "\\lvert": "|", "\\rvert": "|"}
FRACTIONS = frozenset(("\\frac", "\\dfrac", "\\tfrac", "\\cfrac"))
FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "abs": abs,
}
GREEK = frozenset("alpha beta gamma delta epsilon theta lambda mu nu phi varphi psi omega sigma rho tau xi eta zeta kappa chi".split())


class Unreadable(ValueError):
    """The text is no expression that is understood here."""


class NotRational(ArithmeticError):
    """The tree is no rational function."""


def tokens(text: str) -> list[str]:
    out = []
    for m in TOKEN.finditer(text.strip()):
        got = m.group().strip()
        if not got or got in LOOKS:
            continue
        if m.group("number"):
            got = got.replace(",", "")
        out.append(SIGNS.get(got, got))
    return out


class Parser:
    """Recursive descent; products may leave out the sign."""

    def __init__(self, text: str) -> None:
        self.all, self.at, self.depth = tokens(text), 0, 0

    def peek(self) -> str:
        return self.all[self.at] if self.at < len(self.all) else ""

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if not got or (wanted is not None and got != wanted):
            raise Unreadable(f"{wanted or 'more'} expected")
        self.at += 1
        return got

    def whole(self) -> Tree:
        tree = self.sum()
        if self.peek():
            raise Unreadable(self.peek())
        return tree

    def sum(self) -> Tree:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unreadable("too deep")
        sign = self.take() if self.peek() in ("+", "-") else "+"
        tree = self.product()
        tree = ("neg", tree) if sign == "-" else tree
        while self.peek() in ("+", "-"):
            tree = (self.take(), tree, self.product())
        self.depth -= 1
        return tree

    def product(self) -> Tree:
        tree = self.signed()
        while True:
            nxt = self.peek()
            if nxt in ("*", "/"):
                tree = (self.take(), tree, self.signed())
            elif nxt and nxt not in "+-)]}|,&=<>^_!" and nxt != "\\end" and nxt != "\\\\":
                mixed = self._mixed(tree)
                tree = mixed if mixed else ("*", tree, self.power())
            else:
                return tree

    def _mixed(self, tree: Tree) -> Tree | None:
        """A whole number followed by a fraction of whole numbers is their sum."""
        if tree[0] != "num" or tree[1].denominator != 1 or self.peek() not in FRACTIONS or not self.all[self.at - 1].isdigit():
            return None
        at, part = self.at, self.power()
        if part[0] == "/" and part[1][0] == part[2][0] == "num":
            return ("+", tree, part)
        self.at = at
        return None

    def signed(self) -> Tree:
        return ("neg", self.signed()) if self.peek() == "-" and self.take() else self.power()

    def power(self) -> Tree:
        tree = self.atom()
        while self.peek() in ("!", "%", "\\%", "^"):
            sign = self.take()
            if sign == "!":
                tree = ("call", "factorial", tree)
            elif sign == "^":
                if self.peek() in ("\\circ", "{") and self.all[self.at : self.at + 3] in (["{", "\\circ", "}"],) or self.peek() == "\\circ":
                    self.at += 3 if self.peek() == "{" else 1  # degrees
                    continue
                exponent = self.argument() if self.peek() != "-" else self.signed()
                tree = ("^", tree, exponent)
        return tree

    def argument(self) -> Tree:
        """A group in braces, or one token; of a number in plain form its first digit only, as in \\frac12."""
        if self.peek() == "{":
            return self.group("{", "}")
        got = self.peek()
        if got.isdigit() and len(got) > 1 and self.at and self.all[self.at - 1] in FRACTIONS | {"\\sqrt", "}"}:
            self.all[self.at : self.at + 1] = [got[0], got[1:]]
        return self.atom()

    def group(self, opening: str, closing: str) -> Tree:
        self.take(opening)
        tree = self.sum()
        self.take(closing)
        return tree

    def atom(self) -> Tree:
        got = self.peek()
        if got and got in "([{":
            return self.group(got, {"(": ")", "[": "]", "{": "}"}[got])
        if got == "|":
            return ("call", "abs", self.group("|", "|"))
        self.take()
        if got[0].isdigit() or got[0] == ".":
            return ("num", Fraction(got))
        if got in FRACTIONS:
            above = self.argument()
            if self.peek().isdigit() and len(self.peek()) > 1:
                self.all[self.at : self.at + 1] = [self.peek()[0], self.peek()[1:]]
            return ("/", above, self.argument())
        if got == "\\sqrt":
            degree = self.group("[", "]") if self.peek() == "[" else ("num", Fraction(2))
            return ("root", self.argument(), degree)
        if got in ("\\text", "\\mathrm", "\\textbf", "\\mathbf", "\\operatorname"):
            return self.group("{", "}")
        name = got.removeprefix("\\")
        if name in ("pi", "infty", "oo", "π"):
            return ("const", "pi" if name in ("pi", "π") else "inf")
        if name in FUNCTIONS:
            return self.call(name)
        if got[0] == "\\":
            if name in GREEK:
                return self.subscripted(name)
            raise Unreadable(got)
        if got.isalpha():
            if len(got) > 2:
                raise Unreadable(got)  # a word
            if len(got) > 1:  # letters side by side are a product
                self.all[self.at : self.at] = list(got[1:])
            return self.subscripted(got[0])
        raise Unreadable(got)

    def call(self, name: str) -> Tree:
        power = None
        if self.peek() == "^":
            self.take()
            power = self.argument()
        tree = ("call", name, self.atom() if self.peek() in ("(", "{") else self.power())
        return ("^", tree, power) if power else tree

    def subscripted(self, name: str) -> Tree:
        if self.peek() != "_":
            return ("const", "e") if name == "e" else ("const", "i") if name == "i" else ("var", name)
        self.take()
        if self.peek() == "{":
            end = self.all.index("}", self.at) if "}" in self.all[self.at :] else len(self.all)
            below, self.at = "".join(self.all[self.at + 1 : end]), end + 1
        else:
            below = self.take()
        return ("var", f"{name}_{below}")


def parsed(text: str) -> Tree | None:
    if len(text) > LONGEST:
        return None
    try:
        return Parser(text).whole()
    except (Unreadable, ValueError, IndexError, RecursionError, ZeroDivisionError):
        return None


def letters(tree: Tree) -> set[str]:
    return {tree[1]} if tree[0] == "var" else set().union(*(letters(x) for x in tree[1:] if isinstance(x, tuple)))


def in_field(tree: Tree, at: dict[str, int], p: int = PRIME) -> int:
    """The tree's value at a point of the field; NotRational if it is no rational function, ZeroDivisionError at a pole."""
    kind = tree[0]
    if kind == "num":
        return tree[1].numerator * pow(tree[1].denominator, -1, p) % p
    if kind == "var":
        return at[tree[1]]
    if kind == "neg":
        return -in_field(tree[1], at, p) % p
    if kind == "^":
        power = exact(tree[2])
        if power is None or power.denominator != 1 or abs(power) > LARGEST_POWER:
            raise NotRational
        base = in_field(tree[1], at, p)
        if power < 0 and not base:
            raise ZeroDivisionError
        return pow(base, int(power), p)
    if kind in ("+", "-", "*", "/"):
        a, b = in_field(tree[1], at, p), in_field(tree[2], at, p)
        if kind == "/" and not b:
            raise ZeroDivisionError
        return (a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a * pow(b, -1, p)) % p
    raise NotRational


def exact(tree: Tree) -> Fraction | None:
    """The value of a tree of numbers under the four operations."""
    if tree[0] == "num":
        return tree[1]
    if tree[0] == "neg":
        a = exact(tree[1])
        return None if a is None else -a
    if tree[0] in ("+", "-", "*", "/"):
        a, b = exact(tree[1]), exact(tree[2])
        if a is None or b is None or (tree[0] == "/" and not b):
            return None
        return a + b if tree[0] == "+" else a - b if tree[0] == "-" else a * b if tree[0] == "*" else a / b
    return None


def of_whole_numbers(tree: Tree) -> bool:
    """Whether the tree is made of whole numbers and the four operations alone, as a fraction is: such a value is exact, not rounded."""
    return tree[1].denominator == 1 if tree[0] == "num" else tree[0] in ("neg", "+", "-", "*", "/") and all(map(of_whole_numbers, tree[1:]))


def number(tree: Tree, at: dict[str, complex]) -> complex:
    """The tree's value in double precision."""
    kind = tree[0]
    if kind == "num":
        return complex(float(tree[1]))
    if kind == "var":
        return at[tree[1]]
    if kind == "const":
        return complex({"pi": math.pi, "e": math.e, "inf": math.inf}[tree[1]]) if tree[1] != "i" else 1j
    if kind == "neg":
        return -number(tree[1], at)
    if kind == "call":
        x = number(tree[2], at)
        if tree[1] == "factorial":
            if x.imag or x.real < 0 or x.real > 170 or x.real % 1:
                raise ArithmeticError
            return complex(math.factorial(int(x.real)))
        return complex(FUNCTIONS[tree[1]](x))
    a, b = number(tree[1], at), number(tree[2], at)
    if kind == "root":
        if not letters(tree) and not a.imag and a.real < 0 and not b.imag and b.real % 2 == 1:
            return complex(-((-a.real) ** (1 / b.real)))
        return a ** (1 / b)
    if kind == "^":
        if abs(b) > LARGEST_POWER:
            raise ArithmeticError
        return a**b
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b


def identical(a: Tree, b: Tree, tolerance: float = 1e-4, seed: int = 11) -> bool:
    """Whether the trees are equal: at random points, or, of constants one of which is a decimal or no rational number, within the tolerance."""
    names, noise = sorted(letters(a) | letters(b)), random.Random(seed)
    try:
        for _ in range(POINTS):
            at = {n: noise.randrange(1, PRIME) for n in names}
            if in_field(a, at) != in_field(b, at):
                if names or (of_whole_numbers(a) and of_whole_numbers(b)):
                    return False
                break  # numbers may still agree within the tolerance
        else:
            return True
    except NotRational:
        pass
    except ZeroDivisionError:
        return False
    try:
        agreed = 0
        for _ in range(3 * POINTS):
            point = {n: complex(noise.uniform(-2.5, 2.5)) for n in names}
            x, y = number(a, point), number(b, point)
            if cmath.isnan(x) or cmath.isnan(y):
                continue
            if cmath.isinf(x) or cmath.isinf(y):
                if x != y:
                    return False
            elif abs(x - y) > (1e-9 if names else tolerance) * max(abs(x), abs(y), 1e-12):
                return False
            agreed += 1
        return agreed >= POINTS
    except (ArithmeticError, ValueError, KeyError, OverflowError):
        return False


MATRIX = re.compile(r"\\begin\{(?:[pbvBV]?matrix|array)\}(?:\{[^}]*\})?(.*?)\\end\{(?:[pbvBV]?matrix|array)\}", re.S)


def matrix(text: str) -> list[list[str]] | None:
    """Rows of cells of a text that is one matrix, whatever its brackets, or a list of lists."""
    s = re.sub(r"\\(?:left|right)\s*", "", text).strip().strip("$").strip()
    m = MATRIX.fullmatch(s) or MATRIX.fullmatch(s[1:-1].strip() if s[:1] in "([|" and s[-1:] in ")]|" else s)
    if m:
        rows = [r for r in re.split(r"\\\\(?:\[[^\]]*\])?", m.group(1)) if r.strip()]
        return [[c.strip() for c in r.split("&")] for r in rows]
    listed = re.fullmatch(r"(?:Matrix\()?\[\s*(\[.*\])\s*\]\)?", s, re.S)
    if listed:
        rows = elements(f"({listed.group(1)})")
        inner = [elements(r) for r in rows[1]] if rows else []
        return [cells for _, cells, _ in inner] if inner and all(inner) else None
    return None


#: Named intervals and the brackets they stand for.
INTERVALS = {"Interval": "[]", "Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()", "Point": "()"}


THOUSANDS = re.compile(r"(?<=\d),\d{3}(?!\d)")


def elements(text: str) -> tuple[str, list[str], str] | None:
    """(bracket, elements, bracket) of a tuple, interval or set with a comma at its top level."""
    s = re.sub(r"\\(?:left|right)\s*", "", text).strip().strip("$").strip().replace("\\{", "{").replace("\\}", "}").replace("\\lbrace", "{").replace("\\rbrace", "}")
    named = re.fullmatch(r"(Interval(?:\.[RL]?open)?|Point)\((.*)\)", s, re.S)
    if named:
        s = INTERVALS[named.group(1)][0] + named.group(2) + INTERVALS[named.group(1)][1]
    if len(s) < 3 or s[0] not in "([{" or s[-1] not in ")]}":
        return None
    depth, parts, start = 0, [], 1
    for i, c in enumerate(s):
        depth += (c in "([{") - (c in ")]}")
        if not depth and i < len(s) - 1:
            return None  # the first bracket isn't the last one's
        if c == "," and depth == 1 and not THOUSANDS.match(s, i):
            parts.append(s[start:i].strip())
            start = i + 1
    parts.append(s[start:-1].strip())
    return (s[0], parts, s[-1]) if len(parts) > 1 else None


def equal(a: str, b: str, same: Callable[[str, str], bool] | None = None, tolerance: float = 1e-4) -> bool:
    """Whether two answers are equal as matrices, element by element, or as expressions; `same` compares elements first."""
    inside = lambda x, y: (same is not None and same(x, y)) or equal(x, y, same, tolerance)
    m, n = matrix(a), matrix(b)
    if m is not None or n is not None:
        if m is None or n is None:  # a column vector may stand as a tuple
            other = elements(b if n is None else a)
            column = m if m is not None else n
            return bool(other) and all(len(r) == 1 for r in column) and len(column) == len(other[1]) and all(inside(x[0], y) for x, y in zip(column, other[1], strict=True))
        return [len(r) for r in m] == [len(r) for r in n] and all(inside(x, y) for r, s in zip(m, n, strict=True) for x, y in zip(r, s, strict=True))
    p, q = elements(a), elements(b)
    if p and q:
        if (p[0], p[2]) != (q[0], q[2]) or len(p[1]) != len(q[1]):
            return False
        if p[0] == "{":  # a set's elements come in any order
            left = list(q[1])
            for x in p[1]:
                found = next((y for y in left if inside(x, y)), None)
                if found is None:
                    return False
                left.remove(found)
            return True
        return all(inside(x, y) for x, y in zip(p[1], q[1], strict=True))
    if p or q:
        return False
    if a.count("=") == b.count("=") == 1:  # equations: sides that differ by a factor
        (l1, r1), (l2, r2) = (x.split("=") for x in (a, b))
        sides = [parsed(x) for x in (l1, r1, l2, r2)]
        if any(s is None for s in sides):
            return False
        d1, d2 = ("-", sides[0], sides[1]), ("-", sides[2], sides[3])
        names, noise = sorted(letters(d1) | letters(d2)), random.Random(5)
        at = {n: noise.randrange(1, PRIME) for n in names}
        try:
            ratio = in_field(d1, at) * pow(in_field(d2, at), -1, PRIME) % PRIME
            return ratio != 0 and all(in_field(d1, at) == ratio * in_field(d2, at) % PRIME for at in ({n: noise.randrange(1, PRIME) for n in names} for _ in range(POINTS)))
        except (NotRational, ZeroDivisionError, ValueError):
            return False
    x, y = parsed(a), parsed(b)
    return x is not None and y is not None and identical(x, y, tolerance)

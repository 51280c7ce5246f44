"""Answers that are equal as expressions, and those that are not."""

import random

import pytest

from tessera.functions import algebra as A
from tessera.functions import grading as M

SAME = [
    ("x^2 + y^2 + 4x - 6y + 13", "(x + 2)^2 + (y - 3)^2 "), (r"\frac{\sqrt{505}}{7}", r"\sqrt{505}/7"), (r"2\sqrt{2}", r"\sqrt8"), (r"\frac12", "0.5"), (r"2\frac{1}{2}", "5/2"),
    (r"\frac{x^2-1}{x-1}", "x+1"), (r"\sin^2 x+\cos^2 x", "1"), (r"\tan x", r"\frac{\sin x}{\cos x}"), ("2x=4y", "x=2y"), (r"e^{i\pi}", "-1"), ("3!", "6"), (r"\frac{1}{x}", "x^{-1}"), (r"\sqrt[3]{-8}", "-2"),
    (r"\sqrt[3]{x}", "x^{1/3}"), (r"\pi r^2", r"r^2\pi"), ("x_1+x_2", "x_2+x_{1}"), (r"30^\circ", "30"), ("x**2", "x^2"), ("1,234", "1234"), (r"\left(a+b\right)c", "ac+bc"), ("-x^2", "0-x*x"), ("3.14159", r"\pi"),
    (r"(1,\frac{4}{2})", "(1,2)"), (r"\{1,2\}", r"\{2,1\}"), ("Interval.open(0,1)", r"(0,\frac22)"), (r"(-\infty, 3]", r"(-\infty,\frac{6}{2}]"), ("((1,2),3)", "((1,2),3.0)"), ("(1,234,5)", "(1234,5)"), ("Point(1,2)", "(1,2)"),
    ("\\begin{bmatrix}\n -7 & 6 \\\\\n 11 & -9 \n \\end{bmatrix}", "\\begin{pmatrix}\n -7 & 6 \\\\\n 11 & -9\n \\end{pmatrix}"), ("[[1,2],[3,4]]", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}"), (r"\begin{pmatrix}1\\2\end{pmatrix}", "(1,2)"),
]
OTHER = [
    ("x+1", "x+2"), ("[1,2)", "[1,2]"), ("hello", "hello world"), ("a", "b"), ("1/0", "2/0"), (r"\frac{3}{4}", "0.7501"), ("|x|", "x"), (r"\sqrt{x^2}", "x"), ("x=1", "x=2"), ("(1,2)", "(1,2,3)"), ("(1,2)", "3"), (r"\{1,1\}", r"\{1,2\}"),
    (r"\begin{pmatrix}1&2\end{pmatrix}", r"\begin{pmatrix}1\\2\end{pmatrix}"), ("x^9999", "x^9998"), ("(" * 500 + "x", "x"), ("__import__('os')", "x"), ("", "x"), ("2^", "2"), (r"\frac{1}", "1"), ("9" * 2000, "9" * 2000 + "1"), ("10^{10^{10}}", "1"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert A.equal(a, b) and A.equal(b, a)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not A.equal(a, b) and not A.equal(b, a)


def test_random_rational_functions():
    """Rewritten trees stay equal; a changed number makes them differ."""
    noise = random.Random(8)

    def tree(depth):
        if not depth or noise.random() < 0.2:
            return noise.choice(["x", "y", str(noise.randint(1, 9)), f"\\frac{{{noise.randint(1, 9)}}}{{7}}"])
        a, b = tree(depth - 1), tree(depth - 1)
        return noise.choice([f"({a}+{b})", f"({a}-{b})", f"({a})({b})", f"\\left({a}\\right)^{{{noise.randint(1, 3)}}}", f"\\frac{{{a}}}{{1+({b})^2}}"])

    for _ in range(300):
        a, b, c = tree(3), tree(2), tree(2)
        assert A.equal(f"({a})*({b}+{c})", f"{c}*({a})+({a})({b})")
        assert not A.equal(f"({a})*({b}+{c})", f"({a})*({b}+{c})+\\frac{{x}}{{11}}")


def test_lenient_answers():
    assert M.lenient_score("so \\boxed{x^2 + 2x + 1}", "(x+1)^2") == 1 and M.lenient_score("so \\boxed{x^2 + 2x + 2}", "(x+1)^2") == 0
    assert M.lenient_score("\\boxed{(50\\%, \\sqrt{8})}", "(0.5, 2\\sqrt{2})") == 1 and M.lenient_score("\\boxed{}", "0") == 0


@pytest.mark.parametrize("k", [2, 10_002, 7_200_002])
def test_fractions_are_exact(k):
    """Large fractions that differ by little are not rounded ones; decimals are."""
    assert M.lenient_score(f"\\boxed{{\\frac{{{k + 1}}}{{7}}}}", f"\\frac{{{k}}}{{7}}") == 0 and M.lenient_score(f"\\boxed{{\\frac{{{k}}}{{7}}}}", f"{2 * k}/14") == 1
    assert M.lenient_score(f"\\boxed{{{k / 7:.6f}}}", f"\\frac{{{k}}}{{7}}") == 1


@pytest.mark.parametrize("given,form", [
    (r"\frac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac{72}1", r"\frac{72}1"), (r"\frac1\frac23", r"\frac1\frac23"), (r"\frac+\frac", r"\frac+\frac"), (r"\sqrt3+\sqrt{x}", r"\sqrt{3}+\sqrt{x}"), ("3/4", r"\frac{3}{4}"),
    ("-3/+4", "-3/+4"), ("03/4", "03/4"), ("k=.5", ".5"), (".5", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), ("xyz=3", "xyz=3"), (r"5\text{ cm}", "5"), (r"\dfrac 12", r"\frac{1}{2}"), (r"10\%", "10"), ("{.5}", "{0.5}"), ("", ""), (r"30^{\circ}", "30"),
])
def test_normal_form(given, form):
    assert M.simplified(given) == form


@pytest.mark.parametrize("given", [r"\frac", r"1+\sqrt", r"\sqrt\sqrt2", "x/2", "1/2/", r"\frac\frac12", r"1\text{ a}\text{ b}", "/"])
def test_no_normal_form(given):
    if given.count("/") == 2:
        assert M.simplified(given) == given
    else:
        with pytest.raises(ValueError):
            M.simplified(given)
    assert M.equivalent(given, given) and not M.equivalent(given, given + " ") or given.count("/") == 2

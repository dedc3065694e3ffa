"""Many rules at once against the same rules one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import signatures as sg


@pytest.mark.parametrize("value, atom", [
    ("powershell", "powershell"), ("ab*cdef", "cdef"), ("abc+x", "ab"), ("a.bcd[ef]gh", "bcd"), (r"foo\.bar", "foo.bar"), (r"\d+abc\w", "abc"), ("(abc|d)efg", ""), ("(abc)?defg", "defg"), ("a{2}bcd", "bcd"), ("(?i)HELLO", "HELLO"), (r"x\(yz\)", "x(yz)"),
    ("[]]abc", "abc"), (r"(a\)b[)])cde", "cde"), (r"\Qab\E", ""), ("abc?", "ab"), ("(?x) a b", ""),
])
def test_atoms_of_patterns(value, atom):
    assert sg.Regex(value).atom() == atom


def test_atoms_of_patterns_occur_in_all_matches():
    r = random.Random(8)
    for _ in range(300):
        pattern = "".join(r.choice(["ab", "c", "d*", "e?", "[fg]", "(hi)?", "(?:jk)+", "l{1,2}", ".", r"\.", "m+n"]) for _ in range(5))
        atom = sg.Regex(pattern).atom()
        for m in re.finditer(pattern, "".join(r.choice("abcdefghijklmn.") for _ in range(3000))):
            assert atom in m[0], (pattern, atom)


def test_equals_the_plain_scan(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("abcDEF") for _ in range(4)) for _ in range(30)]
    text = lambda: sg.Text(r.choice(words), nocase=r.random() < 0.5, wide=r.random() < 0.1, fullword=r.random() < 0.3)
    any_string = lambda: r.choice([text, text, lambda: sg.Hex("61 62 ?? [0-2] 63 44 45 46"), lambda: sg.Hex("(61|62) 63 44"), lambda: sg.Regex(r.choice(["ab+[cd]", "DEF.?a", "a|b", r"c\w{2}D"]), nocase=True)])()
    conditions = [sg.any_of, sg.all_of, lambda: sg.of(2, "s*"), lambda: sg.of(0), lambda: sg.count_over("s0", 1), lambda: sg.at("s0", 0), lambda: sg.within("s1", 2, 40), lambda: sg.negate(sg.any_of("s0")), lambda: sg.both(sg.size_under(90), sg.any_of("s1")),
                  lambda: sg.either(sg.any_of("s0"), sg.all_of("s1", "s2")), lambda: sg.either(sg.any_of("s0"), sg.size_under(20)), lambda: sg.uint(0, 1, 97)]
    rules = [sg.Rule(f"r{i}", {f"s{k}": any_string() for k in range(3)}, r.choice(conditions)()) for i in range(120)]
    texts = [(i, "".join(r.choice(words + [" ", "x", "a\0b\0"]) for _ in range(r.randrange(30)))) for i in range(80)] + [(90, None), (91, ""), (92, "é" * 9 + "abcDEF" * 4000)]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    fast = sorted(map(tuple, sg.scan(df, "id", F.col("t"), rules).collect()))
    monkeypatch.setattr(sg, "PLAIN_RULES", 10_000)
    slow = sorted(x for i in range(0, 120, 12) for x in map(tuple, sg.scan(df, "id", F.col("t"), rules[i : i + 12]).collect()))
    assert fast == slow and len({x[1] for x in fast}) > 60


def test_counts_of_plain_strings_equal_those_of_their_patterns(spark, monkeypatch):
    """Rules of plain strings alone are decided by counts of one pass over the texts; no text is written or read again."""
    r = random.Random(12)
    words = ["aaa", "aba", "abab", "Abab", "b.a", "a a", "éaé", "ab\0", "aB a"]
    text = lambda: sg.Text(r.choice(words), nocase=r.random() < 0.5, wide=r.random() < 0.1, fullword=r.random() < 0.4)
    conditions = [sg.any_of, sg.all_of, lambda: sg.of(2), lambda: sg.count_over("s0", 2), lambda: sg.both(sg.any_of("s0"), sg.negate(sg.any_of("s1"))), lambda: sg.either(sg.all_of("s0", "s1"), sg.count_over("s2", 1))]
    rules = [sg.Rule(f"r{i}", {f"s{k}": text() for k in range(3)}, r.choice(conditions)()) for i in range(90)]
    texts = [(i // 2, "".join(r.choice(["a", "A", "b", "B", ".", " ", "é", "É", "\0", "𝒳", "ababab", "aaaaa"]) for _ in range(r.randrange(60)))) for i in range(120)] + [(90, None), (91, "")]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    assert all(rule.counted() for rule in rules)
    monkeypatch.setattr(sg, "work_path", lambda *_: pytest.fail("texts were written"))
    fast = sorted(map(tuple, sg.scan(df, "id", F.col("t"), rules).collect()))
    monkeypatch.setattr(sg, "PLAIN_RULES", 10_000)
    slow = sorted(x for i in range(0, 90, 15) for x in map(tuple, sg.scan(df, "id", F.col("t"), rules[i : i + 15]).collect()))
    assert fast == slow and len({x[1] for x in fast}) > 30

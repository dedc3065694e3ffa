"""Signature rules over text or bytes, each compiled to one Boolean Column.

A rule names strings (text, hex with ``??`` and ``[n-m]`` jumps, or regex, with nocase, wide and fullword) and a condition
made of Python-side combinators, so a whole rule set is one projection that Catalyst evaluates in one pass:

>>> rule = Rule("dropper", {"a": Text("powershell", nocase=True), "b": Hex("4D 5A ?? 00")}, any_of("a", "b"))

With many rules, ``scan`` first finds literal atoms: each condition says which strings it needs one of, each string has a
run of plain characters, and one automaton over all atoms reads a text once. It also counts the strings that are plain
text, so rules of such strings alone, whose conditions only ask how often they occur, are tested on these counts and never
read a text again. Texts with an atom of another rule are kept with the numbers of its rules, and only rules that are named
there become expressions; rules without atoms are tested everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources.folder import work_path

#: Rules up to here are tested on every text; more go through the automaton.
PLAIN_RULES = 16
#: Shorter runs of characters are no atoms.
ATOM = 3
#: Rules in one projection; a larger one is too long for generated code.
TOGETHER = 48


@dataclass(frozen=True)
class Text:
    value: str
    nocase: bool = False
    wide: bool = False
    fullword: bool = False

    def pattern(self) -> str:
        body = "".join(re.escape(c) + ("\\x00" if self.wide else "") for c in self.value)
        if self.fullword:
            body = rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])"
        return ("(?i)" if self.nocase else "") + body

    def atom(self) -> str:
        return "".join(c + ("\0" if self.wide else "") for c in self.value)


@dataclass(frozen=True)
class Hex:
    value: str

    def pattern(self) -> str:
        out = ""
        for token in re.findall(r"\[\s*\d*\s*-?\s*\d*\s*\]|\([^)]*\)|[0-9A-Fa-f?]{2}", self.value):
            if token[0] == "[":
                lo, _, hi = token[1:-1].replace(" ", "").partition("-")
                out += rf"[\s\S]{{{lo or 0},{hi or ('' if '-' in token else lo)}}}"
            elif token[0] == "(":
                out += "(?:" + "|".join(Hex(p).pattern()[4:] for p in token[1:-1].split("|")) + ")"
            elif token == "??":
                out += r"[\s\S]"
            elif "?" in token:
                nibble = [f"\\x{i:x}{token[1]}" if token[0] == "?" else f"\\x{token[0]}{i:x}" for i in range(16)]
                out += "[" + "".join(nibble) + "]"
            else:
                out += f"\\x{token}"
        return "(?s)" + out

    def atom(self) -> str:
        runs, tokens = [""], re.findall(r"\[[^\]]*\]|\([^)]*\)|[0-9A-Fa-f?]{2}", self.value)
        for token in tokens:
            if re.fullmatch("[0-9A-Fa-f]{2}", token):
                runs[-1] += chr(int(token, 16))
            else:
                runs.append("")
        return max(runs, key=len)


@dataclass(frozen=True)
class Regex:
    value: str
    nocase: bool = False

    def pattern(self) -> str:
        return ("(?i)" if self.nocase else "") + self.value

    def atom(self) -> str:
        """The longest run of literals outside groups, classes and repeats; none where alternatives or unknown syntax stand."""
        runs, at, value = [""], 0, re.sub(r"^\(\?[a-z]+\)", "", self.value)
        if re.search(r"[|]|\\[QE]|\(\?[a-z-]*x", value) or value != self.value and "x" in self.value.split(")")[0]:
            return ""
        token = re.compile(r"(\\[^A-Za-z0-9]|[^\\\[\](){}*+?.^$|])|(\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|[.^$])|([*+?{])|(\()", re.DOTALL)
        while at < len(value):
            m = token.match(value, at)
            if not m:
                return ""
            if m[1]:
                runs[-1] += m[1][-1]
            elif m[2]:
                runs.append("")
            elif m[3]:
                runs[-1] = runs[-1][:-1]  # the repeated character may be missing
                runs.append("")
                if m[3] == "{":
                    end = value.find("}", at)
                    if end < 0:
                        return ""
                    at = end + 1
                    continue
            else:  # a group says nothing here
                deep, at = 1, at + 1
                while at < len(value) and deep:
                    inner = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.DOTALL).match(value, at)
                    deep += (inner[0] == "(") - (inner[0] == ")")
                    at = inner.end()
                runs.append("")
                continue
            at = m.end()
        return max(runs, key=len)


@dataclass
class View:
    """A row's content as characters 0-255, and the rule's strings as patterns."""

    content: Column
    strings: dict[str, str]

    def has(self, name: str) -> Column:
        return self.content.rlike(self.strings[name])

    def count(self, name: str) -> Column:
        return F.regexp_count(self.content, F.lit(self.strings[name]))


@dataclass
class Counts:
    """Numbers of matches of the rule's strings, in their order; for conditions that ask no more."""

    counts: Column
    strings: dict[str, int]

    def has(self, name: str) -> Column:
        return self.count(name) > 0

    def count(self, name: str) -> Column:
        return F.get(self.counts, self.strings[name])


Condition = Callable[[View | Counts], Column]


def _named(view: View, names: tuple[str, ...]) -> list[str]:
    """``a*`` stands for all strings whose name begins so; no names for all."""
    return [s for s in view.strings if not names or any(s == n or n.endswith("*") and s.startswith(n[:-1]) for n in names)]


def _needing(condition: Condition, needs: Callable[[list[str]], list[str] | None], counted: bool = False) -> Condition:
    """``needs``: of a rule's string names, those of which one at least must occur; None if the condition can hold without.

    ``counted``: the condition asks only how often strings occur.
    """
    condition.needs, condition.counted = needs, counted
    return condition


def _counted(*conditions: Condition) -> bool:
    return all(getattr(c, "counted", False) for c in conditions)


def _matching(strings: list[str], names: tuple[str, ...]) -> list[str]:
    return [s for s in strings if not names or any(s == n or n.endswith("*") and s.startswith(n[:-1]) for n in names)]


def of(least: int, *names: str) -> Condition:
    return _needing(lambda v: sum((v.has(n).cast("int") for n in _named(v, names)), F.lit(0)) >= least, lambda s: _matching(s, names) if least > 0 else None, True)


def any_of(*names: str) -> Condition:
    return of(1, *names)


def all_of(*names: str) -> Condition:
    return _needing(lambda v: of(len(_named(v, names)), *names)(v), lambda s: _matching(s, names) or None, True)


def count_over(name: str, n: int) -> Condition:
    return _needing(lambda v: v.count(name) > n, lambda s: [name] if n >= 0 else None, True)


def at(name: str, offset: int) -> Condition:
    return _needing(lambda v: F.substring(v.content, offset + 1, 1 << 30).rlike("^(?:" + _lifted(v.strings[name]) + ")"), lambda s: [name])


def within(name: str, lo: int, hi: int) -> Condition:
    return _needing(lambda v: (F.regexp_instr(F.substring(v.content, lo + 1, 1 << 30), F.lit(v.strings[name])) - 1).between(0, hi - lo), lambda s: [name])


def size_under(n: int) -> Condition:
    return _needing(lambda v: F.length(v.content) < n, lambda s: None)


def uint(offset: int, width: int, value: int, big: bool = False) -> Condition:
    """``width`` bytes at ``offset`` as an unsigned number equal ``value``."""
    wanted = value.to_bytes(width, "big" if big else "little").decode("latin-1")
    return _needing(lambda v: F.substring(v.content, offset + 1, width) == F.lit(wanted), lambda s: None)


def both(*conditions: Condition) -> Condition:
    def needs(s: list[str]) -> list[str] | None:
        found = [n for n in (c.needs(s) for c in conditions) if n is not None]
        return min(found, key=len) if found else None

    return _needing(lambda v: F.array_min(F.array(*[c(v) for c in conditions])), needs, _counted(*conditions))


def either(*conditions: Condition) -> Condition:
    def needs(s: list[str]) -> list[str] | None:
        found = [c.needs(s) for c in conditions]
        return None if any(n is None for n in found) else [x for n in found for x in n]

    return _needing(lambda v: F.array_max(F.array(*[c(v) for c in conditions])), needs, _counted(*conditions))


def negate(condition: Condition) -> Condition:
    return _needing(lambda v: ~condition(v), lambda s: None, _counted(condition))


def _lifted(pattern: str) -> str:
    m = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{m[1]}:{pattern[m.end():]})" if m else pattern


@dataclass(frozen=True)
class Rule:
    name: str
    strings: dict[str, Text | Hex | Regex]
    condition: Condition
    tags: tuple[str, ...] = ()
    meta: dict[str, str] = field(default_factory=dict)

    def column(self, content: Column) -> Column:
        return F.coalesce(self.condition(View(content, {k: s.pattern() for k, s in self.strings.items()})), F.lit(False))

    def atoms(self) -> list[str] | None:
        """Lower-case literals of which one occurs in every text that matches; None if there are none to name."""
        needed = getattr(self.condition, "needs", lambda s: None)(list(self.strings))
        if needed is None:
            return None
        found = [_lower(self.strings[n].atom()) for n in needed]
        return None if any(len(a) < ATOM for a in found) else sorted(set(found))

    def counted(self) -> bool:
        """Whether the numbers of matches of its strings decide the rule, and the automaton can count them all."""
        return _counted(self.condition) and self.atoms() is not None and all(isinstance(s, Text) and len(s.atom()) >= ATOM for s in self.strings.values())


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """A-Z alone, as patterns without letter case mean it."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def latin1(c: Column) -> Column:
    """Binary content with one character a byte."""
    return F.decode(c, "ISO-8859-1")


@lru_cache(maxsize=4)
def _automaton(words: tuple[tuple[str, tuple], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, value in words:
        out.add_word(word, value)
    out.make_automaton()
    return out


_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _candidates(atoms: tuple[tuple[str, tuple[int, ...]], ...]):
    """Adds ``_rules``: the numbers of the rules of which an atom occurs in ``_c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(atoms)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_c")).to_pylist()
            rows = [sorted({n for numbers in {numbers for _, numbers in found.iter(_lower(t))} for n in numbers}) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], names=[*batch.schema.names, "_rules"])

    return run


def _occurrences(rules: tuple[tuple[Text, ...], ...]):
    """Replaces ``_c`` by ``_found``: of each rule with a string in it the rule's number and its strings' numbers of matches.

    A string's matches are those of its pattern: from the left, without overlaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[bool, str], list[tuple[int, int, bool]]] = {}
        for i, strings in enumerate(rules):
            for k, s in enumerate(strings):
                words.setdefault((s.nocase, _lower(s.atom()) if s.nocase else s.atom()), []).append((i, k, s.fullword))
        found = {nocase: _automaton(tuple((w, (len(w), tuple(x))) for (n, w), x in words.items() if n == nocase)) for nocase in {n for n, _ in words}}

        width = [len(strings) for strings in rules]
        kind = pa.struct([("rule", pa.int32()), ("counts", pa.list_(pa.int32()))])

        def counts(text: str) -> dict[int, list[int]]:
            out: dict[int, list[int]] = {}
            ends: dict[tuple, int] = {}
            for nocase, automaton in found.items():
                for last, (size, named) in automaton.iter(_lower(text) if nocase else text):
                    begin, end = last + 1 - size, last + 1
                    for at in named:
                        i, k, fullword = at
                        if begin < ends.get(at, 0) or fullword and (begin and text[begin - 1] in _WORD or end < len(text) and text[end] in _WORD):
                            continue
                        ends[at] = end
                        if i not in out:
                            out[i] = [0] * width[i]
                        out[i][k] += 1
            return out

        for batch in batches:
            offsets, numbers, cuts, flat = [0], [], [0], []
            for text in batch.column(1).to_pylist():
                for i, n in counts(text).items():
                    numbers.append(i)
                    flat += n
                    cuts.append(len(flat))
                offsets.append(len(numbers))
            each = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)], names=[batch.schema.names[0], "_found"])

    return run


def _from_counts(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``scan`` for rules that the counts of their strings decide: a text is read once, and each rule found in it is a row.

    Rules whose conditions come to the same expression of their counts are tested together.
    """
    kind = T.ArrayType(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
    found = rows.mapInArrow(_occurrences(tuple(tuple(r.strings.values()) for r in rules)), T.StructType([rows.schema[key], T.StructField("_found", kind)]))
    each = found.select(key, F.explode("_found").alias("_f")).select(key, F.col("_f.rule").alias("_i"), F.col("_f.counts").alias("_n"))
    alike: dict[str, tuple[Column, list[int]]] = {}
    for i, r in enumerate(rules):
        holds = r.condition(Counts(F.col("_n"), {name: k for k, name in enumerate(r.strings)}))
        alike.setdefault(str(holds), (holds, []))[1].append(i)
    holds = reduce(Column.__or__, (F.col("_i").isin(numbers) & c for c, numbers in alike.values()))
    names = F.array(*[F.lit(r.name) for r in rules])
    return each.filter(holds).select(key, F.get(names, F.col("_i")).alias("rule"), F.aggregate("_n", F.lit(0).cast("long"), lambda total, n: total + n).alias("hits"))


def scan(df: DataFrame, key: str, content: Column, rules: list[Rule]) -> DataFrame:
    """``(key, rule, hits)`` of all rules that match; ``hits`` counts matches of all their strings."""
    rows = df.select(key, F.coalesce(content, F.lit("")).alias("_c"))
    if len(rules) <= PLAIN_RULES:
        return _tested(rows, key, rules, lambda i: F.lit(True))
    counted = [r for r in rules if r.counted()]
    rest = [r for r in rules if not r.counted()]
    if not counted:
        return _from_texts(rows, key, rest)
    found = _from_counts(rows, key, counted)
    return found.unionByName(_from_texts(rows, key, rest)) if rest else found


def _tested(rows: DataFrame, key: str, rules: list[Rule], when: Callable[[int], Column]) -> DataFrame:
    return rows.select(key, F.explode(F.array_compact(F.array(*[_result(r, when(i)) for i, r in enumerate(rules)]))).alias("r")).select(key, "r.rule", "r.hits")


def _from_texts(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``scan`` for other rules: those of which an atom occurs in a text are tested on it, and those without atoms on all."""
    atoms: dict[str, list[int]] = {}
    bound = set()
    for i, r in enumerate(rules):
        for atom in r.atoms() or ():
            atoms.setdefault(atom, []).append(i)
            bound.add(i)
    free = [i for i in range(len(rules)) if i not in bound]
    parts = [(rows, free[i : i + TOGETHER], lambda i: F.lit(True)) for i in range(0, len(free), TOGETHER)]
    spark = rows.sparkSession
    if bound:
        numbered = tuple((a, tuple(n)) for a, n in sorted(atoms.items()))
        path = work_path(spark, "candidates")
        schema = T.StructType([*rows.schema, T.StructField("_rules", T.ArrayType(T.IntegerType()))])
        rows.mapInArrow(_candidates(numbered), schema).filter(F.size("_rules") > 0).write.parquet(path)
        held = spark.read.schema(schema).parquet(path)
        near = sorted(r["i"] for r in held.select(F.explode("_rules").alias("i")).distinct().collect())  # at most one a rule
        parts += [(held, near[i : i + TOGETHER], lambda i: F.array_contains("_rules", i)) for i in range(0, len(near), TOGETHER)]
    tested = [_tested(of_rows, key, [rules[i] for i in some], lambda k, some=some, when=when: when(some[k])) for of_rows, some, when in parts]
    return reduce(DataFrame.unionByName, tested) if tested else spark.createDataFrame([], T.StructType([rows.schema[key], T.StructField("rule", T.StringType()), T.StructField("hits", T.LongType())]))


def _result(r: Rule, when: Column) -> Column:
    hits = sum((F.regexp_count(F.col("_c"), F.lit(s.pattern())) for s in r.strings.values()), F.lit(0)).cast("long")
    return F.when(when & r.column(F.col("_c")), F.struct(F.lit(r.name).alias("rule"), hits.alias("hits")))

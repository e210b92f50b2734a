"""Thousands of keyword rules over texts in one pass: a rule's pattern is tried only where a literal that it needs occurs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters outside of ASCII that a pattern's ASCII letters match too when case is ignored (the Kelvin sign is lowered as it is).
_FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i"})

FOUND = "tag_id string, label string, matched string, `in` string, pos int"


def folded(text: str) -> str:
    """Case folded as far as needed literals are concerned."""
    return text.translate(_FOLDED).lower()


def _plain(code: int) -> bool:
    """Characters whose only partners without regard to case are told by ``folded``: ASCII, and what has no case."""
    c = chr(code)
    return code < 128 or c.lower() == c == c.upper()


_ALNUM = frozenset(map(ord, "0123456789abcdefghijklmnopqrstuvwxyz"))
_CATEGORIES = {"WORD": _ALNUM, "DIGIT": frozenset(map(ord, "0123456789")), "SPACE": frozenset()}


def _of_class(items) -> frozenset[int] | None:
    """Which of a-z and 0-9 a class of characters takes without regard to case; None where that is not told."""
    codes, negated = set(), False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name in ("LITERAL", "RANGE"):
            lo, hi = (arg, arg) if name == "LITERAL" else arg
            if hi > 127:
                return None
            codes |= {c for c in range(lo, hi + 1)} | {ord(chr(c).lower()) for c in range(lo, hi + 1)}
        else:
            kind = str(arg).removeprefix("CATEGORY_")
            known = _CATEGORIES.get(kind.removeprefix("NOT_"))
            if known is None:
                return None
            codes |= _ALNUM - known if kind.startswith("NOT_") else known
    return _ALNUM - codes if negated else _ALNUM & codes


def _ends_a_word(element, side: int) -> bool:
    """Whether a pattern's element, next to a letter or digit, tells that there is none on its own side (-1 before, 1 after)."""
    name, arg = str(element[0]), element[1]
    if name == "AT":
        return str(arg) in ("AT_BOUNDARY", "AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING")
    if name == "ASSERT_NOT":
        inner = list(arg[1])
        return arg[0] == side and len(inner) == 1 and str(inner[0][0]) == "IN" and _of_class(inner[0][1]) == _ALNUM
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] and len(arg[-1]) == 1:
        return _ends_a_word(list(arg[-1])[0], side)
    return name == "IN" and _of_class(arg) == frozenset()


#: A literal that has to occur, and whether as a whole word of the letters a-z and digits, or two such words in a row.
Key = tuple[str, bool]
_WORD = re.compile("[a-z0-9]+")


def _gap(elements: list) -> bool:
    """Whether elements between two whole words take something, but no letter or digit: the words follow each other."""
    taking = [e for e in elements if str(e[0]) != "AT"]
    return len(taking) == 1 and str(taking[0][0]) != "ASSERT_NOT" and _ends_a_word(taking[0], 1)


def _runs(tree: list) -> Iterator[tuple[int, Key]]:
    """Stretches of plain characters of a sequence, and neighbouring words: index of the first element and what is looked for."""
    k, last = 0, None
    while k < len(tree):
        start, run = k, ""
        while k < len(tree) and str(tree[k][0]) == "LITERAL" and _plain(tree[k][1]):
            run += chr(tree[k][1])
            k += 1
        run = folded(run)
        whole = start > 0 and k < len(tree) and _WORD.fullmatch(run) and _ends_a_word(tree[start - 1], -1) and _ends_a_word(tree[k], 1)
        if whole or len(run) > 1 or run > "\x7f":
            yield start, (run, bool(whole))
        if whole and last and _gap(tree[last[1] : start]):
            yield last[0], (f"{last[2]} {run}", True)
        last = (start, k, run) if whole else last
        k += not run


def _weight(keys: frozenset[Key]) -> tuple[int, int]:
    return min(len(text) + 2 * whole for text, whole in keys), -len(keys)


def _needs(tree) -> list[frozenset[Key]]:
    """Sets of literals; of each set at least one occurs in whatever the parsed pattern matches."""
    tree = list(tree)
    needs = [frozenset([key]) for _, key in _runs(tree)]
    for op, arg in tree:
        name = str(op)
        if name == "SUBPATTERN" and not (arg[1] or arg[2]):
            needs += _needs(arg[-1])
        elif name == "ATOMIC_GROUP":
            needs += _needs(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0]:
            needs += _needs(arg[-1])
        elif name == "BRANCH":
            each = [max(_needs(branch), key=_weight, default=None) for branch in arg[1]]
            needs += [] if None in each else [frozenset().union(*each)]
    return needs


@lru_cache(maxsize=1)
def _parsed(pattern: str) -> list:
    """Elements of a pattern; none where it leaves Unicode, whose classes are those that the reasoning here is about."""
    from re import _parser

    tree = _parser.parse(pattern, re.IGNORECASE)
    return [] if tree.state.flags & (re.ASCII | re.LOCALE) else list(tree)


def needed_literals(pattern: str) -> list[frozenset[Key]]:
    """Sets of literals, case folded, each with whether it is a whole word: of each set one occurs in every text that the pattern
    matches. Empty where it tells none, as ``[0-9]+`` or ``a|.b``: such a pattern has to be tried everywhere."""
    return list(dict.fromkeys(_needs(_parsed(pattern))))


def anchor(pattern: str) -> tuple[Key, int] | None:
    """A literal that every match has at the same distance from its start, and that distance."""
    tree, best = _parsed(pattern), None
    for start, key in _runs(tree):
        before = [str(op) for op, _ in tree[:start]]
        if any(op not in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "AT", "ASSERT", "ASSERT_NOT") for op in before):
            continue
        if best is None or len(key[0]) > len(best[0][0]):
            best = key, sum(op in ("LITERAL", "NOT_LITERAL", "IN", "ANY") for op in before)
    return best


class Matcher:
    """A table of words and an automaton over the other literals of all rules. Rules are (tag id, label, pattern) in written order.

    A rule is listed under the longest literal that it needs, and looked at where the others occur too. With an anchor it is
    tried at that literal's places only, first to last, which finds the match that a search would; without, by a search."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        import ahocorasick

        self.rules, self.always, self.listed = rules, [], {}
        self.anchors = []
        words, parts = set(), set()
        for k, (_, _, pattern) in enumerate(rules):
            needs = sorted(needed_literals(pattern), key=_weight)
            self.anchors.append(anchor(pattern))
            for text, whole in set().union(*needs):
                (words if whole else parts).add(text)
            if not needs:
                self.always.append(k)
                continue
            others = [need for need in needs[:-1] if not need & needs[-1]]
            alone = [next(iter(need)) for need in others if len(need) == 1]
            for key in needs[-1]:
                self.listed.setdefault(key, []).append((k, alone, [need for need in others if len(need) > 1]))
        self.words = frozenset(words)
        self.automaton = ahocorasick.Automaton()
        for part in parts:
            self.automaton.add_word(part, (part, len(part) - 1))
        if parts:
            self.automaton.make_automaton()
        self.compiled: dict[int, re.Pattern] = {}

    def places(self, text: str) -> dict[Key, list[int]]:
        """Where literals occur. Folding keeps the number of characters, so places are those of the text."""
        text, out, last, start = folded(text), {}, "", 0
        for m in _WORD.finditer(text):
            word = m.group()
            if word in self.words:
                out.setdefault((word, True), []).append(m.start())
            if (pair := f"{last} {word}") in self.words:
                out.setdefault((pair, True), []).append(start)
            last, start = word, m.start()
        if len(self.automaton):
            for end, (part, before) in self.automaton.iter(text):
                out.setdefault((part, False), []).append(end - before)
        return out

    def candidates(self, places: dict[Key, list[int]]) -> set[int]:
        out = set(self.always)
        for key in places:
            for k, alone, sets in self.listed.get(key, ()):
                if all(one in places for one in alone) and not any(need.isdisjoint(places) for need in sets):
                    out.add(k)
        return out

    def search(self, k: int, text: str, places: dict[Key, list[int]]) -> re.Match | None:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rules[k][2], re.IGNORECASE)
        if self.anchors[k] is None:
            return self.compiled[k].search(text)
        key, distance = self.anchors[k]
        starts = (at - distance for at in places.get(key, ()) if at >= distance)
        return next(filter(None, (self.compiled[k].match(text, start) for start in starts)), None)

    def found(self, title: str | None, body: str | None, longest: int) -> Iterator[tuple[str, str, str, str, int]]:
        """Rules that match, in written order, with what they matched; a title's match comes first."""
        texts = [(where, text, self.places(text)) for where, text in (("title", title), ("body", body)) if text]
        tried = [self.candidates(places) for _, _, places in texts]
        for k in sorted(set().union(*tried)):
            for (where, text, places), candidates in zip(texts, tried, strict=True):
                if k in candidates and (m := self.search(k, text, places)):
                    tag, name, _ = self.rules[k]
                    yield tag, name, m.group(0).strip()[:longest] or name, where, k
                    break


@lru_cache(maxsize=2)
def _matcher(rules: tuple[tuple[str, str, str], ...]) -> Matcher:
    """One automaton for each set of rules and worker process."""
    return Matcher(rules)


def matches(articles: DataFrame, rules: list[dict], longest: int = 80) -> DataFrame:
    """``article_id, tag_id, label, matched, in, pos`` of NFKC ``title`` and ``body``, as ``rules.matches`` has them, for any
    number of rules.

    ``rules.matches`` adds two expressions to the plan for each rule and tries each on each text. Here each text is read once
    for all literals, and a pattern is tried at the places of its own. Patterns are Python's. Rules go to the workers
    with the task: they are settings, whose size does not depend on the articles. Null and empty texts match nothing; a
    pattern that Python cannot read raises here, not in a task. Other columns of ``articles`` are left aside."""
    known = tuple((r["tag_id"], r["label"], r["pattern"]) for r in rules)
    for _, _, pattern in known:
        re.compile(pattern, re.IGNORECASE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(known)
        for batch in batches:
            at, rows = [], []
            for n, (title, body) in enumerate(zip(batch["title"], batch["body"], strict=True)):
                got = list(matcher.found(title.as_py(), body.as_py(), longest))
                rows += got
                at += [n] * len(got)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.string()] * 4 + [pa.int32()], strict=True)]
            ids = batch["article_id"].take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *columns], ["article_id", "tag_id", "label", "matched", "in", "pos"])

    kind = articles.schema["article_id"].dataType.simpleString()
    return articles.select("article_id", "title", "body").mapInArrow(each, f"article_id {kind}, {FOUND}")

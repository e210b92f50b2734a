import os
import random
import re

import pytest

from gleanery.operators import many_rules as MR
from gleanery.operators import rules as R

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def test_needed_literals():
    def needs(pattern, *sets):
        """Sets as words apart by |, whole words in quotes."""
        want = {frozenset((w.strip("'"), w[0] == "'") for w in each.split("|")) for each in sets}
        assert set(MR.needed_literals(pattern)) == want, pattern

    needs("Price", "price")
    needs(r"\bdata\s+model\b", "'data'", "'model'", "'data model'")
    needs(r"\bdata\b\s\bbase\b.\bx1\W*y2\b", "'data'", "'base'", "'data base'", "x1", "y2")
    needs(r"\bdata\s+(?!of)\bmodel\b", "'data'", "'model'")
    needs(r"(?<![a-z0-9])Data[^a-z0-9]+in(?!\w)", "'data'", "'in'", "'data in'")
    needs(r"(?<![a-z])data(?![a-z0-9])", "data")
    needs(r"(?<!\w)data(?<!\w)", "data")
    needs(r"\bdata models\b", "data models")
    needs(r"[^a-z0-9]data\W", "'data'")
    needs(r"[^a-z]data\W?x", "data")
    needs(r"(?a)\bdata\b")
    needs("cat|horse", "cat|horse")
    needs("cat|.")
    needs("[0-9]+")
    needs("(?:spark|flink){1,2}s?", "spark|flink")
    needs("(?:spark)?x")
    needs("(?:spark)?xy", "xy")
    needs("(?-i:spark)xy", "xy")
    needs("個人情報(?!保護)", "個人情報")
    needs("法", "法")
    needs("naïve bayes", "na", "ve bayes")
    needs("(?P<a>ab)(?P=a)c", "ab")
    needs("(?=abc)...")
    needs("")
    assert MR.anchor(r"\ba\s+bc\b") == (("a bc", True), 0)
    assert MR.anchor(r"\bx[ab]data") == (("data", False), 2) and MR.anchor("x*data") is None
    assert all(len(MR.folded(chr(c))) == 1 for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def rule(k, pattern):
    return {"tag_id": f"t{k % 7}", "label": f"r{k}", "pattern": pattern}


def one_by_one(rows, rules, longest=80):
    out = []
    for key, title, body in rows:
        for k, r in enumerate(rules):
            for where, text in (("title", title), ("body", body)):
                if text and (m := re.search(r["pattern"], text, re.IGNORECASE)):
                    out.append((key, r["tag_id"], r["label"], m.group(0).strip()[:longest] or r["label"], where, k))
                    break
    return sorted(out)


def test_case_pairs_outside_of_ascii(spark):
    rules = [rule(k, p) for k, p in enumerate(["kelvin", "miss", "ink", "straße", "ΣΟΦΟΣ", "Ünder", "^$", r"\s", "(?:ab|cd)+e", "x{2}", "法律", "(?i:Q)uo"])]
    rows = [(1, "Kelvin", "Miſſ"), (2, "İnk", "ıNK"), (3, "STRASSE", "STRAẞE"), (4, "σοφος σοφοσ", "ünder"), (5, "", None), (6, None, "ABCDE xX"), (7, "法律", "qUO")]
    got = MR.matches(spark.createDataFrame(rows, "article_id int, title string, body string"), rules)
    assert sorted(map(tuple, got.collect())) == one_by_one(rows, rules)


def test_no_rules_no_rows_and_other_columns(spark):
    a = spark.createDataFrame([(1, "a", "b", "c")], "article_id long, title string, body string, tag_id string")
    assert MR.matches(a, []).collect() == []
    assert MR.matches(a.limit(0), [rule(0, "a")]).collect() == []
    assert [tuple(r) for r in MR.matches(a, [rule(0, "A"), rule(1, "b"), rule(1, "b")]).collect()] == [(1, "t0", "r0", "a", "title", 0), (1, "t1", "r1", "b", "body", 1), (1, "t1", "r1", "b", "body", 2)]
    with pytest.raises(re.error):
        MR.matches(a, [rule(0, "(")])


def test_same_as_the_rules_of_one_expression_each(spark):
    rules = [rule(k, p) for k, p in enumerate([r"\bThe\b", "th(?!e|a)[a-z]+", "src1[0-9]", "and|oder", "[xyz]{3}"])]
    rows = [(1, "src12", "the thing And"), (2, "src2", "oder thy thorn xyz"), (3, "", "")]
    a = spark.createDataFrame(rows, "article_id long, title string, body string")
    assert sorted(map(tuple, MR.matches(a, rules).collect())) == sorted(map(tuple, R.matches(a, rules).collect()))


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="no tables")
def test_five_thousand_rules_equal_one_by_one(spark):
    docs = spark.read.parquet(DOCUMENTS).selectExpr("doc_id AS article_id", "source AS title", "text AS body").collect()
    rng = random.Random(5)
    words = sorted({w for d in docs for w in re.findall(r"\w+", d["body"] or "")})
    forms = [r"\b{0}\b", "{0}", "{0}s?", r"(?:{0}|{1})\W", r"{0}\s+\w*{1}", "[{0}]+q", "(?={0}){0}", r"(?<![a-z0-9]){0}[^a-z0-9]+{1}(?![a-z0-9])", r".{0}\b", r"(?:^|\s){0}"]
    rules = [rule(k, rng.choice(forms).format(rng.choice(words), rng.choice(words))) for k in range(5000)]
    got = sorted(map(tuple, MR.matches(spark.createDataFrame(docs), rules).collect()))
    some = rng.sample(docs, 12)
    assert [r for r in got if r[0] in {d["article_id"] for d in some}] == one_by_one(some, rules)
    assert len({r[0] for r in got}) > 150

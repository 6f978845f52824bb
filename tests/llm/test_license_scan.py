"""License scans: templates against regular expressions, brute force of places, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claimledger.llm.license_scan import ORACLES, PHRASES, TEMPLATES, Automaton, mandatory, op11_license_scan, parse, pattern, scan, with_matches
from tests.llm.test_filters import same_as_sql

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
{holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def labels(text):
    auto = Automaton(tuple(tuple(parse(t)) for t in (*PHRASES, *(t for _, t in TEMPLATES))))
    names = [*PHRASES.values(), *(label for label, _ in TEMPLATES)]
    return {names[k] for k, _, _ in scan(text.encode(), auto, [w.encode() for w in auto.first_words])[1]}


def test_regions():
    assert labels(MIT.format(holder="AUTHORS OR COPYRIGHT HOLDERS")) == {"mit"}
    assert labels("// " + MIT.format(holder="Example Foundation").replace("\n", "\n// ")) == {"mit"}
    assert labels(MIT.format(holder="AUTHORS").replace('(the "Software")', "")) == {"mit"}
    assert labels(MIT.format(holder="AUTHORS").replace("PARTICULAR ", "")) == set()
    assert labels(MIT.format(holder="x " * 15)) == set() and labels(MIT.format(holder="x " * 14)) == {"mit"}
    assert labels("It is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.") == {"gpl", "gpl-2.0-or-later"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-4.0"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl", "gpl-3.0"}
    assert labels("licensed under the Apache License 2.0; or the MIT license") == {"apache", "apache-2.0", "mit"}
    assert labels("permitlicense mit licensed xmit license") == set()


def test_markup_errors():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>> b", '<<var;name="x";match=".+">> a', "a <<beginOptional>>b<<endOptional>>", '<<beginOptional>>a<<endOptional>> b', 'a <<var;name="x">> b', 'a <<var;name="x";match="[0-9]+">> b', ""):
        with pytest.raises(ValueError):
            parse(bad)
    assert mandatory(parse('a b <<var;name="x";original="";match="c d|e">> <<beginOptional>>f<<endOptional>> g')) == 4


@pytest.mark.parametrize("seed", range(4))
def test_automaton_against_regular_expressions(seed):
    rng = random.Random(seed)

    def template(depth=0):
        out = [rng.choice("ab")]
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            if kind < 0.3 and depth < 2:
                out.append(f"<<beginOptional>> {template(depth + 1)} <<endOptional>>")
            elif kind < 0.5:
                out.append(f'<<var;name="x";original="";match="{rng.choice([".{0,2}", ".{1,3}", ".{2,2}"])}">>')
            elif kind < 0.7:
                out.append('<<var;name="y";original="";match="a b|c">>')
            out.append(rng.choice("abc"))
        return " ".join(out)

    templates = [template() for _ in range(8)]
    parts = [tuple(parse(t)) for t in templates]
    auto = Automaton(tuple(parts), most_states=rng.choice([5, 20_000]))
    seeds = [w.encode() for w in auto.first_words]
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        n, got = scan(" ".join(words).encode(), auto, seeds)
        joined = " " + " ".join(words) + " "
        assert n == len(words) and {k for k, _, _ in got} == {k for k, p in enumerate(parts) if re.search(pattern(p) + " ", joined)}
        for k, s, e in got:
            assert re.fullmatch(pattern(parts[k]), " " + " ".join(words[s : e + 1]))


def brute(text):
    words = words_of(text or "")
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_op11_against_brute_force_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in op11_license_scan(spark, sf).collect()}
    assert {r["doc_id"]: tuple(rows[r["doc_id"]])[1:6] for r in docs} == {r["doc_id"]: brute(r["text"]) for r in docs}
    same_as_sql(op11_license_scan(spark, sf), ORACLES["op11_license_scan"])
    assert all(0 <= r["score"] < 1 and (r["score"] > 0) == (r["labels"] != "") for r in rows.values())


def test_op11_edges(spark, tmp_path):
    texts = [None, "", " \x00 ", "MIT LICENSE mit-license\nMIT\tLicense", "ÄMIT license", "cc by cc by", "mit " * 30_000 + "license", "Released under the MIT License. " * 3000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y"), (None, "cc by", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, labels string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_license_scan(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=repr)
    empty = next(r for r in got if r["doc_id"] == 0)
    assert tuple(empty)[1:] == (0, 0, None, None, "", "", 0.0)
    spans = with_matches(df.where("doc_id = 5"), out="hit").select(F.explode("hit.matches").alias("m")).select("m.label", "m.start_word", "m.end_word").collect()
    assert [tuple(r) for r in spans] == [("cc-by", 0, 1), ("cc-by", 2, 3)]
    assert with_matches(df.limit(0), out="hit").count() == 0 and "found" in with_matches(df, out="hit").columns

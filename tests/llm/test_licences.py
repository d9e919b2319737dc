"""The licence scan against brute force."""

import random
import re

import numpy as np

from emberlens.llm import licences as li

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def test_matching_statistics_are_the_longest_common_strings():
    r = random.Random(3)
    for _ in range(30):
        alphabet = "abcd"[: r.randint(1, 4)]
        templates = tuple((f"t{k}", " ".join(r.choice(alphabet) for _ in range(r.randint(1, 14)))) for k in range(r.randint(1, 4)))
        n = li.build(templates, {"a b": "x", "b b a": "y"})
        text = [r.choice(alphabet + "z").encode() for _ in range(60)]
        strings = [words(t) for _, t in templates] + [[b"a", b"b"], [b"b", b"b", b"a"]]
        have = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        state = matched = 0
        for i, w in enumerate(text):
            c = n.numbers.get(w, -1)
            state, matched = n.automaton.step(state, matched, c)
            longest = max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in have), default=0)
            assert matched == longest
            if matched:
                piece = text[i + 1 - matched : i + 1]
                ends = {(t, e) for t, (_, x) in enumerate(templates) for e in range(matched, len(words(x)) + 1) if words(x)[e - matched : e] == piece}
                assert set(n.ends[state]) == ends
        found, long = li.matches(np.array([n.numbers.get(w, -1) for w in text]), n, 2)
        joined = b" ".join(text)
        base = sorted((i, p) for p, x in enumerate((b"a b", b"b b a")) for i in range(len(text)) if text[i : i + len(x.split())] == x.split())
        assert sorted(found) == base and joined
        # Every match that neither side extends, and no other.
        stats = [max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in have), default=0) for i in range(len(text))]
        assert [(e, k) for e, k, _ in long] == [(i + 1, s) for i, s in enumerate(stats) if s >= 2 and (i + 1 == len(text) or stats[i + 1] <= s)]


def test_labels(spark):
    by = dict(li.TEMPLATES[::-1])
    mit = [t for label, t in li.TEMPLATES if label == "mit"][1]
    r = random.Random(1)
    prose = " ".join("".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400))
    changed = mit.replace("without limitation", "with no limitation").replace("Software", "Work")
    texts = {
        1: (None, "", ""),
        2: ("", "", ""),
        3: (prose, "", ""),
        4: ("All Rights Reserved. all  rights\nreserved", "reserved", "reserved"),
        5: ("all rights are reserved; general-public, license", "gpl", "gpl"),
        6: ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-nc-4.0"),
        7: ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
        8: ("under the GNU General Public License, version 1", "gpl", "gpl"),
        9: ("Released under the MIT License.", "", "mit"),
        10: (prose + "\n" + changed + "\n" + prose, "", "mit"),
        11: (prose + " " + by["apache-2.0"].upper() + " " + prose, "", "apache-2.0"),
        12: ("Permission is hereby granted to enter the garden, free of charge, to any person who asks.", "", ""),
        13: ("é all rights réserved", "", ""),
        14: ((prose + " cc by ") * 300, "cc-by", "cc-by"),
        15: ("The software is under the license of the city", "", ""),
    }
    rows = [(i, t[0], 7) for i, t in texts.items()] + [(4, texts[4][0], 7), (None, texts[9][0], 7)]
    out = li.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(out) == len(rows) and [x.labels for x in out if x.doc_id is None] == ["mit"]
    for x in out:
        text, base, labels = texts[x.doc_id or 9]
        w = words(text)
        at = [i for p in (b"cc by", b"general public license", b"all rights reserved") for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None)), x
        assert (x.base_labels, x.labels) == (base, labels), x
        assert 0 <= x.score <= 1 and (x.score == 1 if base else x.score >= 0.6 if labels else x.score < 0.9), x
    span = next(x for x in out if x.doc_id == 10).spans
    assert len(span) == 1 and span[0].start == 400 and abs(span[0].end - span[0].start - len(words(changed))) <= 2
    assert li.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, n_words int").limit(0)).count() == 0


def test_words_are_those_of_the_pattern(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("aZ9 \t\n.,;:-é日_@[`{\x00") for _ in range(3000))
    assert [w for part in li.words_of(text.encode()) for w in part] == words(text)
    monkeypatch.setattr(li, "SLICE", 7)
    assert [w for part in li.words_of(text.encode()) for w in part] == words(text)
    assert [w for part in li.words_of(b"a" * 9000 + b" b") for w in part] == [b"a" * 9000, b"b"]


def test_query(spark):
    from emberlens.llm.queries import op11_licences

    out = op11_licences(spark, "/root/testdata/sf0.001")
    docs = {x.doc_id: words(x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(docs) and all(x.n_words == len(docs[x.doc_id]) for x in rows)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

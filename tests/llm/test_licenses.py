import re

import pytest

from lattigraph.llm import licenses

from .cases import awkward, frame


def base_by_hand(text):
    """n_words, places and labels by the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "all RIGHTS reserved all rights reserved", "Copyright (c) 2020 Some Body. All rights reserved.", "GNU General Public License general public license",
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "cc by cc by", "CC-BY", "ccby", "Ccé by", "the mit licence", "licensed under an apache license",
]


def test_against_definition(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = licenses.scan(frame(spark, rows)).collect()
    have = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr)
    want = sorted(((i is None, i or 0, *base_by_hand(t)) for i, t in rows), key=repr)
    assert have == want
    label = {r.doc_id: r.labels for r in got}
    assert label[100] == "cc-by,cc-notice" and label[102] == "copyright-reserved,reserved" and label[104] == "mit-notice" and label[105] == "gpl,gpl-notice" and label[106] == "apache-notice"
    assert label[111] == "" and label[112] == "" and all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)
    assert licenses.scan(frame(spark, [])).count() == 0


def regex_of(template):
    """The template as a regular expression over spaced words."""
    out = ""
    for token in template.split():
        if token == "<<beginOptional>>":
            out += "(?:"
        elif token == "<<endOptional>>":
            out += ")?"
        elif m := re.fullmatch(r"<<var;max=(\d+)>>", token):
            out += rf"(?:\S+ ){{0,{m[1]}}}"
        else:
            out += re.escape(token) + " "
    return re.compile(rf"(?:^|(?<= )){out}")


@pytest.mark.parametrize("template", ["a <<beginOptional>> b <<beginOptional>> c <<endOptional>> <<endOptional>> d", "<<beginOptional>> a <<endOptional>> b <<var;max=2>> c", "a <<var;max=1>> <<beginOptional>> b <<endOptional>> a", "<<var;max=2>> c c", *licenses.TEMPLATES.values()])
def test_automaton_is_the_regular_expression(template):
    import itertools

    machine, pattern = licenses.Automaton(template), regex_of(template)
    alphabet = "abcd" if len(template) < 90 else None
    texts = [" ".join(t) for n in range(1, 6) for t in itertools.product(alphabet, repeat=n)] if alphabet and "license" not in template else TEXTS + [template.replace("<<beginOptional>>", "").replace("<<endOptional>>", "")]
    for t in texts:
        w = [x.encode() for x in re.findall(r"[0-9a-z]+", t.lower())]
        assert machine.accepts(w) == bool(pattern.search(" ".join(x.decode() for x in w) + " ")), t
    with pytest.raises(ValueError):
        licenses.Automaton("a <<beginOptional>> b")

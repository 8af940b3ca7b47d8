"""License scans (operator 5): template-markup matching.

A template is license wording with two kinds of regions: ``<<beginOptional>> ... <<endOptional>>`` may be
absent, and ``<<var;max=N>>`` stands for 0 to N words of any kind. A template is compiled once into an
automaton over words; a text matches where the automaton accepts a run of its words, so the mandatory wording
must be there exactly, in order, and nothing else but the marked regions may come between.

Every text is scanned whole. Its words are ASCII digits, a-z (A-Z lowered) and anything beyond ASCII. A template is tried only
where its longest mandatory run of words occurs, which no match can lack.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned each;
an empty table yields no rows; other columns are not read. ``score``: 1 with a template match, 0.5 with
base phrases alone, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label; the wording of public license notices.
TEMPLATES = {
    "mit-notice": "<<beginOptional>> this <<var;max=3>> is <<endOptional>> <<beginOptional>> released <<endOptional>> <<beginOptional>> licensed <<endOptional>> under the <<beginOptional>> terms of the <<endOptional>> mit license",
    "apache-notice": "licensed under the apache license <<beginOptional>> version <<var;max=2>> <<endOptional>>",
    "gpl-notice": "licensed under the <<beginOptional>> terms of the <<endOptional>> <<beginOptional>> gnu <<endOptional>> general public license <<beginOptional>> version <<var;max=2>> <<endOptional>>",
    "cc-notice": "licensed under <<beginOptional>> a <<endOptional>> cc by <<beginOptional>> nc <<endOptional>> <<beginOptional>> sa <<endOptional>> <<beginOptional>> nd <<endOptional>> <<var;max=2>>",
    "copyright-reserved": "copyright <<var;max=12>> all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>> the software <<endOptional>> to deal in the software without restriction",
    "isc-grant": "permission to use copy modify and <<beginOptional>> or <<endOptional>> distribute this software for any purpose with or without fee is hereby granted",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;max=(\d+)>>|[^\s<]+")
_ANY = object()


class Automaton:
    """A nondeterministic automaton over words, run on all its states at once."""

    def __init__(self, template: str):
        self.steps: list[dict] = []  # state -> {word or _ANY: {next states}}
        self.skips: list[set[int]] = []  # state -> states reached without a word
        run: list[bytes] = []
        runs, depth, at, opened = [], 0, self._state(), []
        for m in _MARK.finditer(template):
            token = m[0]
            if token == "<<beginOptional>>":
                opened.append(at)
                at_next = self._state()
                self.skips[at].add(at_next)
                at = at_next
            elif token == "<<endOptional>>":
                end = self._state()
                self.skips[at].add(end)
                self.skips[opened.pop()].add(end)
                at = end
            elif m[1]:
                end = self._state()
                for _ in range(int(m[1])):
                    self.skips[at].add(end)
                    at_next = self._state()
                    self.steps[at].setdefault(_ANY, set()).add(at_next)
                    at = at_next
                self.skips[at].add(end)
                at = end
            else:
                at_next = self._state()
                self.steps[at].setdefault(token.encode(), set()).add(at_next)
                at = at_next
                if not opened:
                    run.append(token.encode())
                    continue
            runs.append(run)
            run = []
        if opened:
            raise ValueError("an optional region is not closed")
        self.final = at
        #: a run of words that every match contains
        self.anchor = b" " + b" ".join(max([*runs, run], key=lambda r: sum(map(len, r)))) + b" "
        self.begin = self._close({0})
        self.first = {w for s in self.begin for w in self.steps[s]}

    def _state(self) -> int:
        self.steps.append({})
        self.skips.append(set())
        return len(self.steps) - 1

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def accepts(self, words: list[bytes]) -> bool:
        """Whether some run of ``words`` is a match. All starts are followed at once, so time is linear."""
        states: frozenset[int] = frozenset()
        for w in words:
            now = states | self.begin if w in self.first or _ANY in self.first else states
            if now:
                states = self._close({t for s in now for k in (w, _ANY) for t in self.steps[s].get(k, ())})
                if self.final in states:
                    return True
        return False


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which ``phrase`` starts in b' w0 w1 ... '."""
    at, counted, word = joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        yield word
        at = joined.find(phrase, at + 1)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row for each document; see the module."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {label: Automaton(t) for label, t in templates.items()}
        phrases = {label: b" " + p.encode() + b" " for p, label in base.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = []
                for text in batch.column(1).to_pylist():
                    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
                    joined = b" " + b" ".join(words) + b" "
                    places = {label: list(_places(joined, p)) for label, p in phrases.items() if p in joined}
                    own = [label for label, m in machines.items() if m.anchor in joined and m.accepts(words)]
                    every = [x for p in places.values() for x in p]
                    rows.append((len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(set(places))), ",".join(sorted({*places, *own})), 1.0 if own else 0.5 if places else 0.0))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
